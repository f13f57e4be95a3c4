"""webreach: turn crawled web pages into business contacts with Spark.

Layout:
  functions/  Column -> Column expressions (URLs, HTML text, extractors)
  operators/  DataFrame -> DataFrame relational steps (page facts, links,
              JSON-LD walk, keep-list, fallbacks, gather, enrich, audit)
  sources/    readers, sinks and the synthetic-site tables
  plans/      the registered queries and their DuckDB twins
  streaming/  Structured Streaming versions of the URL list and page feed
"""

from webreach.session import get_spark, checkpoint_dir, materialize

__all__ = ["get_spark", "checkpoint_dir", "materialize"]
