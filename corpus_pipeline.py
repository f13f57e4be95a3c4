"""Corpus pipeline over ``documents``: quality rules, line dedup, n-gram Jaccard
join, benchmark decontamination, packing. Each stage is written as a table in
the shared folder and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webreach.llm import decontam, forest, lines, packing, quality
from webreach.llm.common import narrow_batches, table, written

STAGES = [
    ("quality rules", narrow_batches(quality.stage)),
    ("line dedup", narrow_batches(lines.stage)),
    ("n-gram Jaccard join", narrow_batches(forest.stage)),
    ("benchmark decontamination", narrow_batches(decontam.stage)),
    ("packing", narrow_batches(packing.stage)),
]

#: None: no SQL can say the trained and similarity stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
