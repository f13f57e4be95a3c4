"""Public entry points, one per way the original tool is used.

* ``gather_contacts``  – URL list -> contact records          (O-K1)
* ``batch_export``     – URL-list file -> JSON lines + table   (O-K5: O-A1 -> O-K1 -> O-G3 -> O-A5/O-A6)
* ``enrich_table``     – any table with a website column -> same rows + Email, Phone, AI Summary (O-K3)
* ``enrich_csv``       – CSV file -> enriched CSV file         (O-A2 -> O-K3 -> O-A7)
* ``enrich_url_list``  – JSON request file -> flat results     (O-A3 -> O-K4)

Crawled pages, search results and model replies are tables; everything else
is computed by Spark. Each call builds the pipeline once for its inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webreach.operators import enrich as EN
from webreach.operators import gather as G
from webreach.sources import io as IO
from webreach.session import configure, materialize


def _build(targets: DataFrame, pages: DataFrame, search_results=None, ai_contacts=None, ai_decisions=None,
           deny_rules=None):
    configure(pages.sparkSession)
    return G.build(targets, pages, search_results, ai_contacts, ai_decisions, prune=True, deny_rules=deny_rules)


def gather_contacts(targets: DataFrame, pages: DataFrame, search_results: DataFrame | None = None,
                    ai_contacts: DataFrame | None = None, ai_decisions: DataFrame | None = None,
                    deny_rules: DataFrame | None = None) -> DataFrame:
    """targets(input_pos, raw) -> (input_pos, Website, Email, Phone, AI Summary), one row per
    input row whose site produced a record (duplicates kept). ``deny_rules``, here and
    below: a table (kind, text) of operators/deny.py whose e-mails are left out."""
    st = _build(targets, pages, search_results, ai_contacts, ai_decisions, deny_rules)
    return (st.targets.join(st.contacts, "url")
            .select("input_pos", F.col("website").alias("Website"), F.col("emails").alias("Email"),
                    F.col("phones").alias("Phone"), F.col("summary").alias("AI Summary")))


def batch_export(url_file: str, pages: DataFrame, out_json: str | None = None, out_csv: str | None = None,
                 search_results=None, ai_contacts=None, ai_decisions=None, deny_rules=None) -> DataFrame:
    """O-K5: URL-list file -> records with phones normalised and deduplicated,
    written as JSON lines and/or a CSV table, in input order."""
    spark = pages.sparkSession
    targets = IO.read_url_list(spark, url_file).select("input_pos", "raw")
    st = _build(targets, pages, search_results, ai_contacts, ai_decisions, deny_rules)
    recs = (st.targets.join(st.contacts, "url")
            .select("input_pos", "website", "emails", G.dedup_phones(F.col("phones")).alias("phones"), "summary"))
    if out_json:
        IO.write_json(recs.select("input_pos", F.col("website").alias("Website"), F.col("emails").alias("Email"),
                                  F.col("phones").alias("Phone"), F.col("summary").alias("AI Summary")),
                      out_json)
    if out_csv:
        IO.write_csv(IO.export_table(recs), out_csv)
    return recs


def enrich_table(df: DataFrame, pages: DataFrame, url_col: str | None = None, pos_col: str | None = None,
                 search_results=None, ai_contacts=None, ai_decisions=None, deny_rules=None) -> DataFrame:
    """O-K3: every row of ``df`` plus Email, Phone, AI Summary (empty strings
    when the row's URL is invalid or produced no record). The URL column is
    detected from the header when not given (O-B8)."""
    configure(df.sparkSession)
    url_col = url_col or IO.detect_url_column(df.columns)
    keep = [c for c in df.columns if c != pos_col]
    if pos_col is None:
        # the positions that rows and targets go by are written, so both read the same
        pos_col = "_row_pos"
        df = materialize(df.withColumn(pos_col, F.monotonically_increasing_id()))
    targets = (df.select(F.col(pos_col).alias("input_pos"), F.col(f"`{url_col}`").alias("raw"))
               .filter(F.col("raw").isNotNull()))
    st = _build(targets, pages, search_results, ai_contacts, ai_decisions, deny_rules)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    out = EN.with_contacts(rows, F.col(f"row.`{url_col}`"), st.targets, st.contacts)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], F.col("email").alias("Email"),
                      F.col("phone").alias("Phone"), F.col("summary").alias("AI Summary"), F.col(f"row.`{pos_col}`").alias(pos_col))


def enrich_csv(in_path: str, out_path: str, pages: DataFrame, quote_all: bool = False, **tables) -> DataFrame:
    """O-A2 -> O-K3 -> O-A7: read a header CSV, enrich every row, write it in
    input order with the three extra columns."""
    spark = pages.sparkSession
    df, url_col = IO.read_url_csv(spark, in_path)
    # rows are read for the targets and again for the output: both take the place in the file as the row's identity
    out = enrich_table(df, pages, url_col, "input_pos", **tables)
    IO.write_csv(out, out_path, order_col="input_pos", quote_all=quote_all)
    return out


def enrich_url_list(request_path: str, pages: DataFrame, **tables) -> DataFrame:
    """O-A3 -> O-K4: JSON request bodies -> website, email, phone, summary,
    one row per distinct valid URL in first-seen order."""
    spark = pages.sparkSession
    targets = IO.read_url_json(spark, request_path).select("input_pos", "raw")
    st = _build(targets, pages, tables.get("search_results"), tables.get("ai_contacts"), tables.get("ai_decisions"), tables.get("deny_rules"))
    return EN.enrich_urls(st.targets, st.contacts).orderBy("input_pos")


__all__ = ["gather_contacts", "batch_export", "enrich_table", "enrich_csv", "enrich_url_list"]
