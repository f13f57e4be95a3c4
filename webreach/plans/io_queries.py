"""Registered round trips through the readers and sinks (O-A1..O-A3, O-A5,
O-A7, O-A8, O-H6, O-J4, O-K3, O-K4): data derived from the synthetic targets is written to the
shared checkpoint folder, read back through the public entry points, and
must equal the in-memory enrichment."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from webreach import api
from webreach.plans import duck as D
from webreach.plans import duck_enrich as DE
from webreach.plans.duck_sites import pipeline_sql
from webreach.plans.registry import register
from webreach.plans.site_queries import stages
from webreach.session import checkpoint_dir, materialize
from webreach.sources import io as IO


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@register("csv_enrich_roundtrip", f"""
SELECT CAST(input_pos AS VARCHAR) AS id, raw AS website, 'Site ' || CAST(input_pos AS VARCHAR) AS name,
  email AS "Email", phone AS "Phone", summary AS "AI Summary"
FROM ({pipeline_sql(DE.DUCK_ENRICHED_ROWS)})
""")
def csv_enrich_roundtrip(spark, sf):
    """O-A2 -> O-B8 -> O-K3 -> O-A7/O-A8: CSV in, enriched quoted CSV out."""
    st = stages(spark, sf)
    base = _scratch(spark, "csv-enrich")
    rows = st.tables["syn_targets"].select(
        F.col("input_pos").cast("string").alias("id"), F.col("raw").alias("website"),
        F.concat(F.lit("Site "), F.col("input_pos").cast("string")).alias("name"), "input_pos")
    IO.write_csv(rows, os.path.join(base, "in"), order_col="input_pos")
    T = st.tables
    api.enrich_csv(os.path.join(base, "in"), os.path.join(base, "out"), T["syn_pages"], quote_all=True,
                   search_results=T["search_results"], ai_contacts=T["ai_contacts"], ai_decisions=T["ai_decisions"])
    back = (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .csv(os.path.join(base, "out")))
    return back.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c)
                         for c in ("id", "website", "name", "Email", "Phone", "AI Summary")])


@register("url_request_roundtrip", f"""
SELECT website, email, phone, summary FROM ({pipeline_sql(DE.DUCK_ENRICHED_URLS)})
""")
def url_request_roundtrip(spark, sf):
    """O-A3 -> O-K4: JSON request lines (array and newline-string forms) in,
    flat results out."""
    st = stages(spark, sf)
    base = _scratch(spark, "url-requests")
    t = st.tables["syn_targets"].withColumn("req", F.floor(F.col("input_pos") / 100))  # a few dozen URLs a request
    reqs = t.groupBy("req").agg(F.sort_array(F.collect_list(F.struct("input_pos", "raw"))).alias("items"))
    as_list = F.to_json(F.struct(F.transform("items", lambda x: x["raw"]).alias("urls")))
    as_text = F.to_json(F.struct(F.array_join(F.transform("items", lambda x: x["raw"]), "\n").alias("urls")))
    reqs.select(F.when(F.col("req") % 2 == 0, as_list).otherwise(as_text).alias("value"), "req") \
        .orderBy("req").select("value").write.mode("overwrite").text(os.path.join(base, "in"))
    T = st.tables
    out = api.enrich_url_list(os.path.join(base, "in"), T["syn_pages"], search_results=T["search_results"],
                              ai_contacts=T["ai_contacts"], ai_decisions=T["ai_decisions"])
    return out.select("website", "email", "phone", "summary")


@register("url_list_source", pipeline_sql(f"""
SELECT {D.normalize_url('u')} AS url FROM (
  SELECT raw AS u FROM syn_targets UNION ALL SELECT 'list' || raw FROM syn_targets)
WHERE {D.is_valid_url(D.normalize_url('u'))}"""))
def url_list_source(spark, sf):
    """O-A1: targets as a URL-list file, two to a line with a line break that
    only str.splitlines() knows; valid URLs come back, duplicates kept."""
    raw = stages(spark, sf).tables["syn_targets"].select("raw")
    path = os.path.join(_scratch(spark, "url-list"), "in")
    raw.select(F.concat("raw", F.lit("\u2028list"), "raw").alias("value")).write.text(path)
    return IO.read_url_list(spark, path).select("url")


@register("json_sink", pipeline_sql("""
SELECT url AS "Website", array_to_string(list_sort(emails), ', ') AS "Email",
  array_to_string(list_sort(phones), ', ') AS "Phone", summary AS "AI Summary" FROM contacts"""))
def json_sink(spark, sf):
    """O-A5: contact records as JSON lines, arrays as arrays, read back."""
    c = stages(spark, sf).contacts
    path = os.path.join(_scratch(spark, "json"), "out")
    IO.write_json(c.select(F.col("url").alias("Website"), F.col("emails").alias("Email"), F.col("phones").alias("Phone"),
                           F.col("summary").alias("AI Summary")), path, order_col=None)
    back = spark.read.schema("Website string, Email array<string>, Phone array<string>, `AI Summary` string").json(path)
    return back.select("Website", F.array_join("Email", ", ").alias("Email"), F.array_join("Phone", ", ").alias("Phone"), "`AI Summary`")


@register("input_order_restored", pipeline_sql("""
SELECT row_number() OVER (ORDER BY input_pos) - 1 AS line_no, raw FROM syn_targets"""))
def input_order_restored(spark, sf):
    """O-H6: rows in any order, written as CSV in input order; the line each
    row stands on in the file."""
    t = stages(spark, sf).tables["syn_targets"]
    path = os.path.join(_scratch(spark, "ordered"), "out")
    IO.write_csv(t.repartition(7, "raw").select("raw", "input_pos"), path, order_col="input_pos", quote_all=True)
    back = materialize(IO.numbered(spark.read.option("header", True).option("escape", '"').csv(path)))
    return back.select("line_no", "raw")


@register("folder_order_restored", pipeline_sql("""
SELECT row_number() OVER (ORDER BY input_pos) - 1 AS line_no, raw FROM syn_targets"""))
def folder_order_restored(spark, sf):
    """O-H6 / O-A2: rows in input order over four files of very unequal size
    (a twentieth, then nearly half, a tenth, the rest); the line each row stands
    on in the files taken by name."""
    t = stages(spark, sf).tables["syn_targets"].select("raw", "input_pos")
    cuts = t.approxQuantile("input_pos", [0.05, 0.5, 0.6], 0.001)
    path = os.path.join(_scratch(spark, "folder"), "in")
    for k, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = t.filter((F.lit(a).isNull() | (F.col("input_pos") > a)) & (F.lit(b).isNull() | (F.col("input_pos") <= b)))
        IO.write_csv(part, os.path.join(path, f"part={k}"), quote_all=True)
    back = spark.read.schema("raw string").option("header", True).option("escape", '"').csv(os.path.join(path, "part=*"))
    return materialize(IO.numbered(back)).select("line_no", "raw")


@register("csv_records_in_splits", pipeline_sql("""
SELECT CAST(input_pos AS VARCHAR) AS id, raw AS website, 'say "hi",' || chr(10) || raw || chr(10) || CAST(input_pos AS VARCHAR) AS notes,
  row_number() OVER (ORDER BY input_pos) - 1 AS place FROM syn_targets"""))
def csv_records_in_splits(spark, sf):
    """O-A2: a CSV whose last field holds quotes, commas and line breaks, read
    in blocks; every record whole and in its place."""
    t = stages(spark, sf).tables["syn_targets"]
    path = os.path.join(_scratch(spark, "broken-lines"), "in")
    pos = F.col("input_pos").cast("string")
    notes = F.concat(F.lit('say "hi",\n'), "raw", F.lit("\n"), pos)
    IO.write_csv(t.select(pos.alias("id"), F.col("raw").alias("website"), notes.alias("notes"), "input_pos"), path)
    df, _ = IO.read_url_csv(spark, path)
    df = materialize(df)
    # places become numbers as in numbered(): by the rows of the blocks before, then by place in the block
    block = [F.col("input_pos.file").alias("f"), F.col("input_pos.block").alias("b")]
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = df.groupBy(*block).agg(F.count("*").alias("n")).select("f", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("f", "b").orderBy("input_pos"))
    return df.select("*", *block).join(starts, ["f", "b"]).select("id", "website", "notes", (F.col("start") + own - 1).alias("place"))


@register("ui_rows", f"""
SELECT {D.display_url('website')} AS website, CASE WHEN email = '' THEN '—' ELSE email END AS email,
  CASE WHEN phone = '' THEN '—' ELSE phone END AS phone, CASE WHEN summary = '' THEN '—' ELSE summary END AS summary
FROM ({pipeline_sql(DE.DUCK_ENRICHED_URLS)})
""")
def ui_rows(spark, sf):
    """O-J4 / O-B7: flat results as the page shows them, an em dash for an empty cell."""
    from webreach.operators import enrich as EN
    st = stages(spark, sf)
    return IO.display_rows(EN.enrich_urls(st.targets, st.contacts))


@register("wide_rows_enriched", f"""
SELECT CAST(input_pos AS VARCHAR) AS id, raw AS website, repeat(CAST(input_pos AS VARCHAR), 40) AS wide,
  email AS "Email", phone AS "Phone", summary AS "AI Summary" FROM ({pipeline_sql(DE.DUCK_ENRICHED_ROWS)})
""")
def wide_rows_enriched(spark, sf):
    """O-K3 over a frame dealt by a column, with a wide one: every row keeps its own contacts."""
    st = stages(spark, sf)
    T = st.tables
    wide = T["syn_targets"].select(F.col("input_pos").cast("string").alias("id"), F.col("raw").alias("website"),
                                   F.repeat(F.col("input_pos").cast("string"), 40).alias("wide")).repartition(13, "wide")
    out = api.enrich_table(wide, T["syn_pages"], None, None, search_results=T["search_results"],
                           ai_contacts=T["ai_contacts"], ai_decisions=T["ai_decisions"])
    return out.drop("_row_pos")
