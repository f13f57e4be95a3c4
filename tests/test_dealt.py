"""Work over the synthetic sites is dealt by keys, and phone scans read runs only."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import one_col
from webreach.functions import extract as X
from webreach.functions import patterns as P
from webreach.functions import urls as U
from webreach.operators import pages as PG
from webreach.sources import synth, tables


def test_keys_of_one_split_are_dealt(spark, tmp_path):
    n = 3 * tables.DEALT_ROWS + 1
    spark.range(n).select(F.when(F.col("id") > 5, F.col("id") % 9000).alias(synth.K)).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(2).select(F.col("id").alias("page_id"), F.lit("a.test").alias("url"), F.lit("<p>").alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    keys = spark.read.parquet(os.path.join(str(tmp_path), "customer.parquet"))
    dealt = tables.dealt(keys)
    assert dealt.rdd.getNumPartitions() == 4
    assert max(dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 1.1 * n / 4
    assert dealt.exceptAll(keys).isEmpty() and keys.exceptAll(dealt).isEmpty()  # repeated and null keys too
    assert tables.synthetic(spark, str(tmp_path))["syn_pages"].filter("page_id % 100 = 0").rdd.getNumPartitions() >= 4 * 4
    assert tables.dealt(keys.limit(5)).rdd.getNumPartitions() == 1


def test_rows_of_one_row_group_are_dealt_whatever_its_empty_splits(spark, tmp_path):
    n = 2 * tables.DEALT_ROWS + 1
    spark.range(3).select(F.col("id").alias(synth.K)).write.parquet(str(tmp_path / "customer.parquet"))
    pages = spark.range(n).select((F.col("id") % 9000).alias("page_id"), F.lit("a.test").alias("url"), F.lit("<p>").alias("html"))
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        given = spark.read.parquet(str(tmp_path / "pages.parquet"))
        assert given.rdd.getNumPartitions() > 3
        assert max(given.groupBy(F.spark_partition_id()).count().toPandas()["count"]) == n
        for df in (tables.dealt(given), tables.synthetic(spark, str(tmp_path))["syn_pages"].filter("page_id >= 1000000000")):
            assert max(df.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 1.1 * n / 3
            assert df.count() == n
        assert tables.dealt(given).exceptAll(given).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pages_to_drop_are_written_once(spark):
    facts = spark.createDataFrame([(2, "k"), (1, "k"), (3, "l"), (4, None), (5, None)], "page_id bigint, page_key string")
    kept = PG.dedup_pages(facts)
    assert sorted(r.page_id for r in kept.collect()) == [1, 3, 4, 5]
    assert "Aggregate" not in kept._jdf.queryExecution().optimizedPlan().toString()


TEXTS = [None, "", "x", "077 748 1234", "x077 748 1234x", "(03) 9563 1234", "-(03)-9563 1234", " 2571 2345", " 2571 2345", "))2571 2345",
         "0112574123\n0112574123", "12(34)5678 9012", "1234567", "123456", "a1b2 1234 5678(011) 257 1234-5678 9",
         "١٢٣ ٤٥٦ ٧٨٩٠", "\U0001F600" + "1300 123 456" + "\U0001D7D8" * 9, "1" * 40, ("1 " * 30), "2024-01-01 12.34.5678.1234",
         "011--257 1234 5678", "( 011 257 1234", "5 (02) 8123 4567.", "\n\n\n\n\n\n\n\n12", "1 a1234567", "9 99 999 9999 (99)999 9999"]


@pytest.mark.parametrize("glue", ["", " ", "x", "(", "-"])
def test_phone_scan_of_runs_equals_scan_of_the_text(spark, glue):
    whole = [X.find_all("v", p) for p in P.PHONE_PATTERNS]
    plain = F.filter(F.array_union(F.array_union(whole[0], whole[1]), whole[2]), lambda v: X.has_min_digits(v))
    texts = TEXTS + [None if t is None else t + glue + u for t in TEXTS for u in TEXTS if u is not None]
    df = one_col(spark, texts).select("v", X.phones("v").alias("got"), F.coalesce(plain, F.array().cast("array<string>")).alias("want"))
    assert df.filter("got <> want or got is null").collect() == []


def test_short_way_of_clean_url_and_strip_key(spark):
    urls = ["https://a.test/#", "HTTPS://A.test/#", "http://a.test/#b#", "https://#", "http://", "httpS://x/", "https://a/b//", "https://a//#f/", "#", "/", "a#b/", None]
    rows = one_col(spark, urls).select("v", U.clean_url("v").alias("c"), U.strip_key("v").alias("k")).collect()
    assert [r.c for r in rows] == ["https://a.test/", "https://A.test/", "http://a.test/#b#", "https://", "http://", "https://x/", "https://a/b//",
                                   "https://a//#f/", "", "/", "a#b/", None]
    assert [r.k for r in rows] == ["https://a.test", "HTTPS://A.test", "http://a.test", "https:", "http:", "httpS://x", "https://a/b", "https://a", "", "", "a", None]
