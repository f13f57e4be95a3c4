"""Input tables: the driver's parquet files and the synthetic-site tables."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.sources import synth

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Session setting: number of partitions that each source is dealt to. Unset (as
# on a cluster), the splits of the scan decide.
PARTITIONS = "webreach.source.partitions"
# Keys that one task makes pages, targets or hits of, or pages that it parses.
DEALT_ROWS = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    n = spark.conf.get(PARTITIONS, None)
    return df if n is None else df.repartition(int(n))


def feed_source(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, dict]:
    """Folder and options by which a table is read as a stream of files: the table
    itself if it is a folder, else the folder it stands in, for its file alone (a
    stream can't name a file)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{name}.parquet"))
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return path.toString(), {}
    return sf_dir, {"pathGlobFilter": f"{name}.parquet"}


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in partitions of ``DEALT_ROWS`` rows, if a split holds more: a key
    of a few bytes stands for whole pages, so the size of its file says nothing
    about the work of a split. Nor does the number of splits: those of a file with
    one row group are empty but for one."""
    held = df.groupBy(F.spark_partition_id().alias("split")).count()
    splits, rows, most = held.agg(F.count("*"), F.sum("count"), F.max("count")).first()
    return df.repartition(max(splits, -(-rows // DEALT_ROWS))) if splits and most > DEALT_ROWS else df


def synthetic(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """syn_targets, syn_pages, search_results, ai_contacts, ai_decisions."""
    pages = dealt(spark.read.parquet(os.path.join(sf_dir, "pages.parquet")).select("page_id", "url", "html"))
    customer = dealt(table(spark, sf_dir, "customer").select(synth.K))
    return synth.register(spark, customer, pages, re.sub(r"[^A-Za-z0-9]", "_", sf_dir))


def state(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """The files behind tables, with sizes and times: what a cached result rests on."""
    out = []
    for name in names:
        for file in spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).inputFiles():
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            out.append((file, status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))
