"""Structured Streaming feeds (O-L1, O-L2).

O-L1: a growing folder of URL-list files -> normalized, valid URLs, each URL
emitted once: an epoch's URLs are anti-joined with the table of those written by
earlier epochs, so the stream itself holds no state.
O-L2: a folder of crawled-page parquet files -> page candidates, stateless
(page facts + the JSON-LD walk per micro-batch). ``foreachBatch`` writes each
epoch to a folder of its own and replaces it when the epoch is replayed.
``streaming/contacts.py`` keeps contacts up to date with such a feed.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.functions import urls as U
from webreach.operators import pages as PG
from webreach.operators import sites as S
from webreach.session import checkpoint_dir, materialize
from webreach.streaming import epochs

URL_SCHEMA = "url string"
PAGES_SCHEMA = "page_id bigint, url string, html string"


def url_feed(spark: SparkSession, folder: str, **options) -> DataFrame:
    """O-L1 input: normalized valid URLs of a growing folder, repeats included."""
    lines = spark.readStream.format("text").options(**options).load(folder)
    return lines.select(U.normalize_url("value").alias("url")).filter((F.col("url") != "") & U.is_valid_url("url"))


def write_new_urls(spark: SparkSession, batch: DataFrame, epoch_id: int, target: str) -> None:
    """URLs of one micro-batch that no earlier epoch has written, in the epoch's own folder."""
    seen = epochs.read(spark, target, URL_SCHEMA, epoch_id).select("url")
    epochs.write(batch.select("url").distinct().join(seen, "url", "left_anti"), target, epoch_id)


def page_feed(spark: SparkSession, folder: str, schema: str = PAGES_SCHEMA, **options) -> DataFrame:
    """O-L2 input: the page feed as a streaming DataFrame."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def candidates_of(pages: DataFrame) -> DataFrame:
    """(page_id, page_key, channel, value) of a batch of pages; every page has
    its own candidates, also where several share a key. The facts are written
    once, as three branches read them."""
    return S.page_candidates(materialize(PG.page_facts(pages)), ("page_id", "page_key"))


def write_epoch(batch: DataFrame, epoch_id: int, target: str) -> None:
    """Candidates of one micro-batch, in the epoch's own folder."""
    epochs.write(candidates_of(batch), target, epoch_id)


def run_url_stream(spark: SparkSession, folder: str, out_dir: str | None = None, **options) -> DataFrame:
    """Run O-L1 over what is new in ``folder`` (availableNow) and return all URLs
    emitted so far as a batch DataFrame (url, epoch)."""
    base = out_dir or os.path.join(checkpoint_dir(spark), f"url-stream-{uuid.uuid4().hex}")
    target = os.path.join(base, "out")
    q = (url_feed(spark, folder, **options).writeStream
         .foreachBatch(lambda batch, epoch_id: write_new_urls(spark, batch, epoch_id, target))
         .option("checkpointLocation", os.path.join(base, "_state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return epochs.read(spark, target, URL_SCHEMA)


def run_page_stream(spark: SparkSession, folder: str, out_dir: str | None = None, **options) -> DataFrame:
    """Run O-L2 to completion (availableNow) and return the table of
    candidates: (page_id, page_key, channel, value, epoch)."""
    base = out_dir or os.path.join(checkpoint_dir(spark), f"page-stream-{uuid.uuid4().hex}")
    target = os.path.join(base, "candidates")
    q = (page_feed(spark, folder, **options).writeStream
         .foreachBatch(lambda batch, epoch_id: write_epoch(batch, epoch_id, target))
         .option("checkpointLocation", os.path.join(base, "_state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema("page_id bigint, page_key string, channel string, value string, epoch int").parquet(target)
