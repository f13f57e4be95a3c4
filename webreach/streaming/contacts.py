"""Contacts kept up to date with a page feed (O-L2 into O-K1).

``facts/epoch=n``  the pages of an epoch, parsed once; ``html`` isn't read again.
``cands/epoch=n``  the candidates of these pages, JSON-LD included, made once.
``sites/epoch=n``  one row for every site that the epoch recomputed: its contact
                   (null: none) and ``asks``, the keys of all pages that were
                   looked up for it, found or not.

A page that arrives, however late, can change the sites that asked for its key
and no others: the keys of an epoch are joined with ``asks``, and the pipeline
runs for those sites (and for targets it hasn't met) over the facts so far. Its
row with the largest epoch is what holds for a site. The result equals the whole
batch over all pages that have arrived.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.functions import patterns as P
from webreach.functions import urls as U
from webreach.operators import fallback as FB
from webreach.operators import gather as G
from webreach.operators import pages as PG
from webreach.operators import sites as S
from webreach.session import materialize
from webreach.streaming import epochs
from webreach.streaming.feeds import PAGES_SCHEMA, page_feed

CONTACT = ("website", "emails", "phones", "summary")
CANDS_SCHEMA = "page_id bigint, page_key string, channel string, value string"
SITES_SCHEMA = "url string, asks array<string>, contact struct<website:string,emails:array<string>,phones:array<string>,summary:string>"


def _facts(spark: SparkSession, base: str, before: int) -> DataFrame:
    schema = PG.page_facts(spark.createDataFrame([], PAGES_SCHEMA)).schema
    return epochs.read(spark, os.path.join(base, "facts"), schema, before)


def site_log(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """The row that holds for every site: (url, asks, contact, epoch)."""
    rows = epochs.read(spark, os.path.join(base, "sites"), SITES_SCHEMA, before)
    return rows.join(rows.groupBy("url").agg(F.max("epoch").alias("epoch")), ["url", "epoch"])


def contact_table(spark: SparkSession, base: str) -> DataFrame:
    """(url, website, emails, phones, summary) after the epochs so far."""
    return site_log(spark, base).filter("contact is not null").select("url", *[F.col(f"contact.{c}").alias(c) for c in CONTACT])


def site_rows(stages: G.Stages, search: DataFrame | None) -> DataFrame:
    """Every site of a build with its contact and the page keys that it asked
    for: its own, those of its contact links and, if it needed a fallback, those
    of its Facebook page and of its search hits."""
    asked = (stages.sites.select("url", F.col("site_key").alias("page_key"))
             .unionByName(stages.links.select("url", U.page_key("link_key").alias("page_key")))
             .unionByName(stages.need.filter("fb_href is not null").select("url", U.page_key("fb_href").alias("page_key"))))
    if search is not None:
        asked = asked.unionByName(FB.asked_hits(stages.need, stages.hits))
    keys = asked.filter("page_key is not null").groupBy("url").agg(F.collect_set("page_key").alias("asks"))
    contact = stages.contacts.select("url", F.struct(*CONTACT).alias("contact"))
    return (stages.sites.select("url").join(keys, "url", "left").join(contact, "url", "left")
            .select("url", F.coalesce("asks", F.array().cast("array<string>")).alias("asks"), "contact"))


def new_facts(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Facts of the pages that ``known`` facts don't hold, one row for each page_id
    and key. Repeats are looked for by page_id, so that only pages whose id comes
    twice are dealt, and neither ``html`` nor facts of the others."""
    pages = PG.fetchable(pages)
    ids = pages.select("page_id")
    twice = materialize(ids.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("page_id").alias("_id")))
    if not twice.isEmpty():
        same = F.col("page_id").eqNullSafe(F.col("_id"))
        again = pages.join(twice, same, "left_semi").withColumn("_key", U.page_key("url"))
        pages = pages.join(twice, same, "left_anti").unionByName(again.dropDuplicates(["page_id", "_key"]).drop("_key"))
    seen = materialize(known.select("page_id", "page_key").join(ids, "page_id", "left_semi"))
    facts = PG.page_facts(pages)
    return facts if seen.isEmpty() else facts.join(seen, ["page_id", "page_key"], "left_anti")


def refresh(spark: SparkSession, base: str, epoch: int, pages: DataFrame, targets: DataFrame, search: DataFrame | None = None,
            ai_contacts: DataFrame | None = None, ai_decisions: DataFrame | None = None, search_hits: int = P.SEARCH_HITS, **options) -> None:
    """One epoch: ``pages`` arrive, ``targets`` (input_pos, raw) are all targets so
    far. Writes the epoch's facts and the sites it recomputes. A page that has
    come before, by page_id and key, changes nothing; without any that is asked
    for, and without new targets, nothing is recomputed. The other tables and
    ``options`` are those of ``gather.build`` and stay the same over the epochs."""
    epochs.write(new_facts(pages, _facts(spark, base, epoch)), os.path.join(base, "facts"), epoch)
    facts = _facts(spark, base, epoch + 1)
    new = S.page_candidates(facts.filter(F.col("epoch") == epoch), ("page_id", "page_key"))
    epochs.write(new, os.path.join(base, "cands"), epoch)
    cands = epochs.read(spark, os.path.join(base, "cands"), CANDS_SCHEMA, epoch + 1).drop("epoch")

    before = site_log(spark, base, epoch)
    keys = facts.filter(F.col("epoch") == epoch).select("page_key").distinct()
    touched = before.select("url", F.explode("asks").alias("page_key")).join(keys, "page_key", "left_semi").select("url")
    unmet = S.prepare_targets(targets).select("url").join(before.select("url"), "url", "left_anti")
    due = materialize(touched.unionByName(unmet).distinct())
    if due.isEmpty():
        rows = spark.createDataFrame([], SITES_SCHEMA)
    else:
        stages = G.build(due.select(F.lit(0).alias("input_pos"), F.col("url").alias("raw")), facts.drop("epoch"), search, ai_contacts,
                         ai_decisions, search_hits=search_hits, prune=True, parsed=True, page_cands=cands, **options)
        rows = site_rows(stages, search)
    epochs.write(rows, os.path.join(base, "sites"), epoch)


def run_contact_stream(spark: SparkSession, folder: str, base: str, targets: DataFrame, search: DataFrame | None = None,
                       ai_contacts: DataFrame | None = None, ai_decisions: DataFrame | None = None,
                       source: dict | None = None, **options) -> DataFrame:
    """Feeds the page files of ``folder`` that haven't been read yet through
    ``refresh`` (availableNow), and returns the contact table. ``base`` names a
    folder that all executors share; ``source`` are options of the file source."""
    query = (page_feed(spark, folder, **(source or {})).writeStream
             .foreachBatch(lambda batch, epoch: refresh(spark, base, epoch, batch, targets, search, ai_contacts, ai_decisions, **options))
             .option("checkpointLocation", os.path.join(base, "_state")).trigger(availableNow=True).start())
    query.awaitTermination()
    return contact_table(spark, base)
