"""Enrichment, lookup, export and audit (O-G5, O-F8, O-K3, O-K4, O-K5,
O-A6, O-A7, O-J3..O-J6, O-H6, O-G6, O-G7).

``contacts`` is the per-site result of the gather pipeline:
(url, website, emails, phones, summary); a site without a record is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webreach.functions import extract as X
from webreach.functions import patterns as P
from webreach.functions import urls as U
from webreach.operators.fallback import STAGE_ORDER
from webreach.session import materialize


def contact_lookup(targets: DataFrame, contacts: DataFrame) -> DataFrame:
    """O-G5: every URL writes its record under clean_url(u), u and (if it has
    one) the record's website; URLs are processed in first-seen order and a
    later write replaces an earlier one, a missing record included."""
    urls = targets.groupBy("url").agg(F.min("input_pos").alias("pos"))
    rec = (urls.join(contacts, "url", "left").withColumn("found", F.col("website").isNotNull())
           .withColumn("clean", U.clean_url("url")))
    keys = rec.select("pos", "found", "website", "emails", "phones", "summary", F.explode(F.array(
        U.nstruct(slot=F.lit(0), key=F.col("clean")),
        U.nstruct(slot=F.lit(1), key=F.col("url")),
        F.when(F.col("found"), U.nstruct(slot=F.lit(2), key=F.col("website"))))).alias("k"))
    keys = keys.filter(F.col("k").isNotNull())
    latest = keys.groupBy(F.col("k.key").alias("lookup_key")).agg(F.max_by(
        U.nstruct(found=F.col("found"), website=F.col("website"), emails=F.col("emails"),
                  phones=F.col("phones"), summary=F.col("summary")),
        U.nstruct(pos=F.col("pos"), slot=F.col("k.slot"))).alias("c"))
    return latest.select("lookup_key", F.col("c.found").alias("found"), F.col("c.website").alias("website"),
                         F.col("c.emails").alias("emails"), F.col("c.phones").alias("phones"),
                         F.col("c.summary").alias("summary"))


def _find(df: DataFrame, lookup: DataFrame, url: Column) -> DataFrame:
    """O-F8: ``df`` with ``rec``, the record under clean_url(u), else under u.

    One join: the lookup is dealt by key once, each row asks for its one or two
    keys, and the answers come back to the row by its URL, so rows are told
    apart by nothing but their URL. Rows without a valid URL ask for nothing.
    """
    rec = lookup.filter("found").select("lookup_key", U.nstruct(
        website=F.col("website"), emails=F.col("emails"), phones=F.col("phones"), summary=F.col("summary")).alias("rec"))
    asked = df.select(url.alias("asked_url")).filter(F.col("asked_url").isNotNull()).distinct()
    keys = asked.select("asked_url", U.clean_url("asked_url").alias("clean")).select(
        "asked_url", F.posexplode(F.array_distinct(F.array("clean", "asked_url"))).alias("turn", "lookup_key"))
    answers = (keys.join(rec, "lookup_key").groupBy("asked_url").agg(F.min_by("rec", "turn").alias("rec")))
    answers = materialize(answers)
    return (df.withColumn("_url", url).join(answers, F.col("_url") == F.col("asked_url"), "left")
            .drop("_url", "asked_url"))


def with_contacts(rows: DataFrame, url: Column, targets: DataFrame, contacts: DataFrame) -> DataFrame:
    """O-K3 / O-A7: every row of ``rows`` as it is, plus email, phone, summary
    ('' when the row's URL is invalid or has no record)."""
    normal = U.normalize_url(url)
    found = _find(rows, contact_lookup(targets, contacts), F.when(U.is_valid_url(normal), normal))
    return found.select(*rows.columns,
                        F.coalesce(X.join_list(F.col("rec.emails")), F.lit("")).alias("email"),
                        F.coalesce(X.join_list(F.col("rec.phones")), F.lit("")).alias("phone"),
                        F.when(F.col("rec").isNotNull(), X.trimmed("rec.summary")).otherwise(F.lit("")).alias("summary"))


def enrich_rows(rows: DataFrame, url_col: str, targets: DataFrame, contacts: DataFrame,
                pos_col: str = "input_pos") -> DataFrame:
    """with_contacts() as (input_pos, raw, email, phone, summary)."""
    rows = rows.select(F.col(pos_col).cast("bigint").alias("input_pos"), F.col(url_col).alias("raw"))
    return with_contacts(rows, F.col("raw"), targets, contacts)


def enrich_urls(targets: DataFrame, contacts: DataFrame) -> DataFrame:
    """O-K4: distinct valid URLs in first-seen order -> website (record's or
    the URL), email, phone, summary."""
    lookup = contact_lookup(targets, contacts)
    urls = targets.groupBy("url").agg(F.min("input_pos").alias("input_pos"))
    r = _find(urls, lookup, F.col("url"))
    website = F.col("rec.website")
    return r.select("input_pos",
                    F.when(website.isNull() | (website == ""), F.col("url")).otherwise(website).alias("website"),
                    F.coalesce(X.join_list(F.col("rec.emails")), F.lit("")).alias("email"),
                    F.coalesce(X.join_list(F.col("rec.phones")), F.lit("")).alias("phone"),
                    F.coalesce(X.trimmed("rec.summary"), F.lit("")).alias("summary"))


def export_rows(targets: DataFrame, contacts: DataFrame) -> DataFrame:
    """O-K5 / O-A6: one row per valid input URL with a record (duplicates
    kept), phones normalised and deduplicated, lists joined, empty -> 'None'."""
    from webreach.operators.gather import dedup_phones
    j = targets.join(contacts, "url")
    return j.select("input_pos", "website",
                    X.join_list(F.array_sort("emails"), P.EMPTY_EXPORT).alias("email"),
                    X.join_list(dedup_phones(F.col("phones")), P.EMPTY_EXPORT).alias("phone"),
                    "summary")


def _sourced_values(st) -> DataFrame:
    """(url, source, kind, value) for every value found, by where it came from."""
    sc = st.site_cands.select("url", F.col("role").alias("source"), "kind", "value")
    ai = st.ai.select("url", F.explode(F.concat(
        F.transform("ai_emails", lambda v: U.nstruct(kind=F.lit("email"), value=v)),
        F.transform("ai_phones", lambda v: U.nstruct(kind=F.lit("phone"), value=v)))).alias("a"))
    ai = (st.primary.select("url", "primary_url").join(ai.withColumnRenamed("url", "primary_url"), "primary_url")
          .select("url", F.lit("ai").alias("source"), "a.kind", "a.value"))
    ch = st.chain["all"].select("url", "stage", F.explode(F.concat(
        F.transform("phones", lambda v: U.nstruct(kind=F.lit("phone"), value=v)),
        F.transform("emails", lambda v: U.nstruct(kind=F.lit("email"), value=v)))).alias("a"))
    ch = ch.select("url", F.col("stage").alias("source"), "a.kind", "a.value")
    sn = st.snippets.select("url", F.explode(F.concat(
        F.transform("emails", lambda v: U.nstruct(kind=F.lit("email"), value=v)),
        F.transform("phones", lambda v: U.nstruct(kind=F.lit("phone"), value=v)))).alias("a"))
    sn = sn.select("url", F.lit("snippets").alias("source"), "a.kind", "a.value")
    return sc.unionByName(ai).unionByName(ch).unionByName(sn).distinct()


def coverage(st) -> DataFrame:
    """O-G7: (url, source, kind, n) for every site x source that was tried.

    Sources tried: landing (sites with a page), contact (sites with contact
    pages), ai (sites with a primary page), each fallback stage (sites that
    needed it), snippets (unreachable sites); n = 0 means nothing found.
    """
    vals = _sourced_values(st)
    found = vals.groupBy("url", "source", "kind").agg(F.count("*").alias("n"))
    tried_land = st.landing.filter(F.col("landing_id").isNotNull()).select("url", F.lit("landing").alias("source"))
    tried_contact = st.subpages.select("url", F.lit("contact").alias("source")).distinct()
    tried_ai = st.primary.select("url", F.lit("ai").alias("source"))
    tried_snip = st.landing.filter(F.col("landing_id").isNull()).select("url", F.lit("snippets").alias("source"))
    tried = tried_land.unionByName(tried_contact).unionByName(tried_ai).unionByName(tried_snip)
    # a stage is tried when every earlier stage left the site without a phone
    solved = st.chain["all"].select("url", "stage")
    order = F.create_map(*[x for i, n in enumerate(STAGE_ORDER) for x in (F.lit(n), F.lit(i))])
    reach = (st.need.select("url").join(solved, "url", "left")
             .select("url", F.coalesce(order[F.col("stage")], F.lit(len(STAGE_ORDER) - 1)).alias("last")))
    stages = F.array(*[F.lit(n) for n in STAGE_ORDER])
    tried_stage = reach.select("url", F.explode(F.slice(stages, 1, F.col("last") + 1)).alias("source"))
    tried = tried.unionByName(tried_stage).distinct()
    kinds = tried.select("url", "source", F.explode(F.array(F.lit("email"), F.lit("phone"))).alias("kind"))
    return (kinds.join(found, ["url", "source", "kind"], "left")
            .select("url", "source", "kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def coverage_rollup(st) -> DataFrame:
    """O-G7 totals: values and sites-with-nothing per (source, kind), rolled up."""
    c = coverage(st)
    return (c.rollup("source", "kind")
            .agg(F.sum("n").cast("bigint").alias("values"),
                 F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).cast("bigint").alias("empty_sites")))


def count_columns() -> list[Column]:
    """O-G6: records, e-mails and phones, as aggregates over contacts."""
    return [F.count(F.lit(1)).alias("results"), F.sum(F.size("emails")).cast("bigint").alias("emails"),
            F.sum(F.size("phones")).cast("bigint").alias("phones")]


def run_counts(st) -> DataFrame:
    """O-G6: counts of the run, as observed by the write of its contacts; with a
    build that wrote nothing, by a pass over them."""
    if st.counts is None:
        return st.contacts.agg(*count_columns())
    return st.contacts.sparkSession.createDataFrame([st.counts], "results bigint, emails bigint, phones bigint")
