"""Site assembly: targets, landing pages, contact sub-pages, candidates.

O-A4, O-F1, O-F2, O-D9, O-H2, O-D13, O-G2, O-G4, O-I1..O-I4.

All joins are equi-joins on ``page_key`` against the narrow page facts, so
the wide ``html`` column never enters a shuffle. Sizes are left to AQE: a
side is broadcast only when its runtime size is under the broadcast
threshold, otherwise it is a shuffle join (skew split by AQE).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webreach.functions import patterns as P
from webreach.functions import urls as U
from webreach.operators import jsonld as J

# channels per page that count as page candidates in the main stage
MAIN_EMAIL_CHANNELS = ("text_email", "cf_email", "mailto_email", "ld_email")
MAIN_PHONE_CHANNELS = ("text_phone", "ld_phone")


def prepare_targets(df: DataFrame, raw_col: str = "raw", pos_col: str = "input_pos") -> DataFrame:
    """O-B1 + O-B2: (input_pos, raw, url) for valid URLs, duplicates kept."""
    return (df.select(F.col(pos_col).alias("input_pos"), F.col(raw_col).alias("raw"),
                      U.normalize_url(raw_col).alias("url"))
            .filter(U.is_valid_url("url")))


def sites(targets: DataFrame) -> DataFrame:
    """Distinct URLs to work on, with their lookup key."""
    return targets.select("url").distinct().withColumn("site_key", U.page_key("url"))


def landing(site_df: DataFrame, facts: DataFrame) -> DataFrame:
    """O-F1 / O-A4: left join sites to their landing page."""
    f = facts.select(F.col("page_key").alias("site_key"), F.col("page_id").alias("landing_id"),
                     F.col("canonical_url").alias("website"), "title", "links", "fb_href",
                     F.col("text5000").alias("landing_text"))
    return site_df.join(f, "site_key", "left")


def contact_links(land: DataFrame) -> DataFrame:
    """O-D9: contact-page candidates of each landing page, first position per key."""
    links = (land.filter(F.col("landing_id").isNotNull())
             .select("url", "website", F.explode("links").alias("l"))
             .select("url", "website", "l.pos", "l.href", "l.text"))
    hit = links.filter(F.col("href").rlike(P.CONTACT_HREF) | F.col("text").rlike(P.CONTACT_TEXT))
    # an outer generator makes each key once; as a plain column it would be made
    # again by every filter on it
    keys = hit.select("url", "website", "pos", F.array(U.strip_key(U.resolve_link("website", "href"))).alias("keys"))
    keyed = keys.select("url", "website", "pos", F.explode_outer("keys").alias("link_key"))
    base = F.regexp_replace("website", r"/+\z", "")
    keyed = keyed.filter((F.col("link_key") != "") & (F.col("link_key") != base))
    return keyed.groupBy("url", "link_key").agg(F.min("pos").alias("link_pos"))


def contact_subpages(links: DataFrame, facts: DataFrame) -> DataFrame:
    """O-F2: contact links that resolve to a page; misses are skipped."""
    f = facts.select(F.col("page_key").alias("sub_key"), F.col("page_id").alias("sub_id"),
                     F.col("canonical_url").alias("sub_url"), "text5000")
    return (links.filter(F.col("link_key").isNotNull()).withColumn("sub_key", U.join_key("link_key"))
            .join(f, "sub_key", "inner")
            .select("url", "link_key", "link_pos", "sub_id", "sub_url", "text5000"))


def primary_page(land: DataFrame, subs: DataFrame) -> DataFrame:
    """O-H2 + O-D13: the page whose text feeds the external extractor.

    First existing contact page (link order) whose cleaned URL differs from
    the landing URL; else the landing page. Returns (url, primary_url,
    primary_text) with the text cut to 5000 chars.
    """
    land_ok = land.filter(F.col("landing_id").isNotNull()).select("url", "website", "landing_text")
    s = subs.join(land_ok.select("url", "website"), "url")
    differing = (s.filter(F.col("sub_url") != F.col("website"))
                 .groupBy("url").agg(F.min_by(F.struct("sub_url", "text5000"), "link_pos").alias("d")))
    any_sub = s.groupBy("url").agg(F.max_by("text5000", "link_pos").alias("last_text"))
    out = land_ok.join(differing, "url", "left").join(any_sub, "url", "left")
    return out.select(
        "url", "website",
        F.coalesce(F.col("d.sub_url"), F.col("website")).alias("primary_url"),
        F.coalesce(F.col("d.text5000"), F.col("last_text"), F.col("landing_text")).alias("primary_text"))


def page_candidates(facts: DataFrame, keys: tuple = ("page_key",)) -> DataFrame:
    """(keys..., channel, value) for every channel of every page, incl. JSON-LD."""
    flat = (facts.select(*keys, F.explode("cands").alias("c"))
            .select(*keys, "c.channel", "c.value"))
    blocks = facts.select(*keys, F.explode("ld_blocks").alias("body"))
    return flat.unionByName(J.jsonld_contacts(blocks, keys))


def site_pages(land: DataFrame, subs: DataFrame) -> DataFrame:
    """(url, page_key, role): the landing page and every existing contact page."""
    lp = (land.filter(F.col("landing_id").isNotNull())
          .select("url", F.col("site_key").alias("page_key"), F.lit("landing").alias("role")))
    sp = subs.select("url", U.page_key("link_key").alias("page_key"), F.lit("contact").alias("role"))
    return lp.unionByName(sp).distinct()


def site_candidates(spages: DataFrame, cands: DataFrame) -> DataFrame:
    """O-G2 / O-I1: (url, role, kind, channel, value) from landing + contact pages.

    ``kind`` is 'email' or 'phone'. Distinct, so the per-site union is a set.
    """
    main = cands.filter(F.col("channel").isin(*(MAIN_EMAIL_CHANNELS + MAIN_PHONE_CHANNELS)))
    j = spages.join(main, "page_key")
    kind = F.when(F.col("channel").isin(*MAIN_EMAIL_CHANNELS), "email").otherwise("phone")
    return j.select("url", "role", kind.alias("kind"), "channel", "value").distinct()
