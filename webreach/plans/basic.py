"""Registered queries over the crawled ``pages`` and ``documents`` tables
(build steps 1-3): extraction, URL functions, page relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from webreach.functions import extract as X
from webreach.functions import html as H
from webreach.functions import patterns as P
from webreach.functions import urls as U
from webreach.operators import pages as PG
from webreach.plans import duck as D
from webreach.plans.registry import register
from webreach.sources.tables import table

# ------------------------------------------------------------------ step 1


def _text_candidates(text_col):
    return F.concat(
        F.transform(X.emails(text_col), lambda v: U.nstruct(kind=F.lit("email"), value=v)),
        F.transform(X.phones(text_col), lambda v: U.nstruct(kind=F.lit("phone"), value=v)))


@register("page_contacts", f"""
WITH t AS (SELECT page_id, {D.page_text('html')} AS text FROM pages)
SELECT page_id, 'email' AS kind, unnest({D.emails('text')}) AS value FROM t
UNION ALL
SELECT page_id, 'phone' AS kind, unnest({D.phones('text')}) AS value FROM t
""")
def page_contacts(spark, sf):
    """O-C1 -> O-D1/O-D2/O-D3: e-mail and phone candidates in each page's text."""
    t = table(spark, sf, "pages").select("page_id", H.page_text("html").alias("text"))
    return (t.select("page_id", F.explode(_text_candidates(F.col("text"))).alias("c"))
            .select("page_id", "c.kind", "c.value"))


@register("document_emails", f"""
SELECT doc_id, unnest({D.emails('text')}) AS email FROM documents
""")
def document_emails(spark, sf):
    """O-D1 over whole documents."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.explode(X.emails("text")).alias("email"))


@register("document_phones", f"""
SELECT doc_id, unnest({D.phones('text')}) AS phone FROM documents
""")
def document_phones(spark, sf):
    """O-D2 + O-D3 over whole documents."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.explode(X.phones("text")).alias("phone"))


@register("document_contacts_deduped", f"""
SELECT doc_id, {D.strip('v')} AS value, kind FROM (
  SELECT doc_id, 'email' AS kind, unnest({D.emails('text')}) AS v FROM documents
  UNION ALL SELECT doc_id, 'phone' AS kind, unnest({D.phones('text')}) AS v FROM documents) x
WHERE {D.strip('v')} <> ''
GROUP BY ALL
""")
def document_contacts_deduped(spark, sf):
    """O-G1 remove_duplicates: strip, drop empty, one row per value."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(_text_candidates(F.col("text"))).alias("c"))
    return (d.select("doc_id", U.py_strip("c.value").alias("value"), F.col("c.kind").alias("kind"))
            .filter(F.col("value") != "").distinct())


# ------------------------------------------------------------------ step 2


@register("clean_urls", f"""
SELECT page_id, url, {D.clean_url('url')} AS clean_url, {D.page_key('url')} AS page_key FROM pages
""")
def clean_urls(spark, sf):
    """O-B3 (and the page lookup key)."""
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", "url", U.clean_url("url").alias("clean_url"), U.page_key("url").alias("page_key"))


_RAW_URLS = """
SELECT page_id AS input_pos, url AS raw FROM pages
UNION ALL SELECT -page_id - 1, regexp_replace(url, '^https?://', '') FROM pages
UNION ALL SELECT -page_id - 100000000, '  ' || upper(substr(url, 1, 4)) || substr(url, 5) FROM pages
"""


def _raw_urls(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return (p.select(F.col("page_id").alias("input_pos"), F.col("url").alias("raw"))
            .unionByName(p.select((-F.col("page_id") - 1).alias("input_pos"),
                                  F.regexp_replace("url", "^https?://", "").alias("raw")))
            .unionByName(p.select((-F.col("page_id") - 100000000).alias("input_pos"),
                                  F.concat(F.lit("  "), F.upper(F.substring("url", 1, 4)),
                                           F.substr("url", F.lit(5))).alias("raw"))))


@register("valid_urls", f"""
WITH r AS ({_RAW_URLS})
SELECT input_pos, raw, {D.normalize_url('raw')} AS url, {D.is_valid_url(D.normalize_url('raw'))} AS is_valid FROM r
""")
def valid_urls(spark, sf):
    """O-B1 + O-B2 on page URLs, scheme-less and upper-case-scheme variants."""
    r = _raw_urls(spark, sf).withColumn("url", U.normalize_url("raw"))
    return r.select("input_pos", "raw", "url", U.is_valid_url("url").alias("is_valid"))


@register("url_first_seen", f"""
WITH r AS ({_RAW_URLS}),
n AS (SELECT input_pos, {D.normalize_url('raw')} AS url FROM r)
SELECT url, min(input_pos) AS input_pos FROM n WHERE {D.is_valid_url('url')} GROUP BY url
""")
def url_first_seen(spark, sf):
    """O-G4: valid normalized URLs, earliest input position wins."""
    r = _raw_urls(spark, sf).withColumn("url", U.normalize_url("raw")).filter(U.is_valid_url("url"))
    return r.groupBy("url").agg(F.min("input_pos").alias("input_pos"))


@register("url_domain", f"""
SELECT page_id, {D.url_domain('url')} AS domain FROM pages
""")
def url_domain(spark, sf):
    """O-B4."""
    return table(spark, sf, "pages").select("page_id", U.url_domain("url").alias("domain"))


@register("display_urls", f"""
SELECT page_id, {D.display_url(D.clean_url('url'))} AS display FROM pages
""")
def display_urls(spark, sf):
    """O-B7 on cleaned page URLs."""
    return table(spark, sf, "pages").select("page_id", U.display_url(U.clean_url("url")).alias("display"))


@register("search_keys", f"""
WITH t AS (SELECT page_id, {D.page_title('html')} AS company, {D.url_domain('url')} AS domain FROM pages)
SELECT page_id,
  company || {D.lit(P.MAPS_QUERY_SUFFIX)} AS maps_query,
  company || {D.lit(P.YELP_QUERY_SUFFIX)} AS yelp_query,
  company || {D.lit(P.WEB_QUERY_SUFFIX)} AS web_query,
  domain || {D.lit(P.SNIPPET_QUERY_SUFFIX)} AS snippet_query
FROM t
""")
def search_keys(spark, sf):
    """O-B9: the four search keys of every page."""
    t = table(spark, sf, "pages").select("page_id", H.page_title("html").alias("company"),
                                         U.url_domain("url").alias("domain"))
    return t.select("page_id",
                    U.search_key(F.col("company"), P.MAPS_QUERY_SUFFIX).alias("maps_query"),
                    U.search_key(F.col("company"), P.YELP_QUERY_SUFFIX).alias("yelp_query"),
                    U.search_key(F.col("company"), P.WEB_QUERY_SUFFIX).alias("web_query"),
                    U.search_key(F.col("domain"), P.SNIPPET_QUERY_SUFFIX).alias("snippet_query"))


# ------------------------------------------------------------------ step 3


@register("page_text", f"""
SELECT page_id, {D.page_text('html')} AS text FROM pages
""")
def page_text(spark, sf):
    """O-C1: separator text of every page."""
    return table(spark, sf, "pages").select("page_id", H.page_text("html").alias("text"))


@register("page_text_nosep", f"""
SELECT page_id, {D.page_text_nosep('html')} AS text FROM pages
""")
def page_text_nosep(spark, sf):
    """O-C2."""
    return table(spark, sf, "pages").select("page_id", H.page_text_nosep("html").alias("text"))


@register("page_titles", f"""
SELECT page_id, {D.page_title('html')} AS title FROM pages
""")
def page_titles(spark, sf):
    """O-C3."""
    return table(spark, sf, "pages").select("page_id", H.page_title("html").alias("title"))


@register("page_links", f"""
WITH a AS (SELECT page_id, unnest({D.anchors('html')}) AS l FROM pages)
SELECT page_id, CAST(l.pos AS BIGINT) AS pos, l.href AS href, l.text AS anchor_text FROM a
""")
def page_links(spark, sf):
    """O-C4: usable anchors of every page, in document order."""
    a = table(spark, sf, "pages").select("page_id", F.explode(PG.anchors(F.col("html"))).alias("l"))
    return a.select("page_id", F.col("l.pos").cast("bigint").alias("pos"), F.col("l.href").alias("href"),
                    F.col("l.text").alias("anchor_text"))


@register("resolved_links", f"""
WITH a AS (SELECT page_id, {D.clean_url('url')} AS base, unnest({D.anchors('html')}) AS l FROM pages),
r AS (SELECT page_id, CAST(l.pos AS BIGINT) AS pos, {D.resolve_link('base', 'l.href')} AS abs_url FROM a)
SELECT page_id, pos, abs_url, {D.strip_key('abs_url')} AS link_key FROM r
""")
def resolved_links(spark, sf):
    """O-B5 + O-B6: every anchor resolved against its page's cleaned URL."""
    a = table(spark, sf, "pages").select("page_id", U.clean_url("url").alias("base"),
                                         F.explode(PG.anchors(F.col("html"))).alias("l"))
    r = a.select("page_id", F.col("l.pos").cast("bigint").alias("pos"),
                 U.resolve_link(F.col("base"), F.col("l.href")).alias("abs_url"))
    return r.withColumn("link_key", U.strip_key("abs_url"))
