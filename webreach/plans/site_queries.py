"""Registered queries over the synthetic sites (build steps 4-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webreach.functions import extract as X
from webreach.functions import patterns as P
from webreach.functions import quality as Q
from webreach.operators import deny as DN
from webreach.operators import enrich as EN
from webreach.operators import fallback as FB
from webreach.operators import gather as G
from webreach.operators import jsonld as J
from webreach.plans import duck as D
from webreach.plans import duck_enrich as DE
from webreach.plans.duck_sites import pipeline_sql
from webreach.plans.registry import register
from webreach.sources.tables import state, synthetic

_STAGES: dict = {}


def stages(spark, sf) -> G.Stages:
    """The site pipeline for ``sf``, once for a session and state of the files it
    reads: a query has the relations made that it asks for, and later queries
    start from their written tables."""
    key = (spark.sparkContext.applicationId, sf, state(spark, sf, "customer", "pages"))
    if key not in _STAGES:
        T = synthetic(spark, sf)
        st = G.build(T["syn_targets"], T["syn_pages"], T["search_results"], T["ai_contacts"], T["ai_decisions"])
        st.tables = T
        _STAGES.clear()
        _STAGES[key] = st
    return _STAGES[key]


def _joined(c):
    return F.array_join(F.array_sort(c), ", ")


def _djoined(c):
    return f"array_to_string(list_sort({c}), ', ')"


# ------------------------------------------------------------------ step 3-4: page channels


@register("facebook_links", pipeline_sql("SELECT page_id, fb_href FROM facts WHERE fb_href IS NOT NULL"))
def facebook_links(spark, sf):
    """O-C8 + O-H1: first Facebook link of each page."""
    f = stages(spark, sf).facts
    return f.filter(F.col("fb_href").isNotNull()).select("page_id", "fb_href")


def _channel_query(channel_names, col_name):
    def q(spark, sf):
        c = stages(spark, sf).cands
        return c.filter(F.col("channel").isin(*channel_names)).select("page_key", F.col("value").alias(col_name))
    return q


register("cf_emails", pipeline_sql("SELECT page_key, value AS email FROM cands WHERE channel = 'cf_email'"))(
    _channel_query(["cf_email"], "email"))
register("mailto_emails", pipeline_sql("SELECT page_key, value AS email FROM cands WHERE channel = 'mailto_email'"))(
    _channel_query(["mailto_email"], "email"))


@register("jsonld_contacts", pipeline_sql("SELECT DISTINCT page_key, channel, value FROM ld_walk"))
def jsonld_contacts(spark, sf):
    """O-C5 + O-D7: e-mails and phones found by walking JSON-LD blocks."""
    f = stages(spark, sf).facts
    blocks = f.select("page_key", F.explode("ld_blocks").alias("body")).filter(J.parse_block(F.col("body")).isNotNull())
    return J.jsonld_contacts(blocks, ("page_key",))


@register("jsonld_fallback", pipeline_sql("SELECT DISTINCT page_key, value AS email FROM ld_fallback"))
def jsonld_fallback(spark, sf):
    """O-D8: e-mail regex over JSON-LD blocks that do not parse."""
    f = stages(spark, sf).facts
    blocks = f.select("page_key", F.explode("ld_blocks").alias("body")).filter(J.parse_block(F.col("body")).isNull())
    return J.jsonld_contacts(blocks, ("page_key",)).select("page_key", F.col("value").alias("email"))


@register("contact_links", pipeline_sql("SELECT url, link_key, CAST(link_pos AS BIGINT) AS link_pos FROM clinks"))
def contact_links(spark, sf):
    """O-D9: contact-page links of each landing page, first position per key."""
    return stages(spark, sf).links.select("url", "link_key", F.col("link_pos").cast("bigint").alias("link_pos"))


# ------------------------------------------------------------------ step 5: site assembly


@register("site_landing", pipeline_sql("SELECT url, site_key, landing_id, website, title FROM land"))
def site_landing(spark, sf):
    """O-F1 / O-A4: every target site and its landing page, if any."""
    return stages(spark, sf).landing.select("url", "site_key", "landing_id", "website", "title")


@register("contact_subpages", pipeline_sql(
    "SELECT url, link_key, CAST(link_pos AS BIGINT) AS link_pos, sub_id, sub_url FROM subs"))
def contact_subpages(spark, sf):
    """O-F2: contact links that resolve to a crawled page."""
    return stages(spark, sf).subpages.select("url", "link_key", F.col("link_pos").cast("bigint").alias("link_pos"),
                                             "sub_id", "sub_url")


@register("primary_page", pipeline_sql("SELECT url, website, primary_url, primary_text FROM primary_page"))
def primary_page(spark, sf):
    """O-H2 + O-D13: page whose first 5000 text chars feed the extractor."""
    return stages(spark, sf).primary.select("url", "website", "primary_url", "primary_text")


@register("site_candidates", pipeline_sql("SELECT url, role, kind, channel, value FROM site_cands"))
def site_candidates(spark, sf):
    """O-G2 / O-I1 / O-I4: candidates of each site from all its pages and channels."""
    return stages(spark, sf).site_cands


# ------------------------------------------------------------------ step 6: quality


@register("ai_parsed", pipeline_sql(
    f"SELECT url, {_djoined('ai_emails')} AS ai_emails, {_djoined('ai_phones')} AS ai_phones, ai_summary FROM ai"))
def ai_parsed(spark, sf):
    """O-D12: external extraction replies parsed (first '{' to last '}')."""
    a = stages(spark, sf).ai
    return a.select("url", _joined("ai_emails").alias("ai_emails"), _joined("ai_phones").alias("ai_phones"),
                    "ai_summary")


@register("ai_kept", pipeline_sql("SELECT url, kind, value FROM kept"))
def ai_kept(spark, sf):
    """O-E3 + O-F9 + O-F10 + O-I1: candidates that survive the keep-list."""
    return stages(spark, sf).kept


@register("plausible_emails", pipeline_sql(
    f"SELECT url, value, {Q.duck_plausible_email('value')} AS plausible FROM (SELECT DISTINCT url, value FROM site_cands WHERE kind = 'email')"))
def plausible_emails(spark, sf):
    """O-E1: deterministic plausibility of every e-mail candidate."""
    c = stages(spark, sf).site_cands.filter(F.col("kind") == "email").select("url", "value").distinct()
    return c.select("url", "value", Q.plausible_email("value").alias("plausible"))


@register("email_deny_rules", pipeline_sql(f"""
, rules AS (SELECT 'domain' AS kind, ltrim(unnest({D.str_list(P.DENY_EMAIL_DOMAINS + P.DENY_EMAIL_SUFFIXES)}), '.') AS text
  UNION ALL SELECT 'mailbox', unnest({D.str_list(P.DENY_EMAIL_MAILBOXES)})),
given AS (SELECT DISTINCT url, value, {D.strip('value')} AS v FROM site_cands WHERE kind = 'email'),
parts AS (SELECT *, reverse(split_part(reverse(lower(v)), '@', 1)) AS domain, split_part(lower(v), '@', 1) AS mailbox FROM given),
nearest AS (SELECT p.domain, arg_max(r.text, length(r.text)) AS above FROM (SELECT DISTINCT domain FROM parts) p
  JOIN rules r ON r.kind = 'domain' AND ends_with('.' || p.domain, '.' || r.text) GROUP BY p.domain)
SELECT p.url, p.value, coalesce('domain:' || n.above, 'mailbox:' || m.text) AS rule
FROM parts p LEFT JOIN nearest n ON n.domain = p.domain LEFT JOIN rules m ON m.kind = 'mailbox' AND m.text = p.mailbox"""))
def email_deny_rules(spark, sf):
    """O-E1: every e-mail candidate with the rule of the rule table that denies it."""
    c = stages(spark, sf).site_cands.filter(F.col("kind") == "email").select("url", "value").distinct()
    return DN.judged(c, DN.default_rules(spark)).select("url", "value", "rule")


@register("plausible_phones", pipeline_sql(
    f"SELECT url, value, {Q.duck_plausible_phone('value')} AS plausible FROM (SELECT DISTINCT url, value FROM site_cands WHERE kind = 'phone')"))
def plausible_phones(spark, sf):
    """O-E2: deterministic plausibility of every phone candidate."""
    c = stages(spark, sf).site_cands.filter(F.col("kind") == "phone").select("url", "value").distinct()
    return c.select("url", "value", Q.plausible_phone("value").alias("plausible"))


# ------------------------------------------------------------------ step 7: fallbacks


def _stage_query(stage):
    def q(spark, sf):
        s = stages(spark, sf).chain[stage]
        return s.select("url", _joined("phones").alias("phones"), _joined("emails").alias("emails"))
    q.__doc__ = f"O-K2 stage '{stage}': sites whose phone comes from this stage."
    return q


for _stage in FB.STAGE_ORDER:
    register(f"fallback_{_stage}", pipeline_sql(
        f"SELECT url, {_djoined('phones')} AS phones, {_djoined('emails')} AS emails FROM chain WHERE stage = '{_stage}'"))(
        _stage_query(_stage))


@register("fallback_unsolved", pipeline_sql("SELECT url FROM solved WHERE stage IS NULL"))
def fallback_unsolved(spark, sf):
    """O-K2: sites still without a phone after every stage."""
    return stages(spark, sf).chain["unsolved"]


@register("fallback_snippets", pipeline_sql(
    f"SELECT url, website, {_djoined('emails')} AS emails, {_djoined('phones')} AS phones, summary FROM snippets"))
def fallback_snippets(spark, sf):
    """O-F7 + O-D10 + O-E4: contacts from search snippets of unreachable sites."""
    s = stages(spark, sf).snippets
    return s.select("url", "website", _joined("emails").alias("emails"), _joined("phones").alias("phones"), "summary")


@register("topk_hits", pipeline_sql(f"""
SELECT query, CAST(rank AS BIGINT) AS rank, href FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, href) AS n FROM search_results) WHERE n <= {P.SEARCH_HITS}"""))
def topk_hits(spark, sf):
    """O-H4: the first 5 hits of every search query."""
    s = stages(spark, sf).tables["search_results"]
    return FB.top_hits(s, P.SEARCH_HITS).select("query", F.col("rank").cast("bigint").alias("rank"), "href")


# ------------------------------------------------------------------ step 8: finish


@register("site_contacts", pipeline_sql(f"""
SELECT t.input_pos, c.website, {_djoined('c.emails')} AS email, {_djoined('c.phones')} AS phone, c.summary
FROM targets t JOIN contacts c ON c.url = t.url"""))
def site_contacts(spark, sf):
    """O-K1 flagship: one contact record per input row whose site yields one."""
    st = stages(spark, sf)
    return (st.targets.join(st.contacts, "url")
            .select("input_pos", "website", _joined("emails").alias("email"), _joined("phones").alias("phone"),
                    "summary"))


@register("phone_normalized", pipeline_sql(f"""
SELECT url, phone, {D.normalize_phone('phone')} AS normalized FROM (SELECT url, unnest(phones) AS phone FROM contacts)"""))
def phone_normalized(spark, sf):
    """O-J1: the fixed phone spelling rules on every final phone."""
    c = stages(spark, sf).contacts.select("url", F.explode("phones").alias("phone"))
    return c.select("url", "phone", X.normalize_phone("phone").alias("normalized"))


@register("phone_dedup", pipeline_sql(f"""
SELECT url, array_to_string(list_sort(list(p)), ', ') AS phones FROM (
  SELECT url, min(n) AS p FROM (
    SELECT url, {D.normalize_phone('phone')} AS n FROM (SELECT url, unnest(phones) AS phone FROM contacts))
  WHERE {D.digits_only('n')} <> '' GROUP BY url, {D.digits_only('n')})
GROUP BY url"""))
def phone_dedup(spark, sf):
    """O-G3 + O-H5: normalise, one spelling per digit string, sorted."""
    c = stages(spark, sf).contacts.filter(F.size("phones") > 0)
    return c.select("url", F.array_join(G.dedup_phones(F.col("phones")), ", ").alias("phones"))


# ------------------------------------------------------------------ step 9: enrich and export


@register("contact_lookup", pipeline_sql(DE.DUCK_LOOKUP))
def contact_lookup(spark, sf):
    """O-G5: three lookup keys per URL, the later input wins."""
    st = stages(spark, sf)
    lk = EN.contact_lookup(st.targets, st.contacts)
    return lk.select("lookup_key", "found", "website", F.array_join("emails", ", ").alias("emails"),
                     F.array_join("phones", ", ").alias("phones"), "summary")


@register("enriched_rows", pipeline_sql(DE.DUCK_ENRICHED_ROWS))
def enriched_rows(spark, sf):
    """O-K3 / O-A7 / O-F8: every input row plus Email, Phone, AI Summary."""
    st = stages(spark, sf)
    return EN.enrich_rows(st.tables["syn_targets"], "raw", st.targets, st.contacts)


@register("enriched_urls", pipeline_sql(DE.DUCK_ENRICHED_URLS))
def enriched_urls(spark, sf):
    """O-K4: distinct valid URLs (first seen) with website, email, phone, summary."""
    st = stages(spark, sf)
    return EN.enrich_urls(st.targets, st.contacts)


@register("export_rows", pipeline_sql(DE.DUCK_EXPORT))
def export_rows(spark, sf):
    """O-K5 / O-A6 / O-J3: batch export rows (phones deduped, empty -> 'None')."""
    st = stages(spark, sf)
    return EN.export_rows(st.targets, st.contacts)


# ------------------------------------------------------------------ step 10: audit


@register("coverage_audit", pipeline_sql(DE.DUCK_AUDIT))
def coverage_audit(spark, sf):
    """O-G7: per site and source, how many values were found."""
    return EN.coverage(stages(spark, sf))


@register("coverage_rollup", pipeline_sql(DE.DUCK_ROLLUP))
def coverage_rollup(spark, sf):
    """O-G7 totals: rollup over (source, kind)."""
    return EN.coverage_rollup(stages(spark, sf))


@register("run_counts", pipeline_sql(DE.DUCK_COUNTS))
def run_counts(spark, sf):
    """O-G6: results, e-mails and phones of the run."""
    return EN.run_counts(stages(spark, sf))
