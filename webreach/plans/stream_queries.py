"""Registered streaming queries: each runs a Structured Streaming query to
completion (availableNow) over data derived from the given tables and
returns its output, which must equal the batch result."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from webreach.plans import duck as D
from webreach.plans.duck_sites import pages_facts_sql, pipeline_sql
from webreach.plans.registry import register
from webreach.session import checkpoint_dir, materialize
from webreach.sources.tables import feed_source, synthetic, table
from webreach.streaming import contacts, feeds


@register("stream_url_list", f"""
SELECT DISTINCT {D.normalize_url('url')} AS url FROM pages
WHERE {D.normalize_url('url')} <> '' AND {D.is_valid_url(D.normalize_url('url'))}
""")
def stream_url_list(spark, sf):
    """O-L1: page URLs written as a growing URL-list folder, streamed,
    normalized, validated and deduplicated by URL."""
    base = os.path.join(checkpoint_dir(spark), f"url-list-{uuid.uuid4().hex}")
    src = os.path.join(base, "in")
    urls = table(spark, sf, "pages").select("page_id", "url")
    # two files, the second repeating part of the first: dedup state is exercised
    urls.select("url").write.mode("overwrite").text(os.path.join(src, "a"))
    urls.filter(F.col("page_id") % 2 == 0).select("url").write.mode("overwrite").text(os.path.join(src, "b"))
    out = feeds.run_url_stream(spark, os.path.join(src, "*"), base)
    return out.select("url")


@register("stream_page_candidates", pages_facts_sql("SELECT page_id, page_key, channel, value FROM page_cands", dedup=False))
def stream_page_candidates(spark, sf):
    """O-L2: the pages table as a page feed; the candidates of every page, each
    with its own page_id, equal the batch result."""
    folder, source = feed_source(spark, sf, "pages")
    out = feeds.run_page_stream(spark, folder, **source)
    return out.select("page_id", "page_key", "channel", "value")


@register("late_page_contacts", pipeline_sql("""
SELECT url, website, array_to_string(list_sort(emails), ', ') AS email, array_to_string(list_sort(phones), ', ') AS phone, summary FROM contacts"""))
def late_page_contacts(spark, sf):
    """O-L2 + O-K1: the synthetic pages arrive in two epochs; contacts after the
    second, which recomputes the touched sites only, equal the batch over all."""
    base = os.path.join(checkpoint_dir(spark), f"late-pages-{uuid.uuid4().hex}")
    T = {name: materialize(df) for name, df in synthetic(spark, sf).items()}  # a feed's tables are files
    is_late = F.pmod(F.xxhash64("url"), F.lit(16)) == 0
    for epoch, arrived in enumerate((T["syn_pages"].filter(~is_late), T["syn_pages"].filter(is_late))):
        contacts.refresh(spark, base, epoch, arrived, T["syn_targets"], T["search_results"], T["ai_contacts"], T["ai_decisions"])
    out = contacts.contact_table(spark, base)
    return out.select("url", "website", *[F.array_join(F.array_sort(c), ", ").alias(n) for c, n in (("emails", "email"), ("phones", "phone"))], "summary")
