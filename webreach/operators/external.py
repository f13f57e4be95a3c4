"""External extraction results and keep-lists (O-D12, O-F9, O-E3, O-F10).

Model calls are not made here: their replies arrive as tables
``ai_contacts(url, raw)`` and ``ai_decisions(site, raw)``. The reply text is
parsed with strict JSON (``try_parse_json``) after cutting it to the span
from the first '{' to the last '}'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webreach.functions import extract as X
from webreach.functions.urls import nstruct, py_strip

OBJECT_SPAN = r"(?s)\{.*\}"


def _reply_json(raw):
    span = F.regexp_extract(raw, OBJECT_SPAN, 0)
    return F.when(span != "", F.try_parse_json(span))


def _clean_list(v, path: str):
    arr = F.try_variant_get(v, path, "array<string>")
    return X.strip_distinct(arr)


def parse_ai_contacts(ai: DataFrame) -> DataFrame:
    """(url, ai_emails, ai_phones, ai_summary); unparsable replies give empty values."""
    v = _reply_json(F.col("raw"))
    empty = F.array().cast("array<string>")
    parsed = ai.select("url", "raw", v.alias("v"))
    ok = F.col("v").isNotNull()
    parsed = parsed.select(
        "url",
        F.when(ok, F.coalesce(_clean_list(F.col("v"), "$.emails"), empty)).otherwise(empty).alias("ai_emails"),
        F.when(ok, F.coalesce(_clean_list(F.col("v"), "$.phones"), empty)).otherwise(empty).alias("ai_phones"),
        F.when(ok, F.coalesce(F.try_variant_get("v", "$.summary", "string"), F.lit(""))).otherwise(F.lit(""))
        .alias("ai_summary"), "raw",
    )
    return _one_reply(parsed, "url", ("ai_emails", "ai_phones", "ai_summary"))


def _one_reply(parsed: DataFrame, key: str, cols: tuple) -> DataFrame:
    """Of several replies for one key, the one with the smallest text counts."""
    return (parsed.groupBy(key).agg(F.min_by(F.struct(*cols), F.coalesce("raw", F.lit(""))).alias("r"))
            .select(key, *[F.col(f"r.{c}").alias(c) for c in cols]))


def parse_decisions(dec: DataFrame) -> DataFrame:
    """(site, mode, keep_emails, keep_phones).

    An empty reply is none, so all candidates of its site are kept.
    mode 'list': a JSON object was found; a missing key (null list) keeps all
    of that kind. mode 'jsonld': no usable object, fall back to the landing
    page's JSON-LD values.
    """
    v = _reply_json(F.col("raw"))
    parsed = dec.filter(py_strip("raw") != "").select("site", "raw", v.alias("v"))
    has_key = lambda k: F.variant_get("v", f"$.{k}", "variant").isNotNull()
    replies = parsed.select(
        "site", "raw",
        F.when(F.col("v").isNotNull(), "list").otherwise("jsonld").alias("mode"),
        F.when(has_key("emails"), F.coalesce(_clean_list(F.col("v"), "$.emails"),
                                             F.array().cast("array<string>"))).alias("keep_emails"),
        F.when(has_key("phones"), F.coalesce(_clean_list(F.col("v"), "$.phones"),
                                             F.array().cast("array<string>"))).alias("keep_phones"),
    )
    return _one_reply(replies, "site", ("mode", "keep_emails", "keep_phones"))


def apply_keep_list(cand: DataFrame, decisions: DataFrame, add_listed: bool = False) -> DataFrame:
    """O-E3: cand(url, website, kind, value, is_landing_ld) -> kept (url, kind, value).

    No decision row -> all candidates; 'list' -> listed values that are
    candidates, or all of a kind whose key is missing; 'jsonld' -> the
    landing page's JSON-LD values. ``add_listed``: listed values that are no
    candidates are kept as well, as the original does.
    """
    d = decisions.withColumnRenamed("site", "website")
    j = cand.join(d, "website", "left")
    keep_list = F.when(F.col("kind") == "email", F.col("keep_emails")).otherwise(F.col("keep_phones"))
    keep = (F.when(F.col("mode").isNull(), True)
            .when(F.col("mode") == "jsonld", F.col("is_landing_ld"))
            .when(keep_list.isNull(), True)
            .otherwise(F.array_contains(keep_list, py_strip("value"))))
    kept = j.filter(keep).select("url", "kind", "value")
    if add_listed:
        def tagged(kind: str):
            values = F.coalesce(f"keep_{kind}s", F.array().cast("array<string>"))
            return F.transform(values, lambda v: nstruct(kind=F.lit(kind), value=v))

        listed = F.explode(F.concat(tagged("email"), tagged("phone")))
        kept = kept.unionByName(j.select("url", listed.alias("l")).select("url", "l.kind", "l.value"))
    return kept.distinct()
