"""JSON-LD contacts (O-D7, O-D8).

Blocks are parsed to VARIANT once. The walk is a chain of
``LATERAL variant_explode_outer`` steps over one frontier relation: rows that
already hold a captured value ride along unchanged (their variant is null, so
the outer explode yields them once), container children become the next
frontier. ``LEVELS`` levels are one linear plan; while any row still holds a
variant after them, the walk goes on from the written frontier, to any depth.

Capture rule at every object key, any depth: key 'email'/'e-mail' (any case)
with a string value containing '@' -> email; key 'telephone'/'phone'/
'faxnumber' with a string value -> phone; anything else is walked into.
Array items carry no key, so list-valued e-mails are not captured.
The bare numbers NaN, Infinity and -Infinity, which the original's parser
accepts, count as null. Blocks that do not parse fall back to the e-mail regex
over the raw text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webreach.functions import extract as X
from webreach.functions import patterns as P
from webreach.session import materialize

# Levels walked in one plan.
LEVELS = 12
# A bare number that strict JSON lacks, where a value may stand.
BARE_NUMBER = r"([:\[,]\s*)(?:NaN|-?Infinity)(\s*[,}\]])"


def parse_block(body):
    """A block as VARIANT, null if it is no JSON."""
    # neighbours in a list share a comma, hence twice
    fixed = F.regexp_replace(F.regexp_replace(body, BARE_NUMBER, "$1null$2"), BARE_NUMBER, "$1null$2")
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(fixed))


def _in(col: str, values) -> str:
    return f"lower({col}) IN (" + ", ".join(f"'{v}'" for v in values) + ")"


def jsonld_contacts(blocks: DataFrame, key_cols=("page_key",)) -> DataFrame:
    """blocks(key_cols..., body) -> (key_cols..., channel, value), distinct."""
    spark = blocks.sparkSession
    keys = list(key_cols)
    parsed = blocks.select(*keys, "body", parse_block(F.col("body")).alias("v"))

    fallback = (parsed.filter(F.col("v").isNull())
                .select(*keys, F.explode(X.emails("body")).alias("value"))
                .select(*keys, F.lit("ld_email").alias("channel"), "value"))

    # blocks that do not parse hold nothing to walk into and go with the first step;
    # a filter on them would parse every block twice
    frontier = parsed.select(
        *keys, F.lit(None).cast("string").alias("channel"),
        F.lit(None).cast("string").alias("value"), "v")
    kcols = ", ".join(f"t.{k}" for k in keys)
    is_str = "schema_of_variant(e.value) = 'STRING'"
    sval = "variant_get(e.value, '$', 'string')"
    email_hit = f"({_in('e.key', P.JSONLD_EMAIL_KEYS)} AND {is_str} AND instr({sval}, '@') > 0)"
    phone_hit = f"({_in('e.key', P.JSONLD_PHONE_KEYS)} AND {is_str})"

    def step(source: str) -> str:
        return f"""
        SELECT {kcols},
          CASE WHEN t.channel IS NOT NULL THEN t.channel
               WHEN {email_hit} THEN 'ld_email'
               WHEN {phone_hit} THEN 'ld_phone' END AS channel,
          CASE WHEN t.channel IS NOT NULL THEN t.value
               WHEN {email_hit} OR {phone_hit} THEN {sval} END AS value,
          CASE WHEN t.channel IS NULL AND NOT ({email_hit} OR {phone_hit}) THEN e.value END AS v
        FROM {source} t, LATERAL variant_explode_outer(t.v) e
        WHERE t.channel IS NOT NULL OR e.pos IS NOT NULL"""

    def walk(frontier: DataFrame) -> DataFrame:
        sql = "{frontier}"
        for _ in range(LEVELS):
            sql = "(" + step(sql) + ")"
        return spark.sql("SELECT * FROM " + sql + " w", frontier=frontier)

    held = fallback
    while True:
        walked = materialize(walk(frontier))
        held = held.unionByName(walked.filter(F.col("channel").isNotNull()).select(
            *keys, "channel", F.regexp_replace("value", r"^[" + P.WS + r"]+|[" + P.WS + r"]+\z", "").alias("value")))
        frontier = walked.filter(F.col("v").isNotNull())
        if frontier.isEmpty():
            return held.distinct()
