"""Chat formatting by prefix-target expansion (native).

Every assistant turn becomes an example of its own: all turns before it are
the context and only its reply is trainable. Control strings inside texts are
escaped reversibly, so the template's marks stand for turns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.llm.common import table
from webreach.llm.registry import register

OPEN, CLOSE = "<s>", "</s>"
#: In this order when escaping, in the opposite order when reading back.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
NEWLINE = ("\n", "&#10;")  # in a role only


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in (NEWLINE, *reversed(ESCAPES)):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def examples(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, example, formatted,
    loss_start, loss_length): one row per trainable turn, in the order of turns.

    ``formatted`` is ``<s>role\\ntext</s>`` for each turn up to that reply; the
    loss mask covers ``loss_length`` code points from ``loss_start`` (from 0).
    A conversation that doesn't end with a trainable turn has one more row
    with an empty mask, so no turn is lost. Null text or role: empty. Rows of
    the same conversation and turn stand in the order of role and text; a
    null turn stands first. Rows with a null conv_id are one conversation.
    Other columns are ignored; an empty table gives no rows. A conversation
    is one row from the first grouping on, as its examples are prefixes of it.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit(NEWLINE[0]), F.lit(NEWLINE[1]))
    turns = conversations.select("conv_id", F.struct(
        F.col("turn"), role.alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE)))
    # the first turn stays at 0; ``at`` holds the 1-based numbers of the turns at which an example ends
    own = F.filter(F.sequence(F.lit(1), F.size("turns")),
                   lambda i: (F.element_at("turns", i)["role"] == trainable) | (i == F.size("turns")))
    rows = whole.select("conv_id", "turns", pieces.alias("pieces"), F.posexplode(own).alias("example", "at"))
    last = F.element_at("turns", F.col("at"))
    formatted = F.array_join(F.slice("pieces", 1, F.col("at")), "")
    length = F.when(last["role"] == trainable, F.length(last["text"])).otherwise(0)
    return (rows.select("conv_id", F.col("example").cast("long").alias("example"), formatted.alias("formatted"),
                        length.cast("long").alias("loss_length"))
            .select("conv_id", "example", "formatted",
                    (F.length("formatted") - len(CLOSE) - F.col("loss_length")).cast("long").alias("loss_start"), "loss_length"))


def read_back(formatted: DataFrame) -> DataFrame:
    """examples() -> one row per conversation: turns as ``role\\ntext\\n`` strings
    put together, the texts under the loss masks put together, and the sizes."""
    masked = unescape(F.expr("substring(formatted, int(loss_start) + 1, int(loss_length))"))
    by = formatted.select("*", masked.alias("masked")).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "masked"))), lambda x: x["masked"]), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"))
    turns = unescape(F.replace(F.replace("longest", F.lit(CLOSE), F.lit("\n")), F.lit(OPEN), F.lit("")))
    count = (F.length("longest") - F.length(F.replace("longest", F.lit(CLOSE), F.lit("")))) / len(CLOSE)
    return by.select("conv_id", count.cast("long").alias("n_turns"), turns.alias("turns"), "loss", "formatted_chars")


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
_ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
             sum(8 + length(replace({_ESC.format('role')}, chr(10), '&#10;')) + length({_ESC.format('text')})) OVER w AS upto
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""


@register("op6_chat_format", _ORACLE)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    back = read_back(examples(given.unionByName(added)))
    return back.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
