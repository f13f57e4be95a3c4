"""Line dedup by a segment-partition edit join (native).

A line that repeats an earlier line, or differs from one by at most ``edits``
characters, goes. Of two lines with so many edits, the longer one holds one of
the edits + 1 segments of the shorter one unchanged, near its place: segments
are indexed by length and place, every line probes the lengths up to its own at
the places that edits can have moved a segment to, and the lines that meet are
verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.llm.common import table, written
from webreach.llm.registry import register

#: Shorter lines go only if they equal an earlier one: two edits make another word of them.
LEAST_CHARS = 12
EDITS = 2
#: Lines to verify whose numbers are sent to every task, at 8 bytes each; with more, the texts are shuffled instead.
BROADCAST_IDS = 1_000_000
#: Indexed lines from which on a segment's lines are compared in blocks, and lines of a block.
HOT, BLOCK = 8, 64


def let(value: Column, fn) -> Column:
    """fn(value) with value computed once."""
    return F.transform(F.array(value), fn)[0]


def keys(lines: DataFrame, edits: int, asked: list[tuple[int, int, int]], name: str) -> DataFrame:
    """lines(id, line, size) -> (key, ``name``): hashes of (length, segment number,
    segment) for each (length below the line's own, segment number, move from the
    segment's place); the segments are edits + 1 nearly equal parts."""
    n = edits + 1
    # four bytes a character: a part is found without counting
    wide = lines.select("id", "size", F.encode("line", "UTF-32").alias("wide"))
    cut = wide.select("id", "size", "wide", *[x for less in range(n) for x in (
        F.floor((F.col("size") - less) / n).cast("int").alias(f"part{less}"), (n - (F.col("size") - less) % n).alias(f"short{less}"))])

    def key(less: int, i: int, move: int) -> Column:
        part, short = F.col(f"part{less}"), F.col(f"short{less}")
        start = i * part + F.greatest(F.lit(0), i - short) + move
        return F.xxhash64(F.col("size") - less, F.lit(i), F.substring("wide", 4 * start + 1, 4 * (part + F.when(F.lit(i) >= short, 1).otherwise(0))))

    made = cut.select(F.col("id").alias(name), F.array(*[key(*a) for a in asked]).alias("keys"))
    return made.select(F.explode_outer("keys").alias("key"), name)  # never empty; explode() would have the keys made twice


def segments(edits: int) -> list[tuple[int, int, int]]:
    """What a line is indexed by."""
    return [(0, i, 0) for i in range(edits + 1)]


def probes(edits: int) -> list[tuple[int, int, int]]:
    """What a line asks for: of every length up to its own and every segment, the
    places it can stand at if ``i`` segments before it and those after it hold
    all edits."""
    return [(less, i, move) for less in range(edits + 1) for i in range(edits + 1) for move in range(-i, i + 1) if abs(move - less) <= edits - i]


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings differ by at most ``edits`` insertions, deletions and
    replacements. Bit d of the e-th word tells if the d-th diagonal of the band
    can be reached with e edits; all diagonals take a character of ``a`` at once."""
    width = 2 * edits + 1
    start = F.struct(*[F.lit(sum(1 << (edits + d) for d in range(e + 1))).alias(f"w{e}") for e in range(edits + 1)])

    def compare(x: Column, y: Column) -> Column:
        def step(word: Column, i: Column) -> Column:
            same = F.lit(0)
            for d in range(width):
                same = same + F.when(F.get(x, i) == F.get(y, i + (d - edits)), 1 << d).otherwise(0)

            def advance(match: Column) -> Column:
                new: list[Column] = []
                for e in range(edits + 1):
                    to = word[f"w{e}"].bitwiseAND(match)
                    if e:
                        old = word[f"w{e - 1}"]
                        to = to.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1).bitwiseAND((1 << width) - 1))
                    new.append(to)
                return F.struct(*[w.alias(f"w{e}") for e, w in enumerate(new)])

            return let(same, advance)

        last = F.aggregate(F.slice(F.sequence(F.lit(0), F.size(x)), 1, F.size(x)), start, step)[f"w{edits}"]
        end = F.get(F.array(*[F.lit(1 << d) for d in range(width)]), F.size(y) - F.size(x) + edits)
        return F.coalesce(last.bitwiseAND(end) != 0, F.lit(False))

    return let(F.split(a, ""), lambda x: let(F.split(b, ""), lambda y: compare(x, y)))


def judged(line: Column, least_chars: int) -> Column:
    """Whether a line can go: blank lines separate others and stay."""
    return (F.length(line) >= least_chars) | line.rlike(r"\S")


def distinct_lines(documents: DataFrame, least_chars: int) -> DataFrame:
    """(id, line, size, pos): the lines that can go, once each, at their first
    place (doc_id, hash of the text, line number)."""
    at = documents.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    first = (at.filter(judged(F.col("line"), least_chars)).groupBy("line").agg(F.min(F.struct("doc_id", "h", "n")).alias("pos")))
    return written(first.select(F.monotonically_increasing_id().alias("id"), "line", F.length("line").alias("size"), "pos"), "lines")


def _close(a: Column, b: Column, edits: int) -> Column:
    """within(), asked only where the JVM's own banded check doesn't rule it out."""
    return (F.levenshtein(a, b, edits) >= 0) & within(a, b, edits)


def near_earlier(lines: DataFrame, edits: int) -> DataFrame:
    """lines(id, line, size, pos) -> (id): the lines with an earlier one within ``edits``.

    A key of fewer than ``HOT`` indexed lines meets its probes in a join. Of a
    hotter key only one row takes part, so its probes stay one row each; its
    lines and probes are then compared as arrays of about ``BLOCK`` lines, block
    by block, and only the lines found are rows.
    """
    index, probe = keys(lines, edits, segments(edits), "r"), keys(lines, edits, probes(edits), "s")
    hot = written(index.groupBy("key").count().filter(F.col("count") >= HOT), "hot-keys")
    cold = index.join(hot, "key", "left_anti").unionByName(hot.select("key", F.lit(None).cast("long").alias("r")))
    met = written(cold.join(probe, "key").filter("r is null or r <> s").select(F.when(F.col("r").isNull(), F.col("key")).alias("key"), "r", "s").distinct(), "met")
    held = written(index.join(hot, "key").select("key", F.col("r").alias("id"), "count"), "hot-lines")
    ids = written(met.select(F.explode(F.array("r", "s")).alias("id")).unionByName(held.select("id")).filter("id is not null").distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:  # checked: then the texts needn't be dealt
        ids = F.broadcast(ids)
    few = written(lines.join(ids, "id", "left_semi"), "texts")
    side = lambda name: few.select(F.col("id").alias(name), F.col("line").alias(f"line_{name}"), F.col("pos").alias(f"pos_{name}"))
    pairs = met.filter("r is not null").select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct()
    one = (pairs.join(side("a"), "a").join(side("b"), "b").filter(_close(F.col("line_a"), F.col("line_b"), edits))
           .select(F.when(F.col("pos_a") < F.col("pos_b"), F.col("b")).otherwise(F.col("a")).alias("id")))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / BLOCK))
        return written(rows.join(few, "id").groupBy("key", part.alias("block")).agg(F.collect_list(F.struct("id", "pos", "line")).alias(name)).drop("block"), name)

    asking = met.filter("r is null").select("key", F.col("s").alias("id"))
    asking = asking.join(asking.groupBy("key").count(), "key")
    both = blocks(held, "indexed").join(blocks(asking, "probes"), "key")
    hit = lambda s: F.exists("indexed", lambda r: (r["pos"] < s["pos"]) & _close(r["line"], s["line"], edits))
    back = lambda r: F.exists("probes", lambda s: (s["pos"] < r["pos"]) & _close(s["line"], r["line"], edits))
    later = F.concat(F.transform(F.filter("probes", hit), lambda x: x["id"]), F.transform(F.filter("indexed", back), lambda x: x["id"]))
    return one.unionByName(both.select(F.explode(later).alias("id"))).distinct()


def dedup(documents: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """documents -> (row, text, n_lines, n_exact, n_near): ``row`` has all columns
    of the document, ``text`` its lines that stay.

    A line ends with a newline. Blank lines under ``least_chars`` characters
    stay, and other lines under it are only held against equal ones. Lines are ordered by doc_id (null first), a hash of
    their text, and number; a line goes if an earlier one equals it (n_exact) or
    differs by at most ``edits`` (n_near, counted at its first place). An earlier
    line counts whether it stays itself or not. Null text counts as empty and
    gives an empty text, as does a document without any line that stays. Rows
    with the same doc_id and text count as one document, and each gets its result.
    """
    docs = documents.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = distinct_lines(docs, least_chars)
    gone = written(near_earlier(lines.filter(F.col("size") >= least_chars), edits).select("id", F.lit(True).alias("near")), "near")
    first = lines.select("id", "pos").join(gone, "id", "left").select("pos.doc_id", "pos.h", F.struct("pos.n", F.coalesce("near", F.lit(False)).alias("near")).alias("first"))
    firsts = written(first.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("first")).alias("firsts")), "firsts")
    rows = documents.select(F.struct("*").alias("row")).withColumn("body", F.coalesce("row.text", F.lit("")))
    rows = rows.withColumn("own_id", F.col("row.doc_id")).withColumn("own_h", F.xxhash64("body"))
    both = rows.join(firsts, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_h") == F.col("h")), "left")
    none = F.array().cast("array<struct<n:int,near:boolean>>")

    def rebuild(parts: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(parts) - 1)
        kept = F.transform(F.filter(F.coalesce("firsts", none), lambda x: ~x["near"]), lambda x: x["n"])
        short = F.filter(every, lambda i: ~judged(F.get(parts, i), least_chars))
        near = F.size(F.coalesce("firsts", none)) - F.size(kept)
        text = F.array_join(F.transform(F.array_sort(F.concat(kept, short)), lambda i: F.get(parts, i)), "\n")
        return F.struct(text.alias("text"), F.size(parts).cast("long").alias("n_lines"),
                        (F.size(parts) - F.size(short) - F.size(kept) - near).cast("long").alias("n_exact"), near.cast("long").alias("n_near"))

    return both.select("row", let(F.split("body", "\n"), rebuild).alias("r")).select("row", "r.*")


@register("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_exact", "n_near", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their lines that stay; n_chars follows the text."""
    out = dedup(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
