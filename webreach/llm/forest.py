"""N-gram Jaccard join with banded MinHash and exact verification.

A document is the set of its five-word shingles. Every set has ``TREES``
signatures of ``DEPTH`` minhashes. No trie is kept: one length of the prefixes
that must agree, the longest one at which a pair at the threshold meets in some
tree with the target recall, is worked out before any data is read, and sets are
grouped by equal prefixes, as in banding. Sets that meet are
first compared by their signatures, then exactly; a pair counts in the first
tree where it meets. Groups of any size are taken in pairs of blocks, inside
tasks: pairs themselves are never rows, only counts and spanning links are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.llm.common import chunks, column, components, prefix_hashes, runs, scramble, span_hashes, table, text_key, utf8, whole_groups, written
from webreach.llm.registry import register

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 5, 0.9999
#: Sets of a group that are compared with each other, or with so many others, at a time.
BLOCK = 512
#: A pair whose signatures agree this much less than the threshold isn't verified: five standard deviations.
SLACK = 5 * (THRESHOLD * (1 - THRESHOLD) / (TREES * DEPTH)) ** 0.5
#: Rows whose texts are needed that are sent to every task, at some 50 bytes each; with more, all texts are dealt.
BROADCAST_ROWS = 200_000
_SEEDS = scramble(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def depth_for(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with the target recall at the threshold; 1 if none has it."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 64-bit shingles of all rows, sorted in each; row offsets). A row
    of fewer words than a shingle has all its words as one; one without words none."""
    n = len(at) - 1
    buf = np.insert(raw, at[1:], 32)
    edge = at + np.arange(n + 1)
    start, end = runs(~_SPACE[buf])
    word = span_hashes(prefix_hashes(buf), start, end)
    row = np.searchsorted(edge, start, "right") - 1
    chain = lambda x, y: scramble(x * np.uint64(0x9E3779B97F4A7C15) + y)
    value, own = [], []
    if len(word) >= WORDS:
        inside = np.flatnonzero(row[WORDS - 1:] == row[: len(row) - WORDS + 1])
        v = word[inside]
        for i in range(1, WORDS):
            v = chain(v, word[inside + i])
        value.append(v)
        own.append(row[inside])
    first = np.searchsorted(row, np.arange(n + 1))
    for r in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < WORDS)).tolist():
        v = word[first[r]: first[r] + 1]
        for i in range(first[r] + 1, first[r + 1]):
            v = chain(v, word[i: i + 1])
        value.append(chain(v, np.uint64(first[r + 1] - first[r])))
        own.append(np.array([r]))
    if not value:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    value, own = np.concatenate(value), np.concatenate(own)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    keep = np.append(True, (value[1:] != value[:-1]) | (own[1:] != own[:-1]))
    return value[keep], np.searchsorted(own[keep], np.arange(n + 1))


def signatures(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, TREES * DEPTH) minhashes; every row has a shingle."""
    out = np.empty((len(at) - 1, TREES * DEPTH), np.uint32)
    for f in range(TREES * DEPTH):
        hashed = ((value ^ _SEEDS[2 * f]) * (_SEEDS[2 * f + 1] | np.uint64(1))) >> np.uint64(32)
        out[:, f] = np.minimum.reduceat(hashed, at[:-1])
    return out


def prefixes(signature: np.ndarray, depth: int) -> np.ndarray:
    """(rows, TREES): a number for the first ``depth`` minhashes of each tree, with the tree in its lowest bits."""
    out = np.empty((len(signature), TREES), np.uint64)
    for t in range(TREES):
        v = np.full(len(signature), np.uint64(t + 1))
        for d in range(depth):
            v = scramble(v * np.uint64(0x9E3779B97F4A7C15) + signature[:, t * DEPTH + d])
        out[:, t] = (v >> np.uint64(5) << np.uint64(5)) | np.uint64(t)
    return out


def _signed(batches):
    for batch in batches:
        for part, raw, at in chunks(batch):
            value, own = shingles(raw, at)
            some = np.flatnonzero(np.diff(own) > 0)
            if not len(some):
                continue
            offsets = np.append(own[some], len(value))
            ids = np.stack([np.add.reduceat(scramble(value + np.uint64(i)), offsets[:-1]) for i in (0, 1)], 1)
            sig = signatures(value, offsets)
            take = lambda name: column(part, name).take(pa.array(some))
            yield pa.RecordBatch.from_arrays(
                [take("doc_id"), take("k1"), take("k2"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(np.diff(offsets).astype(np.int32)),
                 pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "k1", "k2", "set_id", "size", "sig"])


def _matrix(rows, name: str, kind) -> np.ndarray:
    raw, at = utf8(column(rows, name))
    return np.frombuffer(raw.tobytes(), kind).reshape(len(at) - 1, -1)


def _buckets(depth: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = prefixes(_matrix(batch, "sig", np.uint32), depth)
                row = np.repeat(np.arange(batch.num_rows), TREES)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), column(batch, "set_id").take(pa.array(row))], ["bucket", "set_id"])
    return run


def _meet(bucket: int, lo: int, hi: int, block: np.ndarray, keys: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Matrix of the pairs to verify here: they meet in no earlier tree, and neither
    their sizes nor their signatures rule the threshold out."""
    tree = bucket & 31
    n = len(size)
    ok = np.triu(np.ones((n, n), bool), 1)
    if lo != hi:
        ok &= block[:, None] != block[None, :]
    small, large = np.minimum.outer(size, size), np.maximum.outer(size, size)
    ok &= small >= THRESHOLD * large - 1e-6
    for t in range(tree):
        if not ok.any():
            return ok
        ok &= keys[:, t, None] != keys[None, :, t]
    i, j = np.nonzero(ok)
    agree = np.zeros(len(i), np.int32)
    for a in range(0, len(i), 1 << 16):
        agree[a: a + (1 << 16)] = (low[i[a: a + (1 << 16)]] == low[j[a: a + (1 << 16)]]).sum(1)
    ok[i, j] = agree >= (THRESHOLD - SLACK) * low.shape[1]
    return ok


def _each(batches, depth: int):
    """Rows of every (bucket, lo, hi), with the matrix of its pairs to verify."""
    for rows in whole_groups(batches, ["bucket", "lo", "hi"], 2048):
        key = [column(rows, c).to_numpy() for c in ("bucket", "lo", "hi")]
        cut = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0)))
        sig = _matrix(rows, "sig", np.uint32)
        keys, low, size, block = prefixes(sig, depth), sig.astype(np.uint8), column(rows, "size").to_numpy(), column(rows, "block").to_numpy()
        for a, b in zip(cut, np.append(cut[1:], rows.num_rows), strict=True):
            if b - a > 1:
                yield rows.slice(a, b - a), _meet(int(key[0][a]), int(key[1][a]), int(key[2][a]), block[a:b], keys[a:b], low[a:b], size[a:b])


def _needed(depth: int):
    def run(batches):
        for rows, ok in _each(batches, depth):
            some = np.flatnonzero(ok.any(0) | ok.any(1))
            if len(some):
                yield from rows.select(["bucket", "lo", "hi", "block", "set_id"]).take(pa.array(some)).combine_chunks().to_batches()
    return run


def jaccard(sets: list[np.ndarray], ok: np.ndarray) -> np.ndarray:
    """Of the pairs marked, those with a Jaccard similarity of THRESHOLD and more:
    shared shingles are counted by products of 0/1 matrices, some columns at a time."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    value, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, back = np.repeat(np.arange(n), size), back.ravel()
    number = np.cumsum(count > 1) - 1
    use = count[back] > 1
    owner, back = owner[use], number[back[use]]
    shared = np.zeros((n, n), np.float32)
    order = np.argsort(back, kind="stable")
    owner, back = owner[order], back[order]
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        lo, hi = np.searchsorted(back, (a, a + 4096))
        bits = np.zeros((n, 4096), np.float32)
        bits[owner[lo:hi], back[lo:hi] - a] = 1
        shared += bits @ bits.T
    return ok & (shared >= THRESHOLD * (size[:, None] + size[None, :] - shared) - 1e-6)


def _verified(depth: int):
    def run(batches):
        for rows, ok in _each(batches, depth):
            raw, at = utf8(column(rows, "shingles"))
            value = np.frombuffer(raw.tobytes(), np.uint64)
            link = jaccard([value[x // 8: y // 8] for x, y in zip(at[:-1], at[1:], strict=True)], ok)
            link |= link.T
            count = link.sum(1)
            root = np.arange(len(count))  # the smallest row that each is linked to, over other rows
            while True:
                near = np.where(link, root[None, :], len(root)).min(1, initial=len(root))
                new = np.minimum(root, near)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            some = np.flatnonzero(count)
            if len(some):
                ids = column(rows, "set_id")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), ids.take(pa.array(root[some])), pa.array(count[some].astype(np.int64))], ["a", "b", "links"])
    return run


def _shingle_rows(batches):
    for batch in batches:
        for part, raw, at in chunks(batch):
            value, own = shingles(raw, at)
            yield pa.RecordBatch.from_arrays([column(part, "set_id"), column(part, "size"), column(part, "sig"),
                                              pa.array([value[a:b].tobytes() for a, b in zip(own[:-1], own[1:], strict=True)], pa.binary())], ["set_id", "size", "sig", "shingles"])


def join(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> one row per row: (doc_id, class_id, n_links,
    n_copies, k1, k2, is_first).

    Words are separated by ASCII white space. Two documents are linked if their
    sets of five-word shingles have a Jaccard similarity of 0.8 and more;
    documents of fewer words have all their words as their one shingle. Rows
    with equal sets are copies: ``n_copies`` counts them, the row itself
    included, and ``n_links`` the other sets that theirs is linked to.
    ``class_id`` is the smallest doc_id of all that links and copies connect (if
    all are null, a negative hash). A text without words (null, empty) is a class
    of its own, without copies. ``is_first`` marks the one row of each class that
    has the smallest (doc_id, k1, k2), null last; rows alike in all that are one.
    k1 and k2 stand for doc_id and text. Other columns are ignored.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *text_key())
    depth = depth_for()
    rows = written(docs.mapInArrow(_signed, "doc_id long, k1 long, k2 long, set_id binary, size int, sig binary"), "signed")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k1", "k2")
    sets = written(rows.groupBy("set_id").agg(F.count("*").alias("n_copies"), F.min(place).alias("place"), F.first("size").alias("size"), F.first("sig").alias("sig")), "sets")
    # sides that grow with the corpus are merged at every size, not sent to every task at small ones
    grows = lambda df: df.hint("merge")
    # sets that meet
    buckets = sets.select("sig", "set_id").mapInArrow(_buckets(depth), "bucket long, set_id binary")
    shared = written(buckets.groupBy("bucket").count().filter("count > 1").select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "shared")
    meeting = buckets.join(grows(shared), "bucket").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    pairs = meeting.select("bucket", "block", "set_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "set_id")
    grouped = lambda df: df.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    key = "bucket long, lo int, hi int, block int, set_id binary"
    met = written(pairs, "met").join(grows(sets.select("set_id", "size", "sig")), "set_id")
    needed = written(grouped(met).mapInArrow(_needed(depth), key), "needed")
    # their shingles, from one row of each
    ask = needed.select("set_id").distinct().join(grows(sets.select("set_id", "place.k1", "place.k2", "size", "sig")), "set_id")
    ask = written(ask, "ask")
    few = ask.select("k1", "k2", "set_id")
    if few.count() <= BROADCAST_ROWS:  # checked: then the texts needn't be dealt
        few = F.broadcast(few)
    texts = docs.select("k1", "k2", "text").join(few, ["k1", "k2"]).select("set_id", "text").dropDuplicates(["set_id"])
    texts = texts.join(grows(ask.select("set_id", "size", "sig")), "set_id")
    full = written(texts.mapInArrow(_shingle_rows, "set_id binary, size int, sig binary, shingles binary"), "shingles")
    links = written(grouped(needed.join(grows(full), "set_id")).mapInArrow(_verified(depth), "a binary, b binary, links long"), "links")
    # classes
    roots = components(links.select("a", "b"), "classes")
    counts = links.groupBy("a").agg(F.sum("links").alias("n_links")).withColumnRenamed("a", "set_id")
    known = sets.join(grows(counts), "set_id", "left").join(grows(roots.select(F.col("a").alias("set_id"), F.col("b").alias("root"))), "set_id", "left").select(
        "set_id", "n_copies", "place", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "set_id").alias("root"))
    known = written(known, "known")
    heads = written(known.groupBy("root").agg(F.min("place").alias("head")), "heads")
    classes = written(known.join(grows(heads), "root").select("set_id", "n_copies", "n_links", "head"), "heads")
    same = F.col("head.k1").eqNullSafe(F.col("k1")) & F.col("head.k2").eqNullSafe(F.col("k2"))
    class_id = F.coalesce("head.doc_id", -F.abs(F.shiftright("head.k1", 1)) - 1)
    with_words = rows.select("doc_id", "k1", "k2", "set_id").join(grows(classes), "set_id").select(
        "doc_id", class_id.alias("class_id"), "n_links", "n_copies", "k1", "k2", same.alias("is_first"))
    alone = docs.filter(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
        "doc_id", F.coalesce("doc_id", -F.abs(F.shiftright("k1", 1)) - 1).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), "k1", "k2", F.lit(True).alias("is_first"))
    return with_words.unionByName(alone)


@register("op5_jaccard_forest")
def op5_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the first; of rows alike in doc_id and text, one.
    Documents without words all stay."""
    first = written(join(docs).filter("is_first").select(F.col("k1").alias("own1"), F.col("k2").alias("own2")).distinct(), "firsts")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"), "doc_id").select(
        "row", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2"), (F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("worded"))
    kept = rows.filter("worded").join(first, (F.col("k1") == F.col("own1")) & (F.col("k2") == F.col("own2")), "left_semi")
    return kept.dropDuplicates(["k1", "k2"]).select("row.*").unionByName(rows.filter("not worded").select("row.*"))
