"""Language-model scores by context-tree weighting, beside a unigram base.

A byte is eight binary decisions; each of the 255 nodes of that decomposition
has a context tree over the bytes before, ``DEPTH`` deep. A context holds the
counts of its zeros and ones, whose Krichevsky-Trofimov estimate is mixed with
that of the longer contexts, half and half at every depth (Willems, Shtarkov,
Tjalkens). Trained on whole texts and then fixed, the tree gives the probability
of every next byte, and so the code length of any text.

The counts are those of (context, byte) strings, packed into a long with the
nearest context byte on top: sorted, every subtree is a run of neighbours. The
subtrees below ``CUT`` context bytes are worked out where they lie, the part of
the tree above them (a fixed number of nodes at most) on the driver.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.llm.common import chunks, column, table, whole_groups, written
from webreach.llm.registry import register

#: Context bytes, and those above the subtrees: a subtree has 256 ** (DEPTH - CUT) contexts at most.
DEPTH, CUT = 4, 2
#: Stands before and after a text; no byte of UTF-8.
END = 255
#: The most frequent strings and tokens whose values are sent to the tasks; all others are joined.
HOT_GRAMS, HOT_TOKENS = 1 << 20, 1 << 17
BLOCK = 1 << 20
GROUP_ROWS = 1 << 17
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- strings of a text ------------------------------------------------------------------------

def framed(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with ``DEPTH`` end bytes before each and after the last; the edges of what is coded (each text and one end byte)."""
    buf = np.insert(_LOWER[raw], np.repeat(at, DEPTH), END)
    start = at[:-1] + DEPTH * np.arange(1, len(at))
    return buf, np.stack((start, start + np.diff(at) + 1), 1)


def grams(buf: np.ndarray, a: int, b: int) -> np.ndarray:
    """For the places a..b (none of the first DEPTH): the bytes before, nearest first, then the byte itself."""
    key = buf[a - 1: b - 1].astype(np.int64)
    for back in range(2, DEPTH + 1):
        key = key << 8 | buf[a - back: b - back]
    return key << 8 | buf[a:b]


def coded(buf: np.ndarray, edges: np.ndarray):
    """(row, strings) of all coded places, in blocks of about ``BLOCK``."""
    size = edges[:, 1] - edges[:, 0]
    for a in range(DEPTH, len(buf), BLOCK):
        b = min(a + BLOCK, len(buf))
        first, last = np.searchsorted(edges[:, 1], a, "right"), np.searchsorted(edges[:, 0], b, "left")
        if first >= last:
            continue
        inside = np.clip(edges[first:last], a, b) - a
        row = np.repeat(np.arange(first, last), np.diff(inside, axis=1)[:, 0])
        keep = np.zeros(b - a + 1, np.int8)
        np.add.at(keep, inside[:, 0], 1)
        np.add.at(keep, inside[:, 1], -1)
        yield row, grams(buf, a, b)[np.cumsum(keep[:-1]) > 0]


def _add_up(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums (rows of 2) by key."""
    key = np.concatenate([k for k, _ in held])
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.concatenate([n for _, n in held])[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def gram_counts(documents: DataFrame) -> DataFrame:
    """documents(text, learn) -> (gram, train, total): places in learned texts and in all."""
    def out(held):
        key, n = _add_up(held)
        for a in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[a: a + (1 << 16)]), *(pa.array(np.ascontiguousarray(c)) for c in n[a: a + (1 << 16)].T)], ["gram", "train", "total"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part, raw, at in chunks(batch):
                learn = column(part, "learn").to_numpy(zero_copy_only=False)
                for row, gram in coded(*framed(raw, at)):
                    for own in (True, False):
                        key, n = np.unique(gram[learn[row] == own], return_counts=True)
                        held.append((key, np.stack((n * own, n), 1)))
                if sum(len(k) for k, _ in held) > 1 << 21:
                    held = [_add_up(held)]
                    if len(held[0][0]) > 1 << 20:
                        yield from out(held)
                        held = []
        if held:
            yield from out(held)

    return documents.select("text", "learn").mapInArrow(run, "gram long, train long, total long").groupBy("gram").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def token_counts(documents: DataFrame) -> DataFrame:
    """documents(text, learn) -> (token, train, total); the empty token is the end of a text."""
    def out(train, rest):
        tokens = list(train.keys() | rest.keys())
        for a in range(0, len(tokens), 1 << 15):
            part = tokens[a: a + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([train[t] for t in part], pa.int64()), pa.array([train[t] + rest[t] for t in part], pa.int64())],
                                             ["token", "train", "total"])

    def run(batches):
        counts = {True: Counter(), False: Counter()}
        for batch in batches:
            for part, raw, at in chunks(batch):
                text = _LOWER[raw].tobytes()
                for learn, a, b in zip(column(part, "learn").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    counts[learn].update(text[a:b].split())
                    counts[learn][b""] += 1
                if len(counts[True]) + len(counts[False]) > 1 << 18:
                    yield from out(counts[True], counts[False])
                    counts = {True: Counter(), False: Counter()}
        yield from out(counts[True], counts[False])

    return documents.select("text", "learn").mapInArrow(run, "token binary, train long, total long").groupBy("token").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


# ---- the tree ---------------------------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series from 8 on."""
    low = x < 8
    y = np.where(low, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    z = x[low]
    out[low] -= sum(np.log(z + i) for i in range(8))
    return out


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    a, b = zeros.astype(np.float64), ones.astype(np.float64)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)


def share(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The same estimator's probability that the next one is 1."""
    return (ones + 0.5) / (zeros + ones + 1.0)


def mix(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability out of a context's own estimate and its longer contexts' product; and the weight of its own."""
    log = np.logaddexp(own, below) - math.log(2)
    return log, np.exp(own - math.log(2) - log)


def shorter(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (context, byte) with the farthest context byte left out."""
    short = key >> 16 << 8 | key & 255
    own, at = np.unique(short, return_inverse=True)
    return own, np.bincount(at, n, len(own)).astype(np.int64)


def nodes(key: np.ndarray, n: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts with the first ``bit`` bits of the byte: their keys, zeros and ones next, and the node of each (sorted) row."""
    node = key >> (8 - bit)
    new = np.diff(node, prepend=-1) != 0
    first = np.flatnonzero(new)
    ones = np.add.reduceat(n * (key >> (7 - bit) & 1), first)
    return node[first], np.add.reduceat(n, first) - ones, ones, np.cumsum(new) - 1


def up(node: np.ndarray, bit: int) -> np.ndarray:
    """The node of the context that is one byte shorter."""
    return node >> (bit + 8) << bit | node & ((1 << bit) - 1)


def subtrees(key: np.ndarray, n: np.ndarray):
    """Of sorted whole subtrees, for each bit: the nodes with CUT context bytes (keys, zeros, ones, ln of
    the weighted probability), and for each row the node and a function of its mixing downwards."""
    levels = [(key, n)]
    while len(levels) <= DEPTH - CUT:
        levels.append(shorter(*levels[-1]))
    for bit in range(8):
        node, zeros, ones, row = nodes(*levels[0], bit)
        log = estimate(zeros, ones)
        p, at, steps = share(zeros, ones), np.arange(len(node)), []
        for level in levels[1:]:
            parent, z, o, _ = nodes(*level, bit)
            to = np.searchsorted(parent, up(node, bit))
            log, own = mix(estimate(z, o), np.bincount(to, log, len(parent)))
            at = to[at]
            steps.append((at, own, share(z, o)))
            node, zeros, ones = parent, z, o
        # longest first: each shorter context mixes its own share with what lies below
        for to, own, one in steps:
            p = own[to] * one[to] + (1 - own[to]) * p
        yield bit, node, zeros, ones, log, row, at, p


def cut_nodes(counts: DataFrame) -> DataFrame:
    """(bit, node, zeros, ones, log): nodes with CUT - 1 context bytes, with the sums of their longer contexts; 255 * 256 rows at most."""
    def run(batches):
        for rows in whole_groups(batches, ["top"], GROUP_ROWS):
            key, n = (column(rows, c).to_numpy(zero_copy_only=False) for c in ("gram", "train"))
            for bit, node, zeros, ones, log, *_ in subtrees(key, n):
                parent, at = np.unique(up(node, bit), return_inverse=True)
                sums = [np.bincount(at, v, len(parent)) for v in (zeros, ones)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(parent), bit, np.int32)), pa.array(parent), *(pa.array(s.astype(np.int64)) for s in sums), pa.array(np.bincount(at, log, len(parent)))],
                    ["bit", "node", "zeros", "ones", "log"])

    nodes_ = _by_top(counts).mapInArrow(run, "bit int, node long, zeros long, ones long, log double")
    return nodes_.groupBy("bit", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("log"))


def _by_top(counts: DataFrame) -> DataFrame:
    top = F.shiftright("gram", 8 * (DEPTH - CUT + 1))
    return counts.withColumn("top", top).repartition("top").sortWithinPartitions("gram")


def crown(cut: list) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each bit, from CUT - 1 context bytes up to none: nodes, weights of their own estimate, their shares."""
    out = []
    for bit in range(8):
        rows = sorted((r.node, r.zeros, r.ones, r.log) for r in cut if r.bit == bit)
        node = np.array([r[0] for r in rows], np.int64)
        zeros, ones, below = (np.array([r[i] for r in rows], t) for i, t in ((1, np.int64), (2, np.int64), (3, np.float64)))
        levels = []
        for depth in range(CUT - 1, -1, -1):
            log, own = mix(estimate(zeros, ones), below)
            levels.append((node, own, share(zeros, ones)))
            if depth:
                parent, at = np.unique(up(node, bit), return_inverse=True)
                zeros, ones, below = (np.bincount(at, v, len(parent)) for v in (zeros, ones, log))
                node = parent
        out.append(levels)
    return out


def gram_costs(counts: DataFrame) -> DataFrame:
    """(gram, train, total) -> (gram, cost, total): log10 of the byte's probability behind its context."""
    top = crown(cut_nodes(counts).collect())

    def run(batches):
        for rows in whole_groups(batches, ["top"], GROUP_ROWS):
            key, n = (column(rows, c).to_numpy(zero_copy_only=False) for c in ("gram", "train"))
            cost = np.zeros(len(key))
            for bit, node, _, _, _, row, at, p in subtrees(key, n):
                for known, own, one in top[bit]:
                    node = up(node, bit)
                    to = np.searchsorted(known, node)[at]
                    p = own[to] * one[to] + (1 - own[to]) * p
                p = p[row]
                cost += np.log10(np.where(key >> (7 - bit) & 1, p, 1 - p))
            yield pa.RecordBatch.from_arrays([column(rows, "gram"), pa.array(cost), column(rows, "total")], ["gram", "cost", "total"])

    return _by_top(counts).mapInArrow(run, "gram long, cost double, total long")


# ---- scores -----------------------------------------------------------------------------------

class Lookup:
    """Values by key in a table of 4 slots a key, dealt by a product's top bits; a key stands in one of
    the ``PROBES`` slots from its own on. One that finds them all taken counts as unknown."""

    PROBES = 12

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full((1 << bits) + self.PROBES, -1, np.int64), np.zeros((1 << bits) + self.PROBES)
        slot = self.slot(keys)
        for _ in range(self.PROBES):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = keys[free]  # of several, the last one stays
            own = self.keys[slot] == keys
            self.values[slot[own]] = values[own]
            keys, values, slot = keys[~own], values[~own], slot[~own] + 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a key is known, and its value (else 0)."""
        slot = self.slot(keys)
        hit = self.keys[slot] == keys
        out = np.where(hit, self.values[slot], 0.0)
        left = np.flatnonzero(~hit)
        for step in range(1, self.PROBES):
            if not len(left):
                break
            at = slot[left] + step
            own = self.keys[at] == keys[left]
            out[left[own]], hit[left[own]] = self.values[at[own]], True
            left = left[~own & (self.keys[at] >= 0)]
        return hit, out

def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent rows, ``most`` at most: cut between two classes of their ``total``."""
    size = F.floor(F.log2("total") * 8)
    least, room = None, most
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["size"]):  # 512 rows at most
        room -= r.n
        if room < 0:
            break
        least = r["size"]
    return counts.filter(size >= least) if least is not None else counts.limit(0)


def score(documents: DataFrame, fold: int = 5, held_out: int = 1) -> DataFrame:
    """documents(doc_id, text) -> one row per row: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score.

    Texts are taken in lower case (A-Z only). ``score`` is log10 of the tree's
    probability of the text's UTF-8 bytes and the end behind them; ``base_score``
    that of its tokens and their end by smoothed counts. A null or empty text is
    the end alone. A null id counts as the empty text, which is learned from;
    repeated rows are learned from and scored one by one, other columns are
    ignored, an empty table gives no rows. If nothing is learned from, each bit
    counts as even and base_score is 0. Collected, and sent to the tasks: the
    values of the ``HOT_GRAMS`` and ``HOT_TOKENS`` most frequent strings and
    tokens; rarer ones are joined. The tree's part above the subtrees has 65,280
    nodes at most.
    """
    spark = documents.sparkSession
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.crc32(key) % fold != held_out).alias("learn"))
    tokens = written(token_counts(docs), "ctw-tokens")
    costs = written(gram_costs(written(gram_counts(docs), "ctw-grams")), "ctw-costs")
    sums = tokens.agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("v")).first()
    n_train, n_words = sums.n or 0, sums.v or 0
    log_all = math.log10(n_train + 0.5 * (n_words + 1))
    hot = frequent(costs, HOT_GRAMS).select("gram", "cost").toArrow()
    hot_grams = spark.sparkContext.broadcast((hot["gram"].to_numpy(), hot["cost"].to_numpy()))
    hot = frequent(tokens, HOT_TOKENS).select("token", "train").toArrow()
    hot_tokens = spark.sparkContext.broadcast((hot["token"].to_pylist(), hot["train"].to_numpy()))

    def lists(key, first, values, n):
        edge = pa.array(np.append(first, len(key)).astype(np.int32))
        return pa.ListArray.from_arrays(edge, values), pa.ListArray.from_arrays(edge, pa.array(n))

    def run(batches):
        known = Lookup(*hot_grams.value)
        names, train = hot_tokens.value
        number = dict(zip(names, range(len(names)), strict=True))
        value = np.append(np.log10(train + 0.5), 0.0) - np.append(np.full(len(train), log_all), 0.0)
        seen = np.append(train > 0, False)
        for batch in batches:
            for part, raw, at in chunks(batch):
                n = part.num_rows
                # strings
                total, cold = np.zeros(n), []
                for row, gram in coded(*framed(raw, at)):
                    hit, cost = known.find(gram)
                    total += np.bincount(row, cost, n)
                    cold.append(row[~hit] << 8 * (DEPTH + 1) | gram[~hit])  # a batch has far fewer than 2 ** 23 rows
                pair, times = np.unique(np.concatenate([*cold, np.zeros(0, np.int64)]), return_counts=True)
                gram_lists = lists(pair, np.searchsorted(pair >> 8 * (DEPTH + 1), np.arange(n)), pa.array(pair & ((1 << 8 * (DEPTH + 1)) - 1)), times)
                # tokens
                text = _LOWER[raw].tobytes()
                words = [[*text[a:b].split(), b""] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                size = np.array([len(w) for w in words])
                row = np.repeat(np.arange(n), size)
                flat = list(itertools.chain.from_iterable(words))
                place = np.fromiter(map(number.get, flat, itertools.repeat(-1)), np.int64, len(flat))
                base = np.bincount(row, value[place], n)
                left = np.flatnonzero(place < 0)
                rare = Counter(zip(row[left].tolist(), map(flat.__getitem__, left.tolist()), strict=True))  # row by row, as first met
                first = np.searchsorted(np.fromiter((r for r, _ in rare), np.int64, len(rare)), np.arange(n))
                token_lists = lists(rare, first, pa.array([w for _, w in rare], pa.binary()), np.fromiter(rare.values(), np.int64, len(rare)))
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), column(part, "learn"), pa.array(size), pa.array(np.bincount(row, seen[place], n).astype(np.int64)), pa.array(base), pa.array(total), *gram_lists, *token_lists],
                    ["doc_id", "learn", "n_tokens", "n_known", "base", "total", "grams", "gram_n", "tokens", "token_n"])

    parts = docs.mapInArrow(run, "doc_id long, learn boolean, n_tokens long, n_known long, base double, total double, "
                                 "grams array<long>, gram_n array<long>, tokens array<binary>, token_n array<long>")
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "ctw-parts")
    rare = lambda names, n: parts.filter(F.size(names) > 0).select("row", F.explode(F.arrays_zip(F.col(names).alias("key"), F.col(n).alias("n"))).alias("x")).select("row", "x.key", "x.n")
    by_gram = rare("grams", "gram_n").join(costs, F.col("key") == F.col("gram")).select("row", (F.col("cost") * F.col("n")).alias("total"), F.lit(0).alias("known"), F.lit(0.0).alias("base"))
    train = F.coalesce("train", F.lit(0))
    by_token = rare("tokens", "token_n").join(tokens, F.col("key") == F.col("token"), "left").select(
        "row", F.lit(0.0).alias("total"), F.when(train > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * (F.log10(train + 0.5) - log_all)).alias("base"))
    more = by_gram.unionByName(by_token).groupBy("row").agg(*(F.sum(c).alias(f"more_{c}") for c in ("total", "known", "base")))
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return parts.select("row", "doc_id", "learn", "n_tokens", "n_known", "base", "total").join(more, "row", "left").select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), plus("total", "more_total").alias("score"))


@register("op13_ctw_score")
def op13_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a context tree and a unigram model, both learned from four fifths of them."""
    return score(table(spark, sf_dir, "documents"))
