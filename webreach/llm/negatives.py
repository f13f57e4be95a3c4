"""Hard-negative mining with an inverted multi-index.

Two codebooks, one for each half of the vector, form cells; a row stands in the
cell of its two codes. An anchor visits the cells of a shard by a heap over the
two sorted code lists (multi-sequence order): a cell's bound is the sum of its
half bounds, each the centroid's inner product plus the anchor's half norm times
the code's radius. A search stops once no unvisited cell's bound can reach what
it still looks for, so its answer is certified to be that of a full scan.

Shards are runs of cells with about ``SHARD_ROWS`` rows; a cell with more is
dealt over several. Every shard meets every block of anchors, read one after the
other from one sorted partition; only the best rows of each meeting leave it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webreach.llm.common import column, table, whole_groups, written
from webreach.llm.registry import register

#: Codes of each half, and the rows (those with the smallest hash of their id) that they are fitted on.
CODES, SAMPLE_ROWS, ROUNDS = 32, 8192, 10
SHARD_ROWS, ANCHOR_BLOCK, VISIT_ROWS = 16_384, 256, 2048
POSITIVES, NEGATIVES = 5, 3
#: Squared norm, in steps of 1/256, from which a row takes no part: its scores might not fit a long.
TOO_LONG = 2.0 ** 62
_CORE = "vec_id long, label int, c1 int, c2 int, q binary"
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, q): the rows that take part, once an id, with shifted labels and whole components.

    A row takes part if its id, label and vector are given, all components are
    finite, and its squared norm is under ``TOO_LONG``. Of several rows with one
    id the one with the smallest label, then the smallest vector, counts.
    """
    wide = embeddings.select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    q = F.transform("e", lambda x: F.floor(x * 256))
    norm = F.aggregate("e", F.lit(0.0), lambda s, x: s + F.floor(x * 256).cast("double") * F.floor(x * 256).cast("double"))
    finite = F.forall("e", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = wide.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull()).filter(finite).filter(norm < TOO_LONG)
    return rows.select("vec_id", F.struct(label.alias("label"), q.alias("q")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.label", "v.q")


def matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """One row a list; shorter lists are filled up with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim), np.int32)
    out[np.arange(dim) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def fit(rows: np.ndarray, codes: int = CODES, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of Lloyd's rounds, started from rows drawn without repeats of equal ones."""
    rows = rows.astype(np.float64)
    start = np.unique(rows, axis=0)
    centre = start[np.random.default_rng(1).permutation(len(start))[:codes]]
    for _ in range(rounds):
        code = nearest(rows, centre)
        n = np.bincount(code, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, code, rows)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def nearest(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(1) - 2 * rows.astype(np.float64) @ centre.T).argmin(1)


class Shard:
    """Rows of a few cells, sorted by cell, with the codes' radii in this shard."""

    def __init__(self, rows: pa.Table, centres: tuple[np.ndarray, np.ndarray]):
        c1, c2 = (column(rows, c).to_numpy(zero_copy_only=False) for c in ("c1", "c2"))
        cell = c1.astype(np.int64) << 32 | c2
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        self.ids = column(rows, "vec_id").to_numpy(zero_copy_only=False)[order]
        self.labels = column(rows, "label").to_numpy(zero_copy_only=False)[order]
        whole = unpack(column(rows, "q"))[order]
        self.largest = float((whole.astype(np.float64) ** 2).sum(1).max(initial=0))
        self.whole = whole
        self.half = len(centres[0][0])
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cells = {int(c): (int(a), int(b)) for c, a, b in zip(cell[first], first, np.append(first[1:], len(cell)), strict=True)}
        self.codes, self.centre, self.radius = [], [], []
        for code, part, centre in ((c1[order], whole[:, : self.half], centres[0]), (c2[order], whole[:, self.half:], centres[1])):
            far = np.sqrt(((part - centre[code]) ** 2).sum(1))
            own, at = np.unique(code, return_inverse=True)
            radius = np.zeros(len(own))
            np.maximum.at(radius, at, far)
            self.codes.append(own)
            self.centre.append(centre[own])
            self.radius.append(radius)
        self.kept: dict[type, np.ndarray] = {}

    def rows_as(self, largest: float) -> np.ndarray:
        """The rows in the quickest type whose sums of products are exact."""
        kind = np.float32 if largest < 2 ** 24 else np.float64 if largest < 2 ** 53 else np.int64
        if kind not in self.kept:
            self.kept = {kind: self.whole.astype(kind)}
        return self.kept[kind]

    def visit(self, anchor: np.ndarray):
        """Cells by falling bound: yields (rows, scores, bound of all that is left)."""
        wide = anchor.astype(np.float64)
        bounds, order = [], []
        for part, centre, radius in zip((wide[: self.half], wide[self.half:]), self.centre, self.radius, strict=True):
            b = centre @ part + np.sqrt((part * part).sum()) * radius
            by = np.argsort(-b, kind="stable")
            bounds.append(b[by].tolist())
            order.append(by)
        own = float((wide * wide).sum())
        rows = self.rows_as(max(own, self.largest))
        query = anchor.astype(rows.dtype)
        slack = 1 + 1e-9 * (own * self.largest) ** 0.5  # rounding of the bounds
        (u, v), (o, p) = bounds, ([self.codes[h][order[h]].tolist() for h in (0, 1)])
        heap, reach = [(-(u[0] + v[0]), 0, 0)], [0] * len(u)  # reach: how far each first code has got
        held: list[np.ndarray] = []
        n = 0
        while heap:
            _, i, j = heapq.heappop(heap)
            reach[i] = j + 1
            if j + 1 < len(v) and (i == 0 or reach[i - 1] > j + 1):
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if i + 1 < len(u) and reach[i + 1] == j:
                heapq.heappush(heap, (-(u[i + 1] + v[j]), i + 1, j))
            if (span := self.cells.get(o[i] << 32 | p[j])) is not None:
                held.append(np.arange(*span))
                n += span[1] - span[0]
            if held and (n >= VISIT_ROWS or not heap):
                at = np.concatenate(held)
                yield at, (rows[at] @ query).astype(np.int64), -heap[0][0] + slack if heap else -np.inf
                held, n = [], 0


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def positives(shard: Shard, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the shard's first k other rows with the anchor's label."""
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at, score, left in shard.visit(anchor):
        own = (shard.labels[at] == label) & (shard.ids[at] != anchor_id)
        if own.any():
            ids, scores = np.append(ids, shard.ids[at[own]]), np.append(scores, score[own])
            top = best(scores, ids, k)
            ids, scores = ids[top], scores[top]
        if len(ids) == k and left < scores[-1]:
            break
    return ids, scores


def negatives(shard: Shard, label: int, anchor: np.ndarray, windows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each positive's score, ids and scores of the shard's first k rows of other labels within its window."""
    # Python's // floors at any sign
    low, high = [-(-50 * int(s) // 100) for s in windows], [95 * int(s) // 100 for s in windows]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    open_ = {i for i in range(len(windows)) if low[i] <= high[i]}
    for at, score, left in shard.visit(anchor) if open_ else ():
        other = shard.labels[at] != label
        at, score = at[other], score[other]
        for i in list(open_):
            own = (score >= low[i]) & (score <= high[i])
            if own.any():
                ids, scores = np.append(out[i][0], shard.ids[at[own]]), np.append(out[i][1], score[own])
                top = best(scores, ids, k)
                out[i] = ids[top], scores[top]
            if left < low[i] or (len(out[i][0]) == k and left < out[i][1][-1]):
                open_.discard(i)
        if not open_:
            break
    return out


def unpack(q: pa.Array) -> np.ndarray:
    values = q.to_pylist()
    return np.frombuffer(b"".join(values), np.int32).reshape(len(values), -1)


def meetings(index: DataFrame, anchors: DataFrame, shards: int, centres, search, schema: str) -> DataFrame:
    """``search(shard, table of anchors)`` of every shard with every block of anchors."""
    anchors = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = index.withColumn("block", F.lit(-1)).unionByName(anchors, allowMissingColumns=True)
    dealt = both.repartition(max(shards, 1), "shard").sortWithinPartitions("shard", "block", "vec_id")

    def run(batches):
        shard = None
        for rows in whole_groups(batches, ["shard", "block"], 1):
            key = [column(rows, c).to_numpy(zero_copy_only=False) for c in ("shard", "block")]
            edge = np.flatnonzero(np.any([np.diff(k, prepend=-9) != 0 for k in key], axis=0))
            for a, b in zip(edge, np.append(edge[1:], rows.num_rows), strict=True):
                part = rows.slice(a, b - a)
                if key[1][a] < 0:
                    shard = (key[0][a], Shard(part, centres))
                elif shard is not None and shard[0] == key[0][a]:  # a shard may have got no row
                    yield from search(shard[1], part)

    return dealt.mapInArrow(run, schema)


def firsts(df: DataFrame, by: list[str], score: str, ident: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), ident)
    return df.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, every: int = 50, k_pos: int = POSITIVES, k_neg: int = NEGATIVES, codes: int = CODES,
         sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """embeddings(vec_id, label, embedding) -> one row per anchor, positive and negative.

    See ``vectors`` for the rows that take part; of vectors of unequal length the
    shorter ones count as filled up with zeros. Other columns are ignored, an
    empty table gives no rows. Anchors are the ids divisible by ``every``;
    equal scores are ordered by id. The codebooks are fitted on at most
    ``sample_rows`` rows; the answer doesn't rest on them, only the speed does.
    Collected: that sample, and one count a cell (codes squared at most).
    """
    spark = embeddings.sparkSession
    rows = written(vectors(embeddings), "negatives-vectors")
    dim = rows.agg(F.max(F.size("q"))).first()[0]
    if not dim:
        dim = 1  # no rows, or none with a component
    half = max(1, dim // 2)
    if dim == 1:
        dim = 2
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("q").toArrow()["q"].combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], _OUT)
    known = matrix(sample, dim)
    centres = fit(known[:, :half], codes), fit(known[:, half:], codes)

    def assign(batches):
        for batch in batches:
            q = matrix(column(batch, "q"), dim)
            code = [pa.array(nearest(part, centre).astype(np.int32)) for part, centre in zip((q[:, :half], q[:, half:]), centres, strict=True)]
            packed = pa.array([r.tobytes() for r in q], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "label"), *code, packed], ["vec_id", "label", "c1", "c2", "q"])

    cells = rows.mapInArrow(assign, _CORE)
    cells = written(cells, "negatives-cells")
    counts = sorted((r.c1, r.c2, r.n) for r in cells.groupBy("c1", "c2").agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0] + [n for *_, n in counts]).tolist()
    places = spark.createDataFrame([(c1, c2, n, b) for (c1, c2, n), b in zip(counts, before, strict=False)], "c1 int, c2 int, n long, start long")
    shards = -(-before[-1] // shard_rows)
    shard = F.floor((F.col("start") + F.pmod(F.xxhash64("vec_id"), "n")) / shard_rows).cast("int")
    index = cells.join(F.broadcast(places), ["c1", "c2"]).select("*", shard.alias("shard")).drop("n", "start")
    asked = cells.filter(F.col("vec_id") % every == 0).drop("c1", "c2")
    block = F.floor(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, before[-1] // every // ANCHOR_BLOCK)))).cast("int")
    asked = asked.withColumn("block", block)

    def find_positives(shard, part):
        q = unpack(column(part, "q"))
        found = [(a, *positives(shard, a, lab, vec, k_pos)) for a, lab, vec in zip(column(part, "vec_id").to_pylist(), column(part, "label").to_pylist(), q, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
             pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["anchor_id", "positive_id", "positive_score"])

    near = meetings(index, asked, shards, centres, find_positives, "anchor_id long, positive_id long, positive_score long")
    near = written(firsts(near, ["anchor_id"], "positive_score", "positive_id", k_pos).drop("rank"), "negatives-positives")
    pairs = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("pairs"))  # k_pos at most

    def find_negatives(shard, part):
        q, out = unpack(column(part, "q")), []
        for a, lab, vec, wanted in zip(column(part, "vec_id").to_pylist(), column(part, "label").to_pylist(), q, column(part, "pairs").to_pylist(), strict=True):
            found = negatives(shard, lab, vec, np.array([w["positive_score"] for w in wanted], np.int64), k_neg)
            out += [(a, w["positive_id"], w["positive_score"], i, s) for w, (ids, scores) in zip(wanted, found, strict=True) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names)

    far = meetings(index, asked.join(pairs, "vec_id"), shards, centres, find_negatives,
                   "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    out = firsts(far, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", k_neg)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 3
"""


@register("op11_hard_negatives", ORACLE)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every 50th row of ``embeddings``."""
    return mine(table(spark, sf_dir, "embeddings"))
