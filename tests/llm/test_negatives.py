"""Hard negatives against a scan of all rows."""

import math
import random

import numpy as np
import pytest

from webreach.llm import negatives


def brute(rows):
    """(anchor, positive, rank, negative, scores) by looking at every pair."""
    known = {}
    for i, label, e in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        shifted = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        q = [math.floor(256 * float(np.float32(x))) for x in e]
        if sum(x * x for x in q) < 2 ** 62:
            known[i] = min(known.get(i, (shifted, q)), (shifted, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a, (label, q) in known.items():
        if a % 50:
            continue
        scored = sorted((-dot(q, v), i, lab) for i, (lab, v) in known.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(t, n) for t, n, lab in scored if lab != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out |= {(a, p, r, n, -s, -t) for r, (t, n) in enumerate(fits, 1)}
    return out


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, shard int, q string")
    got = [tuple(r) for r in negatives.mine(df, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def near(rng, n, dim, first=0):
    centre = rng.normal(size=(4, dim))
    return [(first + i, int(rng.integers(0, 3)), (centre[i % 4] + 0.4 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("dim", [6, 5, 1])
def test_equals_a_scan_of_all_rows(spark, dim):
    rows = near(np.random.default_rng(dim), 400, dim)
    assert len(want := brute(rows)) > 20
    assert mined(spark, rows, codes=4, shard_rows=90) == want == mined(spark, rows, codes=16, sample_rows=50)


def test_hot_vector_over_several_shards(spark):
    rng = np.random.default_rng(3)
    rows = near(rng, 150, 4) + [(1000 + i, i % 2, [0.5, 0.25, -0.5, 1.0]) for i in range(200)]
    random.Random(1).shuffle(rows)
    assert mined(spark, rows, codes=4, shard_rows=40) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = near(np.random.default_rng(5), 120, 3) + [
        (200, None, [1.0, 1.0, 1.0]), (201, 1, None), (250, 1, [1.0, None, 0.0]), (202, 2, [math.nan, 0.0, 0.0]), (203, 2, [math.inf, 0.0, 0.0]),
        (None, 1, [1.0, 1.0, 1.0]), (204, 2, [3e38, 0.0, 0.0]), (205, 1, []), (206, 0, [2.0]), (-50, -4, [1.0, 1.0, 1.0]), (-49, -4, [0.5, 1.0, 1.0]),
        (207, 1, [9000.0, 1.0, 2.0]), (300, 1, [1e6, 1e6, 0.0])]
    rows += rows[:60]  # repeated rows
    assert mined(spark, rows, shard_rows=30) == brute(rows)


def test_exact_at_any_size_of_components(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, (rng.normal(size=3) * scale).astype(np.float32).tolist()) for scale in (30.0, 3e4, 5e6) for i in range(100)]
    rows = [(i + 100 * (k // 100), lab, e) for k, (i, lab, e) in enumerate(rows)]
    assert mined(spark, rows, shard_rows=80) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(df).count() == 0
    assert mined(spark, [(50, 1, []), (51, 1, []), (52, 2, [])]) == {(50, 51, 1, 52, 0, 0)}


def test_visits_stop_early():
    """In clustered data a certified search leaves cells unvisited."""
    import pyarrow as pa
    rng = np.random.default_rng(2)
    q = np.concatenate([rng.normal(size=(3000, 8)) * 5 + 1000 * rng.normal(size=8) for _ in range(8)]).astype(np.int32)
    centres = negatives.fit(q[:, :4], 8), negatives.fit(q[:, 4:], 8)
    rows = pa.table({"c1": negatives.nearest(q[:, :4], centres[0]), "c2": negatives.nearest(q[:, 4:], centres[1]), "vec_id": np.arange(len(q)),
                     "label": np.zeros(len(q), np.int32), "q": pa.array([r.tobytes() for r in q], pa.binary())})
    shard = negatives.Shard(rows, centres)
    seen = []
    for at, score, left in shard.visit(q[0]):
        seen.append(len(at))
        if left < np.sort(score)[-5]:
            break
    assert sum(seen) < len(q) / 2
    ids, scores = negatives.positives(shard, 0, 0, q[0], 5)
    full = q.astype(np.int64) @ q[0].astype(np.int64)
    full[0] = -2 ** 62
    assert ids.tolist() == np.lexsort((np.arange(len(q)), -full))[:5].tolist()
