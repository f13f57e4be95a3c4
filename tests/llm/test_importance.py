"""Importance resampling against plain Python, and against its SQL."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np

from tests.llm.cases import SF, edge_rows, frame, given, pairs
from webreach.llm import importance
from webreach.llm.registry import ORACLE, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def brute(docs, target):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for texts, out in ((docs, s), (target, t)):
        for _, text in texts:
            for b in buckets(text)[1]:
                out[b] += 1
    big_s, big_t = int(s.sum()) + 10000, int(t.sum()) + 10000
    out = []
    for i, text in docs:
        n, b = buckets(text)
        gain = [math.floor(1000 * math.log((int(t[x]) + 1) * big_s / ((int(s[x]) + 1) * big_t))) for x in b]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(order[: 25 * len(order) // 100], 1):
        rank.setdefault(r[:4], []).append(k)
    return out, rank


def check(got, docs, target):
    want, rank = brute(docs, target)
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted((r[:4] for r in want), key=key)
    mine = {}
    for r in got:
        if r["rank"] is not None:
            mine.setdefault((r.doc_id, r.n_features, r.weight, r.score), []).append(r["rank"])
    assert {k: sorted(v) for k, v in mine.items()} == rank


def test_given_documents(spark):
    docs, target = given(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    check(importance.resample(docs, target).collect(), pairs(docs), [(r.item_id, r.text) for r in target.collect()])


def test_cases(spark):
    rows = edge_rows() + [(20 + i, "Mixed CASE words, 123abc ÄÖ ñandú-x " * (i + 1)) for i in range(30)] + [(99, "q" * 70_000 + " " + "w" * 1025 + " " + "w" * 1024 + " q q")]
    rows += [(i, t) for i, t in rows[:12]]  # repeated rows
    target = [(1, None), (2, "mixed words"), (3, "q q q"), (3, "q q q")]
    df = frame(spark, rows).withColumnRenamed("row", "rank")
    goal = spark.createDataFrame([(i, t, 1) for i, t in target], "item_id long, text string, bucket int")
    check(importance.resample(df, goal).collect(), rows, target)
    check(importance.resample(df, goal.limit(0)).collect(), rows, [])
    assert importance.resample(df.limit(0), goal).count() == 0


def test_composed_crc():
    r = np.random.default_rng(4)
    a, b = ([r.integers(0, 256, int(n)).astype(np.uint8).tobytes() for n in r.integers(0, 400, 300)] for _ in range(2))
    b[0] = bytes(100_003)
    got = importance.joined(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + b" " + y) for x, y in zip(a, b, strict=True)]


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLE["op12_importance_resampling"])
    names = [c[0] for c in cur.description]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = QUERIES["op12_importance_resampling"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got), key=key) == sorted(cur.fetchall(), key=key)
