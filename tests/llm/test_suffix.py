"""Repeated byte strings against a dictionary of all of them."""

import hashlib
import random
from collections import Counter

import pytest

from webreach.llm import suffix
from webreach.llm.registry import QUERIES

from . import cases


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(r[i: i + length]) for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[hash(r[i: i + length])] > 1:
                gone[i: i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\x00" + gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def same(got, rows, length):
    want = Counter((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], length)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("length", [7, 30, 200])
def test_against_dictionary(spark, length):
    r = random.Random(length)
    pool = [cases.words(i, 40) for i in range(12)]
    rows = []
    for i in range(80):
        text = " ".join(p[(a := r.randrange(len(p))): a + r.randrange(length * 3)] if r.random() < 0.7 else cases.words(i * 7 + j, 30)
                        for j, p in enumerate(r.choices(pool, k=r.randint(1, 5))))
        rows.append((i if i % 11 else None, text))
    rows += cases.edge_rows() + [(50, "ab" * 400), (51, "é" * 99 + "xx"), (52, "é" * 100), (53, pool[0]), (53, pool[0]), (54, pool[0][1:])]
    df = cases.frame(spark, rows)
    got = suffix.remove_repeats(df, length).collect()
    same(got, rows, length)
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in got) and sum(x.n_spans for x in got) > 20
    assert suffix.remove_repeats(df.limit(0), length).count() == 0


def test_given_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH", 100)
    same(QUERIES["op1_suffix_dedup"](spark, cases.SF).collect(), cases.pairs(cases.given(spark)), 200)


def test_hot_anchors_are_split(spark, monkeypatch):
    """A passage between different texts: its outermost anchors have a context in every document."""
    shared, r = cases.words(1, 150), random.Random(4)
    rows = [(i, cases.words(100 + i, 40) + shared + cases.words(300 + i, 40)) for i in range(60)]
    rows += [(100 + i, cases.words(500 + i, 20) + shared[(a := r.randrange(200)): a + r.randrange(100, 400)] + cases.words(600 + i, 20)) for i in range(40)]
    rows += [(200, rows[0][1]), (201, rows[1][1][7:])]
    monkeypatch.setattr(suffix, "HOT", 8)
    sort = suffix._sort_contexts

    def bounded(length):
        inner = sort(length)

        def run(batches):
            batches = list(batches)
            assert max(Counter(h for b in batches for h in b.column(0).to_pylist()).values(), default=0) <= 8
            return inner(iter(batches))
        return run

    monkeypatch.setattr(suffix, "_sort_contexts", bounded)
    for length in (30, 200):
        same(suffix.remove_repeats(cases.frame(spark, rows), length).collect(), rows, length)
