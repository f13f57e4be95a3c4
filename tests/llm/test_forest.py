"""The Jaccard join against all pairs, and components against a union of sets."""

import random
import re

import numpy as np
import pytest

from webreach.llm import forest
from webreach.llm.common import components

from . import cases


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc_id -> (n_links, n_copies), and groups of doc_ids."""
    own = [sets(t) for _, t in rows]
    distinct = sorted(set(own) - {frozenset()}, key=sorted)
    link = {s: set() for s in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 5 * len(a & b) >= 4 * len(a | b):
                link[a].add(b)
                link[b].add(a)
    group = {}
    for s in distinct:
        todo, members = [s], set()
        while todo:
            x = todo.pop()
            if x not in members:
                members.add(x)
                todo += link[x]
        group[s] = frozenset(members)
    return own, link, group


def near_rows(r, n):
    rows = []
    for i in range(n):
        if rows and r.random() < 0.85:
            w = r.choice(rows)[1].split(" ")
            for _ in range(r.choice((0, 1, 1, 2, 3))):
                w[r.randrange(len(w))] = r.choice(("x", "y", "z"))
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, cases.words(i, r.choice((3, 60, 120, 200)))))
    return rows


def check(df, rows):
    own, link, group = brute(rows)
    got = forest.join(df).collect()
    assert len(got) == len(rows)
    texts, first = {}, {}
    for (i, _), s in zip(rows, own):
        texts.setdefault(i, []).append(s)
        if s and i is not None:
            first[group[s]] = min(first.get(group[s], i), i)
    for r in got:
        if r.doc_id is None:
            continue
        wants = [(len(link[s]), own.count(s), first[group[s]]) if s else (0, 1, r.doc_id) for s in texts[r.doc_id]]
        assert (r.n_links, r.n_copies, r.class_id) in wants, r
    return got


@pytest.mark.parametrize("block", [512, 3])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK", block)
    rows = near_rows(random.Random(4), 150) + [(200 + i, t) for i, (_, t) in enumerate(cases.edge_rows()[:6])] + [(300, "a b"), (301, "a  b"), (302, "a b c"), (303, None), (304, "a b"), (304, "a b"), (None, "q r")]
    got = check(cases.frame(spark, rows), rows)
    assert sum(r.n_links for r in got) > 100
    assert forest.join(cases.frame(spark, rows).limit(0)).count() == 0


def test_given_documents(spark):
    check(cases.given(spark), cases.pairs(cases.given(spark)))


def test_stage_keeps_one_of_each_class(spark):
    rows = [(1, cases.words(1, 40)), (2, cases.words(1, 40) + " z"), (3, cases.words(3, 40)), (3, cases.words(3, 40)), (4, ""), (5, None), (6, ""), (None, cases.words(1, 40)), (None, cases.words(9, 9))]
    df = cases.frame(spark, rows)
    out = forest.stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0)]
    docs = cases.given(spark)
    own, _, group = brute(cases.pairs(docs))
    left = forest.stage(spark, docs, "")
    assert left.count() == len({group[s] for s in own if s}) + sum(not s for s in own)
    assert left.columns == docs.columns


def test_depth_and_estimates():
    assert forest.depth_for() == 4 and forest.depth_for(recall=0.999) == 5 and forest.depth_for(0.1) == 1
    r = random.Random(1)
    a = [r.getrandbits(64) for _ in range(1000)]
    value = np.array(sorted(a) + sorted(a[:500]), np.uint64)
    sig = forest.signatures(value, np.array([0, 1000, 1500]))
    assert abs(np.mean(sig[0] == sig[1]) - 0.5) < 0.2


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 470)] + [(500, x) for x in range(501, 700)]
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in root if find(x) != x}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(x) for x in components(df, "t").collect()} == want
    assert components(df.limit(0), "t").count() == 0
