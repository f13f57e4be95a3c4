"""Context-tree scores against a tree of plain dictionaries, the base against plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import edge_rows, frame, given, pairs
from webreach.llm import ctw


def lower(text):
    return (text or "").encode().lower()


def learned(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


class Tree:
    """Counts by (context, bits so far); the weighted probability by its recursion."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.longer, self.known = depth, {}, {}, {}
        for text in texts:
            for context, byte in self.places(text):
                for bit in range(8):
                    for d in range(depth + 1):
                        node = (context[depth - d:], bit, byte >> (8 - bit))
                        self.counts.setdefault(node, [0, 0])[byte >> (7 - bit) & 1] += 1
                        if d:
                            self.longer.setdefault((node[0][1:], bit, node[2]), set()).add(node)

    def places(self, text):
        framed = b"\xff" * self.depth + text + b"\xff"
        return [(framed[i - self.depth: i], framed[i]) for i in range(self.depth, len(framed))]

    def own(self, node):
        a, b = self.counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log(self, node):
        if node not in self.known:
            own = self.own(node)
            if len(node[0]) < self.depth:
                own = np.logaddexp(own, sum(self.log(x) for x in self.longer.get(node, ()))) - math.log(2)
            self.known[node] = own
        return self.known[node]

    def one(self, context, bit, prefix):
        """Probability of a 1, as the ratio that one more 1 makes at every depth of the path."""
        p = None
        for d in range(self.depth, -1, -1):
            node = (context[self.depth - d:], bit, prefix)
            a, b = self.counts.get(node, (0, 0))
            own = (b + 0.5) / (a + b + 1)
            weight = 1.0 if p is None else math.exp(self.own(node) - math.log(2) - self.log(node))
            p = own if p is None else weight * own + (1 - weight) * p
        return p

    def score(self, text):
        total = 0.0
        for context, byte in self.places(text):
            for bit in range(8):
                p = self.one(context, bit, byte >> (8 - bit))
                total += math.log10(p if byte >> (7 - bit) & 1 else 1 - p)
        return total


def check(got, rows, with_tree=True):
    counts = Counter()
    for i, text in rows:
        if learned(i):
            counts.update([*lower(text).split(), None])
    n, v = sum(counts.values()), len(counts)
    tree = Tree([lower(t) for i, t in rows if learned(i)], ctw.DEPTH) if with_tree else None
    want = []
    for i, text in rows:
        words = [*lower(text).split(), None]
        want.append((i, not learned(i), len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), tree.score(lower(text)) if tree else None))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted((tuple(r) for r in got), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
        if tree:
            assert a[6] == pytest.approx(b[6], rel=1e-9)


TEXTS = [None, "", "abracadabra ABRA", "the cat sat on the mat", "the cat\tate\x00the rat\n", "é\U0001f600ü é", "aaaa" * 40, "the cat sat on the mat"]


def test_small_texts_equal_the_recursion(spark):
    rows = [(i, TEXTS[i % len(TEXTS)] if i < 20 else f"the {i} cats of {i * i} mats") for i in range(40)] + [(None, "null id"), (3, "again"), (3, "again")]
    check(ctw.score(frame(spark, rows)).collect(), rows)


@pytest.mark.parametrize("hot", [0, 30])
def test_rare_strings_and_tokens_are_joined(spark, monkeypatch, hot):
    monkeypatch.setattr(ctw, "HOT_GRAMS", hot)
    monkeypatch.setattr(ctw, "HOT_TOKENS", hot)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(24)] + [(None, "unseen words only")]
    check(ctw.score(frame(spark, rows)).collect(), rows)


def test_edge_rows_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK", 1000)  # long texts are taken in blocks
    rows = edge_rows()
    got = ctw.score(frame(spark, rows)).collect()
    check(got, rows, with_tree=False)
    monkeypatch.undo()
    whole = ctw.score(frame(spark, rows)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    for a, b in zip(sorted(got, key=key), sorted(whole, key=key), strict=True):
        assert a.score == pytest.approx(b.score, rel=1e-9)
    assert ctw.score(frame(spark, rows).limit(0)).count() == 0


def test_nothing_learned(spark):
    out = next(i for i in range(100) if not learned(i))
    got = ctw.score(frame(spark, [(out, "ab c")])).first()
    assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (True, 3, 0, 0, 0.0)
    assert got.score == pytest.approx(-5 * 8 * math.log10(2))


def test_given_documents_and_held_out_gain(spark):
    docs = given(spark)
    got = ctw.score(docs).collect()
    check(got, pairs(docs), with_tree=False)
    size = {i: len(lower(t)) for i, t in pairs(docs)}
    held = [r for r in got if r.held_out]
    bits = -sum(r.score for r in held) * math.log2(10) / sum(size[r.doc_id] for r in held)
    assert bits < 2.5  # 8 for even bits, over 4 for single bytes


def test_probabilities_sum_to_one(spark):
    """Over all bytes behind one context, with bytes that were never seen."""
    counts = [((ord("c") << 8 * ctw.DEPTH) | (1 << 8) | b, 3 * (b == 7) + (b == 200), 1) for b in range(256)]
    df = spark.createDataFrame(counts, "gram long, train long, total long")
    assert sum(10 ** r.cost for r in ctw.gram_costs(df).collect()) == pytest.approx(1, rel=1e-9)
