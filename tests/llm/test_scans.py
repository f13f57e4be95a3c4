"""License scans, personal data and quality rules against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from webreach.llm import crf, license, pii, quality
from webreach.llm.common import table

from . import cases


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check_license(got, rows):
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        wants = []
        for t in texts[r.doc_id]:
            w = cases.LICENSE_WORD.findall(lower(t))
            at, labels = [], set()
            for phrase, label in license.PHRASES:
                p = phrase.split()
                mine = [i for i in range(len(w) - len(p) + 1) if w[i: i + len(p)] == p]
                at += mine
                labels |= {label} if mine else set()
            wants.append((len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in wants
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license(spark):
    docs = cases.given(spark)
    check_license(license.scan(docs).collect(), cases.pairs(docs))
    mit, gpl = license.TEMPLATES[0][1], license.TEMPLATES[3][1]
    rows = cases.edge_rows() + [
        (20, "CC  by cc-by cc.by cc by All rights Reserved. all rights"), (21, "cc by" * 3), (22, "general\npublic\nlicense by cc"),
        (23, "Foo " + mit.capitalize() + ", bar"), (24, " ".join(w for i, w in enumerate(mit.split()) if i not in (9, 14))),
        (25, mit.replace("hereby", "not")), (26, gpl), (27, "cc"), (28, "by general public"),
        (29, "Licensed under the Apache License, Version 2.0."), (30, "Licensed under CC BY-NC 4.0.")]
    got = license.scan(cases.frame(spark, rows)).collect()
    check_license(got, rows)
    by = {r.doc_id: r for r in got}
    assert by[23].labels == by[24].labels == "mit" and by[24].score < by[23].score == 1 and by[25].labels == "" and by[26].labels == "gpl"
    assert by[29].labels == "apache-2.0" and by[30].labels == "cc-by,cc-by-nc"
    assert license.scan(cases.frame(spark, rows).limit(0)).count() == 0


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def check_pii(got, rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(base(t))
    for r in got:
        wants = {hashlib.sha256((s := ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in found)).encode()).hexdigest(): (found, s) for found in texts[r.doc_id]}
        found, line = wants[r.base_sha256]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in found) for j in range(4))
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_pii(spark):
    docs = cases.given(spark)
    rows = cases.pairs(docs)
    got = pii.find(docs).collect()
    check_pii(got, rows)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 20
    assert not [r.spans for r in got if r.spans and r.n_email + r.n_ip + r.n_card + r.n_phone == 0]  # clean texts stay clean
    edge = cases.edge_rows() + [
        (20, "é a.b@c.d.e, x@y z@w. a@b.c@d.e 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004"), (21, "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111"),
        (22, "+1 (415) 555-2671 +12 +1 (2) 3) +123456789012345678 +1.415.555.2671."), (23, "+1 415 555 2671 4111111111111111 10.0.0.1@a.b"),
        (24, "Call me at (415) 555-2671, or 415-555-2671 now\non 2024-05-06 for $123.45")]
    got = pii.find(cases.frame(spark, edge)).collect()
    check_pii(got, edge)
    assert len(got) == len(edge)
    assert {r.doc_id: r.spans for r in got}[24] == "phone:11:25,phone:30:42"
    assert pii.find(cases.frame(spark, edge).limit(0)).count() == 0


def check_quality(got, rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    assert len(got) == len(rows)
    for r in got:
        wants = []
        for t in texts[r.doc_id]:
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            seen, dup = set(), 0
            for line in t.split("\n"):
                if re.search(r"[^\x20\x09-\x0D]", line):
                    dup += line in seen
                    seen.add(line)
            c = Counter(tuple(w[i: i + 5]) for i in range(len(w) - 4))
            hit = {j for i in range(len(w) - 4) if c[tuple(w[i: i + 5])] > 1 for j in range(i, i + 5)}
            wants.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)))
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert own in wants
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.content_share >= 0.5)


def test_quality(spark):
    docs, labels = cases.given(spark), table(spark, cases.SF, "labels")
    field = quality.fit(docs, labels)
    got = quality.score(docs, field).collect()
    check_quality(got, cases.pairs(docs))
    want = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id: r.kept for r in got}
    good, bad = [i for i in want if want[i]], [i for i in want if not want[i]]
    assert sum(kept[i] for i in good) >= 0.97 * len(good) and sum(kept[i] for i in bad) <= 0.15 * len(bad)
    edge = cases.edge_rows()
    check_quality(quality.score(cases.frame(spark, edge), field).collect(), edge)
    left = quality.keep(cases.frame(spark, edge), field)
    assert left.columns == cases.frame(spark, edge).columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == sorted(r.doc_id or 0 for r in quality.score(cases.frame(spark, edge), field).collect() if r.kept)
    assert quality.score(docs.limit(0), field).count() == 0
    none = quality.fit(docs, labels.limit(0))  # no labels: every line is content
    assert all(r.kept != r.base_failed for r in quality.score(docs, none).collect())


def test_viterbi_and_fit_against_enumeration():
    import itertools
    rng = np.random.default_rng(1)
    c = crf.Crf(rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = np.array([4, 1, 3])
    features = rng.integers(0, 5, (8, 2))
    s, at, got = crf.scores(c, features), 0, crf.viterbi(c, crf.scores(c, features), lengths)
    for n in lengths:
        value = lambda y: c.first[y[0]] + sum(s[at + i, y[i]] for i in range(n)) + sum(c.step[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        assert tuple(got[at: at + n]) == max(itertools.product(range(3), repeat=int(n)), key=value)
        at += n
    labels = features[:, 0] % 3
    learned = crf.fit(features, labels, lengths, 5, 3)
    assert (crf.viterbi(learned, crf.scores(learned, features), lengths) == labels).all()
    assert len(crf.viterbi(c, np.zeros((0, 3)), np.zeros(0, int))) == 0


def test_pii_held_out():
    rows = pii.labelled(400, 99)
    field = pii.model()
    buf = np.frombuffer("\n".join(" ".join(w) for w, _ in rows).encode() + b"\n", np.uint8)
    _, _, features, lengths = pii.shapes(buf)
    got = crf.viterbi(field, crf.scores(field, features), lengths)
    assert np.mean(got == np.array([y for _, ys in rows for y in ys])) > 0.98


@pytest.mark.parametrize("text", ["", "a", " a", "a ", "\n", "é é"])
def test_measure_small(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    assert quality.measure(raw, np.array([0, len(raw)]))["n_words"].tolist() == [len(text.split())]


def test_license_in_every_row(spark):
    for label, text, _ in license.TEMPLATES:
        for n in (1, 3):
            rows = [(i, f"/* {text} */") for i in range(n)]
            for r in license.scan(cases.frame(spark, rows)).collect():
                assert label in r.labels.split(",") and r.score == 1


def by_trying(text, templates, weight, drift, least):
    """(labels, score) of one text: every template at every place."""
    w, labels, score = cases.LICENSE_WORD.findall(lower(text)), set(), 0.0
    for label, t, key in templates:
        t, key = cases.LICENSE_WORD.findall(lower(t)), cases.LICENSE_WORD.findall(lower(key))
        total = sum(weight[x] for x in t)
        for d in range(-len(t) - drift, len(w) + drift + 1):
            window = w[max(0, d - drift): max(0, d + len(t) + drift)]
            if key and not any(window[i: i + len(key)] == key for i in range(len(window))):
                continue
            share = sum(weight[x] for q, x in enumerate(t) if any(0 <= d + q + o < len(w) and w[d + q + o] == x for o in range(-drift, drift + 1))) / total
            if share >= least - 1e-12:
                labels.add(label)
                score = max(score, share)
    return labels, score


def license_rows(templates, seed=5):
    """Templates with words dropped, doubled, changed or moved, alone and in a row, among words of the templates."""
    import random
    r = random.Random(seed)
    pool = [w for _, t, _ in templates for w in t.split()]
    rows = []
    for i in range(160):
        words = [r.choice(pool) for _ in range(r.randint(0, 30))]
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            rate = r.choice((0, 0.05, 0.2, 0.35))
            for w in r.choice(templates)[1].split():
                x = r.random()
                words += [] if x < rate / 3 else [w, w] if x < rate / 2 else [r.choice(pool)] if x < rate else [w]
            words += [r.choice(pool) for _ in range(r.randint(0, 12))]
        rows.append((i, r.choice((" ", ", ", "\n * ")).join(words)))
    return rows + [(900, None), (901, ""), (902, "software " * 3000), (903, " ".join(pool) + " software" * 3000), (903, " ".join(pool) + " software" * 3000)]


TABLE = [("mit", license.TEMPLATES[0][1], license.TEMPLATES[0][2]),
         ("mit", "the Software is provided as is without Warranty of any kind express or implied including but not limited to the warranties of merchantability", "without warranty of any kind"),
         ("no-key", "may be used freely by the the the public for any purpose", None), ("foreign-key", "a notice that names nothing", "lizenz é"),
         ("empty", "", "x"), ("none", None, "x"), (None, "a nameless template", "a")]


@pytest.mark.parametrize("drift,least,own", [(3, 0.6, False), (0, 0.5, True), (3, 0.6, True), (2, 1.0, True)])
def test_license_labels_are_those_of_every_place(spark, monkeypatch, drift, least, own):
    monkeypatch.setattr(license, "BLOCK_WORDS", 50)
    templates = [t for t in TABLE if t[0] and t[1]] if own else list(license.TEMPLATES)
    rows = license_rows([(label, text, key) for label, text, key in templates])
    rows += [(904, "a notice that names nothing lizenz é"), (905, "MAY be used freely, by the the the public: for any purpose")]
    docs = cases.frame(spark, rows)
    table = spark.createDataFrame([(*t, 1) for t in TABLE], "label string, text string, key string, doc_id int") if own else None
    got = license.scan(docs, table, drift=drift, least=least).collect()
    check_license(got, rows)
    n = len(rows)
    df = Counter(w for _, t in rows for w in set(cases.LICENSE_WORD.findall(lower(t))))
    weight = {w: float(np.log1p((n + 1) / (df[w] + 1))) for _, t, _ in templates for w in cases.LICENSE_WORD.findall(lower(t))}
    texts = dict(rows)
    seen = Counter()
    for r in got:
        labels, score = by_trying(texts[r.doc_id], templates, weight, drift, least)
        base = set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == labels | base, r.doc_id
        assert abs(r.score - (1.0 if base else score)) < 1e-9
        seen[len(labels)] += 1
    assert seen[1] > 10 and seen[0] > 10


def test_license_table_over_its_bound(spark, monkeypatch):
    monkeypatch.setattr(license, "TEMPLATE_BYTES", 10)
    with pytest.raises(ValueError):
        license.scan(cases.frame(spark, [(1, "a")]), spark.createDataFrame([("x", "some words of a template", None)], "label string, text string, key string"))
    monkeypatch.undo()
    none = license.scan(cases.frame(spark, [(1, "a cc by")]), spark.createDataFrame([], "label string, text string, key string")).first()
    assert (none.labels, none.score) == ("cc-by", 1.0)
