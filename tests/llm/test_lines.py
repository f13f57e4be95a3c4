"""Line dedup against all pairs and the full edit distance."""

import random

import pytest
from pyspark.sql import functions as F

from webreach.llm import lines

from . import cases


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def near(a, b, k):
    return abs(len(a) - len(b)) <= k and distance(a, b) <= k


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_within(spark, edits):
    r = random.Random(edits)
    rows = [("", ""), ("", "abc"), ("abc", ""), ("abc", "abcabc"), ("é\U0001f600", "e\U0001f600")]
    for _ in range(300):
        a = [r.choice("abé\U0001f600") for _ in range(r.randint(0, 14))]
        b = a[:]
        for _ in range(r.randint(0, 4)):
            at = r.randint(0, len(b))
            b[at: at + r.randint(0, 1)] = r.choice(("", "a", "é"))
        rows.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", lines.within(F.col("a"), F.col("b"), edits).alias("ok")).collect()
    assert [(x.a, x.b) for x in got if x.ok != near(x.a, x.b, edits)] == []


def brute(rows, edits, least):
    places, order = {}, []
    for i, h, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if len(line) >= least:
                order.append(((i is not None, i or 0, h, n), line))
    order.sort()
    for p, line in order:
        places.setdefault(line, p)
    first = sorted((p, line) for line, p in places.items())
    gone = {line for j, (_, line) in enumerate(first) if any(near(x, line, edits) for _, x in first[:j])}
    out = []
    for i, h, t in rows:
        parts, kept, exact, close = (t or "").split("\n"), [], 0, 0
        for n, line in enumerate(parts):
            if len(line) < least:
                kept.append(line)
            elif places[line] != (i is not None, i or 0, h, n):
                exact += 1
            elif line in gone:
                close += 1
            else:
                kept.append(line)
        out.append((i, "\n".join(kept), len(parts), exact, close))
    return out


@pytest.mark.parametrize("edits, hot", [(1, 64), (2, 64), (2, 2)])
def test_dedup_against_all_pairs(spark, monkeypatch, edits, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    monkeypatch.setattr(lines, "BLOCK", 3 if hot == 2 else 64)
    r, rows = random.Random(3), []
    pool = [cases.words(i, r.randint(4, 9)) for i in range(40)]
    for i in range(70):
        text = []
        for _ in range(r.randint(0, 6)):
            line = list(r.choice(pool))
            for _ in range(r.choice((0, 0, 1, 2, 3))):
                at = r.randrange(len(line))
                line[at: at + r.choice((0, 1))] = r.choice(("", "x", "é"))
            text.append("".join(line))
        rows.append((i if i % 9 else None, "\n".join(text)))
    rows += [(2, "twice the same row, of some length\nshort"), (2, "twice the same row, of some length\nshort"), (90, ""), (91, None), (92, "\n\n"),
             (93, "\n".join(["one and the same line, over and over"] * 300)), (94, "z" * 3000), (95, "z" * 3001), (96, "a" * 24), (97, "a" * 23)]
    df = cases.frame(spark, rows)
    keyed = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").collect()
    want = brute([tuple(x) for x in keyed], edits, lines.LEAST_CHARS)
    out = lines.dedup(df, edits)
    assert out.select("row.*").columns == df.columns
    got = [tuple(x) for x in out.select("row.doc_id", "text", "n_lines", "n_exact", "n_near").collect()]
    key = lambda x: (x[0] is not None, x)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(x[4] for x in got) > 30
    assert lines.dedup(df.limit(0)).count() == 0


def test_both_ways_to_fetch_texts(spark, monkeypatch):
    df = cases.given(spark).limit(150)
    a = sorted(map(tuple, lines.dedup(df).select("row.doc_id", "text").collect()))
    monkeypatch.setattr(lines, "BROADCAST_IDS", 0)
    assert a == sorted(map(tuple, lines.dedup(df).select("row.doc_id", "text").collect()))


def test_stage_keeps_columns(spark):
    df = cases.given(spark)
    out = lines.stage(spark, df, cases.SF)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.filter("n_chars <> length(text)").count() == 0


def test_short_lines(spark):
    rows = [(1, "Home\n\nAbout us\n}\n\t \nContact page now"), (2, "Home\n\nabout us\n}\n\t \nContact page new\nHome"), (3, "}\nHomes\n ")]
    got = {r.doc_id: tuple(r)[1:] for r in lines.dedup(cases.frame(spark, rows)).select("row.doc_id", "text", "n_lines", "n_exact", "n_near").collect()}
    assert got == {1: (rows[0][1], 6, 0, 0), 2: ("\nabout us\n\t ", 7, 3, 1), 3: ("Homes\n ", 3, 1, 0)}
