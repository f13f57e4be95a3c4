"""Packing against the tokenizer, decontamination against full edit distances."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from webreach.llm import decontam, packing
from webreach.llm.common import table

from . import cases


def check_packing(pieces, rows, capacity):
    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    want = sorted((i is None, i or 0, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in rows)
    got, sequences = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        got.setdefault((p.doc_id is None, p.doc_id or 0, p.doc_tokens), {}).setdefault(p.start, []).append(ids)
    have = []
    for (null, doc, n), parts in got.items():
        copies = max(map(len, parts.values()))
        for c in range(copies):  # copies of a row have the same ids, wherever they were cut
            whole, at = [], 0
            while at < n:
                whole += parts[at].pop()
                at = len(whole)
            have.append((null, doc, whole))
        assert not any(parts.values())
    assert sorted(have) == want
    padding = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        padding += capacity - at
    return padding


def test_packing(spark):
    docs = cases.given(spark)
    assert check_packing(packing.pack(docs, packing.tokenizer_path()).collect(), cases.pairs(docs), 2048) < 2048
    odd = ["don't  stop", " lead", "trail ", "a b c　d", "x '  's 'll", "<|endoftext|> x", "1 2\t3\r\n\n4", "ß é × ÷ à\u0085b", "日本 語 text"]
    rows = [(i, t) for i, t in cases.edge_rows() if i != 7] + [(30 + i, t) for i, t in enumerate(odd)] + [(7, "same"), (7, "same")]
    df = cases.frame(spark, rows)
    check_packing(packing.pack(df, packing.tokenizer_path(), capacity=64).collect(), rows, 64)
    assert packing.pack(df.limit(0), packing.tokenizer_path()).count() == 0
    for r in packing.digest(packing.pack(df, packing.tokenizer_path())).limit(5).collect():
        assert r.ids_crc32 < 1 << 32
    assert zlib.crc32(np.array([1], "<u4").tobytes()) in {r.ids_crc32 for r in packing.digest(packing.pack(df, packing.tokenizer_path())).collect() if r.doc_tokens == 1}


def test_assign_balances():
    lengths = np.array([10, 10, 6, 6, 4, 4])
    plan = packing.assign(lengths, 20, 1.0, 0.1)
    load = {}
    for _, _, n, s, _ in plan:
        load.setdefault(s, []).append(n)
    assert sorted(map(sorted, load.values())) == [[4, 6, 10], [4, 6, 10]]


def least(pattern, text):
    """Edits of pattern against the best part of text."""
    prev = np.zeros(len(text) + 1, int)
    for j, c in enumerate(pattern, 1):
        cur = np.minimum(np.append(j, prev[:-1] + (text != c)), prev + 1)
        cur[0] = j
        prev = np.minimum.accumulate(cur - np.arange(len(cur))) + np.arange(len(cur))
    return int(prev.min())


def says(window):
    """The docstring's rule for windows that count, by plain sets."""
    n, q = len(window), decontam.Q
    grams = {bytes(window[i: i + q]) for i in range(n - q + 1)}
    words = sum(chr(c).isalnum() if c < 128 else True for c in window)
    return sum(len(set(g)) > 2 for g in grams) >= q * decontam.budget(n, decontam.EDITS) + min(decontam.SPARE, n - q + 1) and 2 * words >= n


def test_decontam_against_full_distances(spark):
    r = random.Random(5)
    items = [(i, cases.words(9000 + i, n)) for i, n in enumerate((12, 20, 40, 60, 9, 30))] + [(6, ""), (7, None), (8, "short")]
    rows = []
    for i in range(60):
        text = cases.words(500 + i, r.randint(5, 200))
        if i % 3:
            piece = list(items[i % 6][1])
            for _ in range(r.choice((0, 1, 3, 6, 9, 14))):
                at = r.randrange(len(piece))
                piece[at: at + r.choice((0, 1))] = r.choice(("", "x", "q"))
            piece = "".join(piece)
            piece = (piece.upper() if i % 2 else piece.replace(" ", "\n"))[: r.choice((1000, 130))]
            at = r.randrange(len(text))
            text = text[:at] + " " + piece + " " + text[at:]
        rows.append((i, text))
    rows += [(i and i + 100, t) for i, t in cases.edge_rows()]
    df, bench = cases.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    fold = lambda t: decontam._FOLD[np.frombuffer(t.encode(), np.uint8)]
    want = set()
    for d, text in rows:
        body = fold(text or "")
        if len(body) > 20_000:
            continue
        for i, item in items:
            p = fold(item or "")
            if len(p) >= 16 and any(says(p[a:b]) and least(p[a:b], body) <= decontam.budget(b - a, decontam.EDITS) for a, b in decontam.windows(len(p))):
                want.add((d, i))
    found = decontam.find(df, bench).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want and len(want) > 12
    bad = {d for d, _ in want}
    left = decontam.clean(df, bench)
    assert left.columns == df.columns
    assert sorted(str(x.doc_id) for x in left.collect()) == sorted(str(d) for d, _ in rows if d not in bad)
    assert decontam.find(df.limit(0), bench).count() == 0 and decontam.find(df, bench.limit(0)).count() == 0
    assert decontam.clean(df, bench.limit(0)).count() == len(rows)


def test_decontam_in_blocks(spark, monkeypatch):
    docs, bench = cases.given(spark), table(spark, cases.SF, "benchmark")
    whole = sorted(map(tuple, decontam.find(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(decontam, "HITS", 1000)
    assert sorted(map(tuple, decontam.find(docs, bench).collect())) == whole
    texts, items = dict(cases.pairs(docs)), {r.item_id: r.text for r in bench.collect()}
    planted = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert planted and planted <= {(x[0], x[1]) for x in whole}


def test_decontam_short_quotes_at_every_offset():
    item, noise = cases.words(77, 60), [cases.words(800 + i, 20).upper() + " 0 " for i in range(2)]
    raw = item.encode()
    index = decontam.build([(1, item, 1), (2, cases.words(78, 60), 1)], decontam.EDITS)
    for n in (50, 60, 75, 88, 100):
        for edits in (0, 2) if n < 75 else (0,):
            pieces = [bytearray(raw[a: a + n]) for a in range(len(raw) - n + 1)]
            for piece in pieces:
                for e in range(edits):
                    piece[(e + 1) * n // 3] = ord("#")
            texts = [noise[0].encode() + bytes(x) + noise[1].encode() for x in pieces]
            at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            found = decontam.leaks(index, np.frombuffer(b"".join(texts), np.uint8), at, decontam.EDITS)
            assert {r for r, i in found if i == 0} == set(range(len(texts))), (n, edits)
            assert not [i for _, i in found if i == 1]


def test_rules_and_blanks_are_no_leaks(spark):
    """Lines of marks, indentation, tables and repeats that an item and a text share say nothing."""
    for shared in ("-" * 70, " " * 80, "=-" * 40, "| --- " * 15, "." * 90, "0" * 70, "ab" * 50, "x\t\t" + "\n" * 80, "la " * 40):
        item = cases.words(1, 12) + "\n" + shared + "\n" + cases.words(2, 12)
        rows = [(1, cases.words(3, 30) + shared + cases.words(4, 30)), (2, item)]
        bench = spark.createDataFrame([(7, item)], "item_id long, text string")
        assert {r.doc_id for r in decontam.find(cases.frame(spark, rows), bench).collect()} == {2}, shared


def test_short_items_whole(spark):
    items = [(1, "Sum of 3 plus"), (2, "tiny"), (3, "-- -- --"), (4, " ninebytes "), (4, " ninebytes "), (5, "né")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "what is the SUM\nof 3 plus 4"), (2, "sum of 3 pluses"), (3, "tiny"), (4, "a tiny text"), (5, "x\n  TINY \ny"), (6, "-- -- --"), (7, "(ninebytes)"), (8, "xninebytes"), (9, "né\n"), (10, "née"), (11, None)]
    got = sorted((r.doc_id, r.item_id) for r in decontam.find(cases.frame(spark, rows), bench).collect())
    assert got == [(1, 1), (3, 2), (5, 2), (7, 4), (7, 4), (9, 5)]


def test_long_uniform_texts_in_bounded_memory():
    import resource
    import time
    item = cases.words(1, 30) + " " * 200 + "-" * 100 + "abcabcabcabc" + cases.words(2, 30)
    index = decontam.build([(1, item, 1)], decontam.EDITS)
    before, t = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    for text in (b" " * 10_000_000, b"-" * 10_000_000, b"abc" * 1_000_000):
        assert decontam.leaks(index, np.frombuffer(text, np.uint8), np.array([0, len(text)]), decontam.EDITS) == {}
    assert time.time() - t < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_special_tokens_as_the_tokenizer_alone(spark):
    t = Tokenizer.from_file(packing.tokenizer_path())
    end = "<|endoftext|>"
    rows = [(i, x) for i, x in enumerate([f"{end} z", f"a {end}", f"don't  {end}\n\nß{end}{end}", f"x{end}y", "<|endof", "text|> w", "<|endoftext |>", f" {end}s  b", f"{end}<|endoftext", "|>", "", end])]
    want = [[*t.encode(x, add_special_tokens=False).ids, packing.END_ID] for _, x in rows]
    raw = "".join(x for _, x in rows).encode()
    ids, offsets = packing.Words(packing.tokenizer_path(), special=True).encode(np.frombuffer(raw, np.uint8), np.cumsum([0] + [len(x.encode()) for _, x in rows]))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    got = {r.doc_id: (r.length, r.doc_tokens, r.ids_crc32) for r in packing.stage(spark, cases.frame(spark, rows), cases.SF).collect()}
    assert got == {i: (len(w), len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for (i, _), w in zip(rows, want)}
