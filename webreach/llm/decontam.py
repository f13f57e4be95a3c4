"""Benchmark decontamination by the q-gram lemma.

Items are cut into overlapping windows. A text that holds a window of n
characters with at most k edits shares n - q + 1 - k * q of its q-grams with it
on diagonals that differ by at most k. Shared q-grams are counted in diagonal
bands of 2 (k + 1) that overlap by half; regions that reach the bound are
verified by a banded alignment. Characters are UTF-8 bytes, A-Z in lower case
and white space as a blank.

A window counts only if it says something: half of its bytes stand in words,
and enough of its q-grams are distinct and hold more than two different bytes.
Other q-grams (blanks, rules, "-=-=") are neither indexed nor looked up, and the
lemma's bound is lowered by those that a window holds. Items too short for a
window are looked for as they are: word by word, the shortest as whole lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.llm.common import chunks, table
from webreach.llm.registry import register

Q = 8
#: The shortest passage of a longer item that counts, at every place of the item.
WINDOW, STRIDE, EDITS = 50, 1, 0.08
#: Text of the benchmark that is looked for at a time; a longer table is taken in blocks.
BLOCK_BYTES = 2 << 20
#: Shared q-grams that are held at a time.
HITS = 1 << 18
#: Bands that are looked into together.
BANDS = 1 << 14
#: Windows that are aligned together, and those that are held at a time.
PAIRS, HELD = 4096, 1 << 16
#: Distinct q-grams that a window needs beyond those that its edits may spoil.
SPARE = 6
#: Shorter items are looked for as they are; those under ``Q`` bytes as whole lines.
SHORT = 2 * Q
_TABLE_BITS = 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


@dataclass(frozen=True)
class Index:
    items: list                # item ids
    times: list                # rows of each item
    text: list                 # their folded texts
    filter: np.ndarray         # bit table over hashed q-grams
    codes: np.ndarray          # distinct q-grams, sorted
    first: np.ndarray          # of each: its first posting
    item: np.ndarray           # postings
    pos: np.ndarray
    band: int                  # k + 1 of the longest window
    least: np.ndarray          # per item: the smallest bound of its windows
    windows: list              # per item: starts and bounds of its windows
    short: object              # automaton of short items, or None


def grams(raw: np.ndarray) -> np.ndarray:
    """The q-gram of every position, as a number; the last q - 1 positions have none."""
    if len(raw) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(raw) - Q + 1,), "<u8", np.ascontiguousarray(raw), strides=(1,)).copy()


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def budget(n: int, edits: float) -> int:
    """Edits that a window of n characters may have; few enough for a bound of at least q."""
    return max(0, min(int(n * edits), (n - 2 * Q + 1) // Q))


def windows(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[tuple[int, int]]:
    if n <= window:
        return [(0, n)]
    return [(s, s + window) for s in range(0, n - window, stride)] + [(n - window, n)]


def telling(codes: np.ndarray) -> np.ndarray:
    """Whether a q-gram holds more than two different bytes."""
    byte = np.ascontiguousarray(codes).view(np.uint8).reshape(-1, Q)
    first = byte[:, :1]
    other = np.where(byte != first, byte, 0).max(1, initial=0)[:, None]  # some byte that differs from the first, if there is one
    return ((byte != first) & (byte != other)).any(1)


def counting(raw: np.ndarray, edits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an item: starts and bounds of the windows that count, its q-grams, and which of these are looked up."""
    size = min(WINDOW, len(raw))
    first = np.append(np.arange(0, len(raw) - size, STRIDE), len(raw) - size)
    g = grams(raw)
    said = telling(g)
    upto = lambda x: np.append(0, np.cumsum(x))
    many = upto(said)
    # the place of the same q-gram before: a window's distinct ones are those without such a place inside
    order = np.argsort(g, kind="stable")
    before = np.full(len(g), -1)
    same = np.flatnonzero(g[order][1:] == g[order][:-1])
    before[order[same + 1]] = order[same]
    distinct = np.zeros(len(first), np.int64)
    for a in range(0, len(first), PAIRS):
        inside = first[a: a + PAIRS, None] + np.arange(size - Q + 1)
        distinct[a: a + PAIRS] = (said[inside] & (before[inside] < first[a: a + PAIRS, None])).sum(1)
    words = upto(_IN_WORD[raw])
    most = budget(size, edits)
    ok = (distinct >= Q * most + min(SPARE, size - Q + 1)) & (2 * (words[first + size] - words[first]) >= size)
    first = first[ok]
    looked = np.zeros(len(g) + 1, np.int64)
    np.add.at(looked, first, 1)
    np.add.at(looked, first + size - Q + 1, -1)
    return first, many[first + size - Q + 1] - many[first] - Q * most, g, said & (np.cumsum(looked[:-1]) > 0)


def build(items: list[tuple[int, str, int]], edits: float) -> Index:
    """items: (id, text, number of equal rows)."""
    ids, times, texts, codes, item, pos, least, wins, short = [], [], [], [], [], [], [], [], {}
    for item_id, text, n in items:
        raw = _FOLD[np.frombuffer((text or "").encode(), np.uint8)]
        if len(raw) < SHORT:
            raw = raw[slice(*_trim(raw))]
            if len(raw) and 2 * np.count_nonzero(_IN_WORD[raw]) >= len(raw):
                short.setdefault(raw.tobytes().decode("latin-1"), []).append(len(ids))
        else:
            first, bound, g, looked = counting(raw, edits)
            if not len(first):
                continue
            codes.append(g[looked])
            item.append(np.full(int(looked.sum()), len(ids), np.int32))
            pos.append(np.flatnonzero(looked).astype(np.int32))
        known = len(raw) >= SHORT
        wins.append((first, bound) if known else None)
        least.append(int(bound.min()) if known else 1 << 30)
        ids.append(item_id)
        times.append(n)
        texts.append(raw)
    automaton = None
    if short:
        automaton = ahocorasick.Automaton()
        for text, owners in short.items():
            automaton.add_word(text, (len(text), owners))
        automaton.make_automaton()
    if not codes:
        return Index(ids, times, texts, np.zeros(1 << _TABLE_BITS, bool), *(np.zeros(0, np.int64),) * 4, 1, np.array(least, np.int64), wins, automaton)
    code, item, pos = np.concatenate(codes), np.concatenate(item), np.concatenate(pos)
    order = np.argsort(code, kind="stable")
    distinct, first = np.unique(code[order], return_index=True)
    bits = np.zeros(1 << _TABLE_BITS, bool)
    bits[_slot(distinct)] = True
    return Index(ids, times, texts, bits, distinct, np.append(first, len(code)), item[order], pos[order],
                 1 + max(budget(min(WINDOW, len(t)), edits) for t in texts), np.array(least), wins, automaton)


def align(pattern: np.ndarray, text: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Least edits of each pattern (a column of ``size`` characters) against any
    part of its text, within a band of ``width`` diagonals from the text's start;
    all pairs row by row."""
    row = np.zeros((width + 1, len(size)), np.int16)  # a match may begin on any diagonal
    done = np.where(size == 0, 0, 1 << 14).astype(np.int16)
    for j in range(len(pattern)):
        turn = row + (text[j: j + width + 1] != pattern[j])  # diagonal stays: match or replace
        np.minimum(turn[:-1], row[1:] + 1, out=turn[:-1])  # pattern's character left out
        for d in range(width):
            np.minimum(turn[d + 1], turn[d] + 1, out=turn[d + 1])  # text's character left out
        row = turn.astype(np.int16, copy=False)
        last = size == j + 1
        if last.any():
            done[last] = row[:, last].min(0)
    return done


def _trim(raw: np.ndarray) -> tuple[int, int]:
    own = np.flatnonzero(raw != 32)
    return (int(own[0]), int(own[-1]) + 1) if len(own) else (0, 0)


def _looked_up(index: Index, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text's q-grams that are indexed, and their numbers; a block of the text at a time."""
    out = []
    for a in range(0, len(text), HITS):
        code = grams(text[a: a + HITS + Q - 1])
        where = np.flatnonzero(index.filter[_slot(code)])
        found = np.searchsorted(index.codes, code[where])
        found[found == len(index.codes)] = 0
        ok = index.codes[found] == code[where]
        out.append((where[ok] + a, found[ok]))
    return np.concatenate([w for w, _ in out]), np.concatenate([f for _, f in out])


def short_items(index: Index, raw: np.ndarray, at: np.ndarray, text: np.ndarray, edge: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """As leaks(), for the items under ``SHORT`` bytes: exact, ended by no word byte on either side; under ``Q`` bytes, alone on a line."""
    out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    if index.short is None:
        return out
    line = np.zeros(len(text) + 1, bool)  # a line break or a row's edge stands here
    brk = np.flatnonzero(raw == 10)
    line[brk + np.searchsorted(at, brk, "right") - 1] = True
    line[edge[1:] - 1] = True
    blank = (text == 32) | (text == 0)
    for end, (n, owners) in index.short.iter(text.tobytes().decode("latin-1")):
        a, b = end - n + 1, end + 1
        if n < Q:
            x, y = a - 1, b
            while x >= 0 and not line[x] and blank[x]:
                x -= 1
            while y < len(text) and not line[y] and blank[y]:
                y += 1
            whole = (x < 0 or line[x]) and (y >= len(text) or line[y])
        else:
            whole = not (a and _IN_WORD[text[a - 1]] and _IN_WORD[text[a]]) and not (b < len(text) and _IN_WORD[text[b]] and _IN_WORD[text[b - 1]])
        if whole:
            r = int(np.searchsorted(edge, a, "right")) - 1
            for i in owners:
                low, high, _, many = out.get((r, i), (a - int(edge[r]), 0, 0, 0))
                out[r, i] = (low, b - int(edge[r]), 0, many + 1)
    return out


def leaks(index: Index, raw: np.ndarray, at: np.ndarray, edits: float) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(row, item) -> (start, end, least edits, windows found), bytes in the row."""
    if not index.items or not len(raw):
        return {}
    text = _FOLD[np.insert(raw, at[1:], 0)]
    edge = at + np.arange(len(at))
    out = short_items(index, raw, at, text, edge)
    if not len(index.codes):
        return out
    where, found = _looked_up(index, text)
    row = np.searchsorted(edge, where, "right") - 1
    many = index.first[found + 1] - index.first[found]
    bands, items = index.band, len(index.items)
    shift = int(max(map(len, index.text))) // bands + 2
    per_row = (int(np.diff(edge).max(initial=0)) // bands + 2 * shift + 4) * items

    def keys(a: int, b: int):
        """Of the hits a to b: each posting's two bands, as numbers, and its place in the item."""
        rep = many[a:b]
        post = np.repeat(index.first[found[a:b]], rep) + np.arange(int(rep.sum())) - np.repeat(np.cumsum(rep) - rep, rep)
        r = np.repeat(row[a:b], rep)
        diagonal = np.repeat(where[a:b], rep) - edge[r] - index.pos[post]
        band = (diagonal // bands + shift) * items + index.item[post] + r * per_row
        return band, index.pos[post]

    upto = np.cumsum(many)

    def cuts(a: int, b: int):
        """The hits a to b in runs of about HITS postings."""
        while a < b:
            end = min(b, max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right"))))
            yield a, end
            a = end

    parts = [np.unique(keys(a, b)[0], return_counts=True) for a, b in cuts(0, len(where))]
    if not parts:
        return out
    key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    count = np.bincount(inverse.ravel(), np.concatenate([c for _, c in parts])).astype(np.int64)
    # a band of 2 (k + 1) is two neighbours of k + 1
    upper = np.searchsorted(key, key + items)
    upper[upper == len(key)] = 0
    after = np.where(key[upper] == key + items, count[upper], 0)
    lower = np.searchsorted(key, key - items)
    lower[lower == len(key)] = 0
    alone = key[lower] != key - items  # the band that begins a step lower holds this one only
    item = key % items
    kept = key[(count + after >= index.least[item])]
    kept = np.union1d(kept, key[alone & (count >= index.least[item])])
    if not len(kept):
        return out
    longest = max(map(len, index.text))

    def inside(bands_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band and item place of every posting in these bands and their upper neighbours; hits far from their diagonals aren't looked at."""
        ends = [(int(k) // per_row, ((int(k) % per_row) // items - shift + more) * bands) for k, more in ((bands_[0], 0), (bands_[-1], 2))]
        low, high = (int(edge[r]) + d for r, d in ends)
        wanted = np.union1d(bands_, bands_ + items)
        found = [(np.zeros(0, np.int64),) * 2]
        for a, b in cuts(int(np.searchsorted(where, low)), int(np.searchsorted(where, high + longest, "right"))):
            k, p = keys(a, b)
            own = np.isin(k, wanted)
            found.append((k[own], p[own]))
        band_of, pos_of = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((pos_of, band_of))
        return band_of[order], pos_of[order]

    items_at = np.cumsum([0] + [len(t) for t in index.text])
    flat = np.concatenate(index.text)

    def aligned(tasks):
        """Of the windows held, those with few enough edits, and these."""
        row_of, item_of, first, size, start, end, most = (np.concatenate(x) for x in zip(*tasks, strict=True))
        cost = np.zeros(len(first), np.int64)
        for a in range(0, len(first), PAIRS):
            some = slice(a, a + PAIRS)
            n, width = int(size[some].max()), 2 * bands + 2 * int(most[some].max()) + 1
            reach = np.arange(n)[:, None]
            pattern = np.where(reach < size[some], flat[np.minimum((items_at[item_of[some]] + first[some]) + reach, len(flat) - 1)], 0).astype(np.int16)
            reach = start[some] + np.arange(n + width + 1)[:, None]
            region = np.where(reach < end[some], text[np.minimum(reach, len(text) - 1)], -1).astype(np.int16)
            cost[some] = align(pattern, region, size[some], width)
        good = cost <= most
        return tuple(x[good] for x in (row_of, item_of, first, start, end, cost))

    tasks, held, verified = [], 0, []
    for n, k in enumerate(kept.tolist()):
        if n % BANDS == 0:
            band_of, pos_of = inside(kept[n: n + BANDS])
        r, i = k // per_row, k % items
        low = ((k % per_row) // items - shift) * bands  # the band's lowest diagonal
        pos = np.unique(np.concatenate([pos_of[np.searchsorted(band_of, x): np.searchsorted(band_of, x, "right")] for x in (k, k + items)]))
        size = min(WINDOW, len(index.text[i]))  # of every window
        most = budget(size, edits)
        first, bound = index.windows[i]
        first = first[np.searchsorted(pos, first + size - Q, "right") - np.searchsorted(pos, first) >= bound]
        begin = edge[r] + low + first - most
        start, end = np.maximum(begin, edge[r]), np.minimum(begin + size + 2 * bands + 2 * most, edge[r + 1] - 1)
        first, start, end = (x[end > start] for x in (first, start, end))
        if not len(first):
            continue
        same = lambda x: np.full(len(first), x, np.int64)  # noqa: E731, B023
        tasks.append((same(r), same(i), first, same(size), start, end, same(most)))
        held += len(first)
        if held > HELD:
            verified.append(aligned(tasks))
            tasks, held = [], 0
    if tasks:
        verified.append(aligned(tasks))
    if not verified:
        return out
    row_of, item_of, first, start, end, cost = (np.concatenate(x) for x in zip(*verified, strict=True))
    good = np.arange(len(first))
    if not len(good):
        return out
    good = good[np.lexsort((first[good], item_of[good], row_of[good]))]
    new = np.append(True, (np.diff(row_of[good]) != 0) | (np.diff(item_of[good]) != 0))
    other = new | np.append(True, np.diff(first[good]) != 0)
    at_ = np.flatnonzero(new)
    low, high = np.minimum.reduceat(start[good], at_), np.maximum.reduceat(end[good], at_)
    least, many = np.minimum.reduceat(cost[good], at_), np.add.reduceat(other.astype(np.int64), at_)
    for j, g in enumerate(good[at_].tolist()):
        r = int(row_of[g])
        out[r, int(item_of[g])] = (int(low[j] - edge[r]), int(high[j] - edge[r]), int(least[j]), int(many[j]))
    return out


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The distinct items, with the number of their rows, in parts of about BLOCK_BYTES, each small enough to be sent to every task."""
    rows = benchmark.groupBy("item_id", "text").agg(F.count("*").alias("n"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    return [rows.filter(part == i) for i in range(n)]


def find(documents: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> one row per document
    row and item of which it holds a window: (doc_id, item_id, start, end,
    edits, windows). start and end (code points) enclose the regions searched,
    edits is the least of a window.

    Null or empty texts hold nothing. Items of fewer than 2 q bytes are found
    only as they are, whole words (under q bytes: a line of their own); windows,
    and short items, that say too little (see above) are not looked for. Repeated rows of either table give repeated rows. Other columns
    are ignored.
    """
    schema = "doc_id long, item_id long, start long, end long, edits long, windows long"
    out = documents.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark):
        index = build([tuple(r) for r in block.collect()], edits)

        def run(batches, index=index):
            for batch in batches:
                for part, raw, at in chunks(batch):
                    found = [x for x in sorted(leaks(index, raw, at, edits).items()) for _ in range(index.times[x[0][1]])]
                    point = lambda r, p: int(np.count_nonzero((raw[at[r]: at[r] + p] & 0xC0) != 0x80))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(part.schema.get_field_index("doc_id")).take(pa.array([r for (r, _), _ in found], pa.int64())),
                         pa.array([index.items[i] for (_, i), _ in found], pa.int64()), pa.array([point(r, v[0]) for (r, _), v in found], pa.int64()),
                         pa.array([point(r, v[1]) for (r, _), v in found], pa.int64()), pa.array([v[2] for _, v in found], pa.int64()), pa.array([v[3] for _, v in found], pa.int64())],
                        ["doc_id", "item_id", "start", "end", "edits", "windows"])

        out = out.unionByName(documents.select("doc_id", "text").mapInArrow(run, schema))
    return out


def clean(documents: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The documents that hold no window of an item, with all their columns."""
    for block in _blocks(benchmark):
        index = build([tuple(r) for r in block.collect()], edits)

        def run(batches, index=index):
            for batch in batches:
                for part, raw, at in chunks(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r for r, _ in leaks(index, raw, at, edits)]] = False
                    yield part.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


@register("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))
