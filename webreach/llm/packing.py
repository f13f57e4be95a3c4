"""Cost-balanced packing of tokenized documents into sequences.

A piece of n tokens costs ``linear * n + quadratic * n**2`` (attention stays
inside a piece). Pieces are taken by descending length; each goes to the
sequence of lowest cost that still has room for it. When none has, it is cut
at the largest room there is.
"""

from __future__ import annotations

import heapq
import itertools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.llm.common import chunks, per_process, prefix_hashes, span_hashes, table
from webreach.llm.registry import register

END_ID = 1
#: Of one packing group, on average.
GROUP_ROWS, GROUP_BYTES = 2000, 8 << 20
#: Words whose ids a worker remembers, words that are encoded at a time, and bits of the table that is asked first.
MEMORY_WORDS, LEARN_WORDS, TABLE_BITS = 400_000, 20_000, 20
_PLAIN, _LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


class Words:
    """Token ids of texts, word by word.

    The tokenizer's pattern always cuts before a single space or newline between
    two characters that aren't white space, after such a newline, and between a
    letter and a mark other than an apostrophe. So the parts between these
    places can be encoded on their own, and equal parts once. The tokenizer's
    special tokens are parts of their own if ``special``, else plain text.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        marks = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if special), key=len, reverse=True)
        self.special, self.find_special = set(marks), re.compile(b"|".join(map(re.escape, marks))).search if marks else None
        # a word of letters is one part for the byte-pair merges, which see each byte as a character
        self.bpe = self.tokenizer.model.tokenize
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain) if b != 10}
        self.forget()

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.keys, self.words = np.zeros(1 << TABLE_BITS, np.uint64), np.full(1 << TABLE_BITS, -1, np.int32)

    def learn(self, keys: list[int], texts: list[bytes]) -> None:
        found: list = [None] * len(texts)
        plain = [i for i, text in enumerate(texts) if _LETTERS(text) and text not in self.special]
        shown = b"\n".join([texts[i] for i in plain]).decode("latin-1").translate(self.shown).split("\n")
        for i, word in zip(plain, shown, strict=False):  # without words there is still one empty string
            found[i] = [t.id for t in self.bpe(word)]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i].decode() for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32)
        n, used = len(self.number), int(self.ends[len(self.number) - 1]) if self.number else 0
        while len(self.ends) < n + len(found):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        while len(self.ids) < used + len(flat):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[used: used + len(flat)] = flat
        self.ends[n: n + len(found)] = used + np.cumsum([len(ids) for ids in found])
        self.number.update(zip(keys, range(n, n + len(found)), strict=True))

    def look_up(self, key: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of every word."""
        slot = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        word = self.words[slot].astype(np.int64)
        miss = np.flatnonzero((self.keys[slot] != key) | (word < 0))
        if not len(miss):
            return word
        some, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
        first, values = miss[first], some.tolist()
        new = [i for i, k in enumerate(values) if k not in self.number]
        if len(self.number) + len(new) > MEMORY_WORDS and self.number:
            self.forget()
            return self.look_up(key, raw, start, end)
        data = raw.tobytes() if new else b""
        for a in range(0, len(new), LEARN_WORDS):
            part = new[a: a + LEARN_WORDS]
            self.learn([values[i] for i in part], [data[start[i]: end[i]] for i in first[part].tolist()])
        number = np.fromiter(map(self.number.__getitem__, values), np.int64, len(values))
        word[miss] = number[back.ravel()]
        at = (some >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        self.keys[at], self.words[at] = some, number
        return word

    def specials(self, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """Places of special tokens, leftmost first, the longest of those that start together."""
        if not self.find_special:
            return []
        data, found, place = raw.tobytes(), [], 0
        while m := self.find_special(data, place):
            inside = np.searchsorted(at, m.start(), "right") == np.searchsorted(at, m.end() - 1, "right")
            place = m.end() if inside else m.start() + 1
            if inside:
                found.append(m.span())
        return found

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row offsets); each row's ids end with END_ID."""
        n = len(at) - 1
        inner = np.arange(1, max(1, len(raw) - 1))
        blank = inner[(raw[1:-1] == 32) | (raw[1:-1] == 10)] if len(raw) > 2 else inner[:0]
        before, after = raw[blank - 1], raw[blank + 1]
        latin = raw[np.maximum(blank - 2, 0)] == 0xC3  # of a two-byte character, U+00C0 to U+00FF
        blank = blank[(_PLAIN[before] | (before >= 0x80) & latin) & (_PLAIN[after] | (after == 0xC3))]
        line = blank[raw[blank] == 10]
        mark = np.flatnonzero(_MARK[raw[1:]] & _LETTER[raw[:-1]]) + 1
        cut = np.zeros(len(raw) + 1, bool)
        for places in (blank, line + 1, mark, at[:-1][np.diff(at) > 0]):
            cut[places] = True
        for a, b in self.specials(raw, at):
            cut[a + 1: b] = False
            cut[[a, b]] = True
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(raw))[: len(start)]
        word = self.look_up(span_hashes(prefix_hashes(raw), start, end), raw, start, end)
        lo = np.where(word > 0, self.ends[np.maximum(word - 1, 0)], 0)
        size = self.ends[word] - lo
        row = np.repeat(np.arange(n), np.diff(np.searchsorted(start, at)))
        tokens = np.bincount(row, size, n).astype(np.int64) + 1
        offsets = np.concatenate(([0], np.cumsum(tokens)))
        ids = np.full(offsets[-1], END_ID, np.uint32)
        first = np.cumsum(size) - size
        # of every id: its place in the memory, and in the rows, where END_ID of each earlier row stands before
        place = np.arange(int(size.sum()))
        ids[place + np.repeat(row, size)] = self.ids[place + np.repeat(lo - first, size)]
        return ids, offsets


def _tokenize(path: str, capacity: int, special: bool):
    def run(batches):
        kept = per_process()
        name = f"{path} {special}"
        words = kept.get(name) or kept.setdefault(name, Words(path, special))
        for batch in batches:
            for part, raw, at in chunks(batch):
                ids, offsets = words.encode(raw, at)
                short = ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids
                tokens = np.diff(offsets)
                per = -(-tokens // capacity)
                row = np.repeat(np.arange(part.num_rows), per)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * capacity
                length = np.minimum(tokens[row] - start, capacity)
                cut = (np.append(offsets[row] + start, offsets[-1]) * short.itemsize).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cut), pa.py_buffer(short)])
                take = lambda name: part.column(part.schema.get_field_index(name)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([take("doc_id"), take("row_no"), pa.array(start), pa.array(length), pa.array(tokens[row]), binary],
                                                 ["doc_id", "row_no", "start", "length", "doc_tokens", "ids"])
    return run


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset): as few sequences as the tokens need."""
    n = max(1, -(-int(lengths.sum()) // capacity))
    room, cost, out = np.full(n, capacity), np.zeros(n), []
    todo = [(-int(x), i, 0) for i, x in enumerate(lengths)]
    heapq.heapify(todo)
    while todo:
        size, piece, start = heapq.heappop(todo)
        size = -size
        fits = np.flatnonzero(room >= size)
        to = int(fits[cost[fits].argmin()]) if len(fits) else int(room.argmax())
        put = min(size, int(room[to]))
        out.append((piece, start, put, to, capacity - int(room[to])))
        room[to] -= put
        cost[to] += linear * put + quadratic * put * put
        if put < size:
            heapq.heappush(todo, (put - size, piece, start + put))
    return out


def _pack(capacity: int, linear: float, quadratic: float):
    def run(key, rows):
        rows = rows.combine_chunks().sort_by([("row_no", "ascending"), ("start", "ascending")])
        length, data = rows["length"].to_numpy(), rows["ids"].combine_chunks()
        data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
        plan = assign(length, capacity, linear, quadratic)
        piece, cut, put, sequence, offset = (np.array(x, np.int64) for x in zip(*plan, strict=True))
        ids = []
        for p, c, k in zip(piece.tolist(), cut.tolist(), put.tolist(), strict=True):
            raw = data[p].as_buffer()
            kind = np.uint16 if raw.size == 2 * length[p] else np.uint32
            ids.append(np.frombuffer(raw, kind)[c: c + k].astype("<u4").tobytes())
        take = lambda name: rows[name].combine_chunks().take(pa.array(piece))
        start = rows["start"].to_numpy()[piece] + cut
        return pa.table([take("doc_id"), pa.array(start), pa.array(put), take("doc_tokens"), pa.array((key[0].as_py() << 32) + sequence), pa.array(offset), pa.array(ids, pa.binary())],
                        ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    return run


def pack(documents: DataFrame, tokenizer: str, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048, special: bool = False) -> DataFrame:
    """documents(doc_id, text) -> pieces (doc_id, start, length, doc_tokens,
    sequence_id, offset, ids): ``ids`` as unsigned little-endian 32-bit numbers.

    Each row gives its ids and END_ID, a null or empty text END_ID alone. A
    longer row is cut at multiples of ``capacity``; further cuts happen only
    where no sequence of the group has room for a whole piece. Pieces are dealt
    to groups of bounded size by a hash of their row, so that copies, repeated
    rows and null ids spread; less than one sequence a group is padding.
    ``documents`` must come from files, as its rows are told apart by their
    order. Other columns are ignored; an empty table gives no piece. With
    ``special``, a special token's text gives its own id, as the tokenizer does
    by default; else it is text like any other.
    """
    size = documents.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    groups = max(1, -(-max(size.n, 1) // GROUP_ROWS), -(-(size.b or 0) // GROUP_BYTES))
    pieces = (documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row_no"))
              .mapInArrow(_tokenize(tokenizer, capacity, special), "doc_id long, row_no long, start long, length long, doc_tokens long, ids binary"))
    keyed = pieces.withColumn("group", F.pmod(F.xxhash64("row_no", "start"), F.lit(groups)))
    return keyed.groupBy("group").applyInArrow(
        _pack(capacity, linear, quadratic),
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op4_cost_packing")
def op4_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), tokenizer_path(), special=True))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest(pack(docs, tokenizer_path(), special=True))
