"""Quality rules by line sequence labelling.

A linear-chain CRF over line features, fitted from the labels of a bounded
sample of documents, marks each line as content or boilerplate; the share of
words on content lines decides whether a document stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.llm import crf as C
from webreach.llm.common import chunks, prefix_hashes, runs, scramble, span_hashes, table
from webreach.llm.registry import register

#: Labelled documents that the CRF is fitted on, and lines of each that count there.
SAMPLE_DOCS, SAMPLE_LINES = 3000, 48
CONTENT, BOILERPLATE = 1, 0
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_lut = lambda members: np.isin(np.arange(256), list(members))
_SYMBOL, _UPPER, _DIGIT = _lut(b"#*$%&|<>"), _lut(range(65, 91)), _lut(range(48, 58))
_PUNCT = _lut(b"!?=+/\\_~^@{}[]()\"';:")
_ENDS = _lut(b".!?\"')")
_WORDS, _RATIOS = np.array([1, 2, 4, 7, 12, 20, 40, 80]), np.array([0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
_SIZES = (9, 8, 8, 8, 8, 8, 4, 4, 9)
_SHIFT = np.concatenate(([0], np.cumsum(_SIZES)))
N_FEATURES = int(_SHIFT[-1])


def _again(key: np.ndarray, first_too: bool) -> np.ndarray:
    """True where a key stands at an earlier place too (or, first_too, anywhere else)."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order] = same[:-1] | (same[1:] if first_too else False)
    return out


def measure(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per row, and per line with a word: row, words, feature numbers."""
    n = len(at) - 1
    buf = np.insert(raw, at[1:], 0)
    edge = at + np.arange(n + 1)
    prefix = prefix_hashes(buf)
    in_word = ~_SPACE[buf]
    in_word[edge[1:] - 1] = False  # a row ends with a byte of its own, which is no part of its text
    start, end = runs(in_word)
    row = np.searchsorted(edge, start, "right") - 1
    first = np.searchsorted(start, edge)
    salt = scramble(np.arange(n, dtype=np.uint64))
    chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    out = {"n_words": np.diff(first), "word_chars": np.bincount(row, chars[end] - chars[start], n).astype(np.int64)}
    total = lambda mask: (c := np.concatenate(([0], np.cumsum(mask[buf]))))[edge[1:]] - c[edge[:-1]]
    out["n_symbols"] = total(_SYMBOL)
    # 5-word windows found twice or more in the row
    repeated = np.zeros(len(start) + 1, np.int64)
    if len(start) >= 5:
        word = span_hashes(prefix, start, end)
        window = salt[row[4:]]
        for i in range(5):
            window = scramble(window ^ word[i: len(word) - 4 + i]) + np.uint64(i)
        inside = np.flatnonzero(row[4:] == row[:-4])
        hit = inside[_again(window[inside], True)]
        np.add.at(repeated, hit, 1)
        np.add.at(repeated, hit + 5, -1)
    repeated = np.cumsum(repeated[:-1]) > 0
    out["n_repeat_words"] = np.bincount(row, repeated, n).astype(np.int64)
    # lines with a word
    stop = buf == 10
    stop[edge[1:] - 1] = True
    stops = np.flatnonzero(stop)
    line_of = np.searchsorted(stops, start)
    own = np.flatnonzero(np.diff(line_of, prepend=-1) != 0)  # first word of each line that has one
    line, words = line_of[own], np.diff(np.append(own, len(start)))
    b, e = np.where(line > 0, stops[line - 1] + 1, 0), stops[line]
    line_row = row[own]
    again = _again(scramble(span_hashes(prefix, b, e) ^ salt[line_row]), False)
    out["n_dup_lines"] = np.bincount(line_row, again, n).astype(np.int64)
    size = np.maximum(chars[end[own + words - 1]] - chars[start[own]], 1)
    share = lambda mask: np.searchsorted(_RATIOS, ((c := np.concatenate(([0], np.cumsum(mask[buf]))))[e] - c[b]) / size, "left")
    rep = np.add.reduceat(repeated, own, dtype=np.int64) / words if len(own) else np.zeros(0)
    tail, head = buf[end[own + words - 1] - 1], buf[start[own]]
    features = np.stack([
        np.searchsorted(_WORDS, words, "left"), share(_SYMBOL), share(_UPPER), share(_DIGIT), share(_PUNCT), np.searchsorted(_RATIOS, rep, "left"),
        again * 2 + (rep > 0.5), _ENDS[tail] * 2 + _UPPER[head], np.searchsorted(np.arange(2, 18, 2), size / words, "left")], 1) + _SHIFT[:-1]
    return out | {"line_row": line_row, "line_words": words, "features": features.astype(np.int16)}


def judge(raw: np.ndarray, at: np.ndarray, field: C.Crf, least: float) -> dict[str, np.ndarray]:
    """measure() with the verdicts of the base rules and of the CRF."""
    m = measure(raw, at)
    n = len(at) - 1
    label = C.viterbi(field, C.scores(field, m["features"]), np.bincount(m["line_row"], minlength=n))
    content = np.bincount(m["line_row"], m["line_words"] * (label == CONTENT), n)
    m["content_share"] = content / np.maximum(m["n_words"], 1)
    m["base_failed"] = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    m["kept"] = ~m["base_failed"] & (m["content_share"] >= least)
    return m


def _lines(batches):
    for batch in batches:
        for part, raw, at in chunks(batch):
            m = measure(raw, at)
            per = np.bincount(m["line_row"], minlength=part.num_rows)
            first = np.cumsum(per) - per
            values = [m["features"][a: a + min(c, SAMPLE_LINES)].tobytes() for a, c in zip(first, per, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.binary())], ["quality", "features"])


def fit(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, rounds: int = 60) -> C.Crf:
    """The CRF of at most ``sample_docs`` labelled documents, those with the
    smallest hash of their id; every line of a document has its label. Without
    labels of both kinds every line counts as content."""
    label = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)  # so many rows at most, hence the broadcast
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # a repeated id may not widen the sample
    rows = texts.select("quality", "text").mapInArrow(_lines, "quality int, features binary").orderBy(F.xxhash64("features"), "features").limit(2 * sample_docs).collect()
    rows = [(int(r.quality > 0), np.frombuffer(r.features, np.int16).reshape(-1, len(_SIZES))) for r in rows if len(r.features)]
    share = sum(y for y, _ in rows) / max(1, len(rows))
    if share in (0, 1):
        neutral = C.zero(N_FEATURES, 2)
        neutral.first[CONTENT] = neutral.step[:, CONTENT][:] = 1
        return neutral
    lengths = np.array([len(f) for _, f in rows])
    weights = np.array([(0.5 / share if y else 0.5 / (1 - share)) for y, _ in rows]) / lengths  # documents count alike
    labels_ = np.repeat([y for y, _ in rows], lengths)
    return C.fit(np.concatenate([f for _, f in rows]).astype(np.int64), labels_, lengths, N_FEATURES, 2, weights, rounds)


def score(documents: DataFrame, field: C.Crf, least: float = 0.5) -> DataFrame:
    """documents(doc_id, text) -> one row per row, see ``op3`` for the columns.

    A null or empty text, or one of white space, has no word and fails the
    base rules. Repeated rows give repeated rows; other columns are ignored.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for batch in batches:
            for part, raw, at in chunks(batch):
                m = judge(raw, at, field, least)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), *(pa.array(m[c], pa.int64()) for c in counts),
                     pa.array(m["base_failed"]), pa.array(m["kept"]), pa.array(m["content_share"])],
                    ["doc_id", *counts, "base_failed", "kept", "content_share"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, content_share double")


def keep(documents: DataFrame, field: C.Crf, least: float = 0.5) -> DataFrame:
    """The documents that score() keeps, with all their columns."""
    def run(batches):
        for batch in batches:
            for part, raw, at in chunks(batch):
                yield part.filter(pc.fill_null(pa.array(judge(raw, at, field, least)["kept"]), False))

    return documents.mapInArrow(run, documents.schema)


@register("op3_quality_lines")
def op3_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs, fit(docs, table(spark, sf_dir, "labels")))
