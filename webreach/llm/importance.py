"""Importance resampling towards a target distribution over hashed word n-grams.

The distinct words of a chunk of text, bounded by delimiters, are the dictionary
of an Aho-Corasick automaton; each carries its CRC-32 and its length. One scan
of the chunk emits the payloads in text order, and the payloads of neighbouring
words compose to the CRC of the two joined by a space, without hashing them
again. Buckets are counted over all documents and all target texts; a document's
score is the mean gain of its buckets with Gumbel noise drawn from its id.
"""

from __future__ import annotations

import itertools
import math
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.llm.common import chunks, column, runs, table, written
from webreach.llm.registry import register

BUCKETS, SEED, SHARE, LEAST_WORDS = 10_000, 7, 25, 20
SCAN_BYTES = 1 << 22
#: Longer words get their payload by hand: an automaton takes a state for each byte of a word.
LONG_WORD = 1024
#: Bytes to word bytes in lower case, delimiters to blanks; bytes from 128 on belong to words.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58], _FOLD[97:123], _FOLD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_FOLD[65:91] = np.arange(97, 123)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


_CRC = _crc_table()


def _spread(basis: np.ndarray) -> np.ndarray:
    """The 4 x 256 lookup form of a linear map of 32 bits, given as its 32 columns."""
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        at, own = divmod(bit, 8)
        out[at] ^= np.where(np.arange(256) >> own & 1, basis[bit], np.uint32(0)).astype(np.uint32)
    return out


def _through(form: np.ndarray, crc: np.ndarray) -> np.ndarray:
    byte = crc.view(np.uint8).reshape(*crc.shape, 4)  # little-endian
    return form[0][byte[..., 0]] ^ form[1][byte[..., 1]] ^ form[2][byte[..., 2]] ^ form[3][byte[..., 3]]


def _zeros_forms() -> list[np.ndarray]:
    """What 1, 2, 4, ... zero bytes behind a string do to its CRC register."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    forms = [_spread(_CRC[unit & np.uint32(255)] ^ (unit >> np.uint32(8)))]
    while len(forms) < 31:
        forms.append(_spread(_through(forms[-1], _through(forms[-1], unit))))
    return forms


_ZEROS = _zeros_forms()


def shift_form(length: int) -> np.ndarray:
    """What ``length`` zero bytes behind a string do to its CRC register."""
    out = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            out = _through(_ZEROS[bit], out)
    return _spread(out)


def joined(crc1: np.ndarray, crc2: np.ndarray, length2: np.ndarray) -> np.ndarray:
    """CRC-32 of each first string, a blank and its second string, from their CRCs and the second's length."""
    sizes, at = np.unique(length2, return_inverse=True)
    forms = np.array([shift_form(int(n)) for n in sizes], np.uint32).reshape(-1, 4, 256)
    # CRC(a + b) is CRC(a) shifted by b's length, xor CRC(b); here a ends with the blank
    blank = np.uint32(0xFFFFFFFF)
    first = crc1 ^ blank
    first = (_CRC[(first ^ np.uint32(32)) & np.uint32(255)] ^ (first >> np.uint32(8))) ^ blank
    byte = np.ascontiguousarray(first).view(np.uint8).reshape(-1, 4)
    return forms[at, 0, byte[:, 0]] ^ forms[at, 1, byte[:, 1]] ^ forms[at, 2, byte[:, 2]] ^ forms[at, 3, byte[:, 3]] ^ crc2


def automaton(words) -> ahocorasick.Automaton:
    """Words bounded by blanks on both sides; a payload is the length above the CRC."""
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(f" {w.decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
    found.make_automaton()
    return found


def payloads(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and payload of every word of the rows' texts, in text order."""
    buf = np.insert(np.append(_FOLD[raw], np.uint8(32)), at[:-1], 32)  # a blank before every row, and one at the end
    edge = at + np.arange(len(at))
    start, end = runs(buf != 32)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = buf.tobytes()
    extra = [(int(b), len(w := text[a:b]) << 32 | zlib.crc32(w)) for a, b in zip(start, end, strict=True) if b - a > LONG_WORD] if (end - start).max() > LONG_WORD else []
    words = {w for w in text.split() if len(w) <= LONG_WORD}
    emitted = automaton(words).iter(text.decode("latin-1")) if words else ()
    hits = np.fromiter(itertools.chain.from_iterable(emitted), np.int64).reshape(-1, 2)
    if extra:
        hits = np.concatenate((hits, np.array(extra, np.int64)))
        hits = hits[np.argsort(hits[:, 0], kind="stable")]
    return np.searchsorted(edge, hits[:, 0], "left") - 1, hits[:, 1]


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, and the row and bucket of every feature."""
    row, load = payloads(raw, at)
    crc, length = (load & 0xFFFFFFFF).astype(np.uint32), load >> 32
    pair = np.flatnonzero(row[1:] == row[:-1])
    both = joined(crc[pair], crc[pair + 1], length[pair + 1]) if len(pair) else np.zeros(0, np.uint32)
    return np.bincount(row, minlength=len(at) - 1), np.concatenate((row, row[pair])), np.concatenate((crc, both)).astype(np.int64) % BUCKETS


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts by bucket; each task adds up its own before they are dealt."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, raw, at in chunks(batch, limit=SCAN_BYTES):
                total += np.bincount(features(raw, at)[2], minlength=BUCKETS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    big_s, big_t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * big_s / ((s + 1) * big_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): one row per row."""
    def run(batches):
        for batch in batches:
            for part, raw, at in chunks(batch, limit=SCAN_BYTES):
                n_words, row, bucket = features(raw, at)
                n = np.bincount(row, minlength=part.num_rows)
                total = np.zeros(part.num_rows, np.int64)
                np.add.at(total, row, gain[bucket])
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(n_words), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))],
                    ["doc_id", "n_words", "n_features", "weight"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ranks by a range sort, whose
    partitions hold no more than the sort's sample gives them, and the number of
    rows in the partitions before."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    fit = F.col("n_words") >= least_words
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    spark = weighed.sparkSession
    scored = written(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), fit.alias("fit")), "importance-scored")
    taken = scored.filter("fit").count() * share // 100
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = written(scored.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "importance-order")
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part long, start long")  # a row a partition
    rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= taken), rank).alias("rank"))


def resample(documents: DataFrame, target: DataFrame) -> DataFrame:
    """documents(doc_id, text), target(text) -> (doc_id, n_features, weight, score, rank), one row per row.

    A null or empty text, or one without a word, has no feature and the weight
    0. A null id draws its noise as the empty text and comes last among equal
    scores; repeated rows are ranked one by one, those alike in any order. Empty
    tables give no rows (documents) or counts of 0 (target). Other columns are
    ignored. Collected: the counts of ``BUCKETS`` buckets and a number per sort partition.
    """
    return draw(weigh(documents, gains(bucket_counts(documents), bucket_counts(target))))


# DuckDB has no CRC-32: each byte enters with 8 shifts of the register.
_BUCKET = """list_reduce(list_concat([4294967295], flatten(list_transform(range(1, octet_length({w}) + 1),
  lambda i: [('0x' || substr(hex({w}), 2 * i - 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)))"""
ORACLE = rf"""
WITH words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM (SELECT 's' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents
        UNION ALL SELECT 't', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark)),
feats AS (
  SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
coded AS (
  SELECT f, xor({_BUCKET.format(w="e")}, 4294967295) % {BUCKETS} AS b FROM (SELECT f, encode(f) AS e FROM (SELECT DISTINCT f FROM feats))),
n AS (SELECT b, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t FROM feats JOIN coded USING (f) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS g FROM n),
weight AS (
  SELECT id, count(*) AS n_features, floor(sum(g) / count(*))::BIGINT AS weight
  FROM feats JOIN coded USING (f) JOIN gain USING (b) WHERE kind = 's' GROUP BY id),
scored AS (
  SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words w LEFT JOIN weight x ON w.id = x.id WHERE w.kind = 's'),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {SHARE} * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


@register("op12_importance_resampling", ORACLE)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of ``documents`` drawn towards the distribution of ``benchmark``; every row with its weight, score and rank."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
