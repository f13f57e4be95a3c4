"""Helpers shared by the training-data operators: tables, shared scratch
tables, and zero-copy views of Arrow text columns."""

from __future__ import annotations

import functools
import secrets
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task's numpy code looks at together; a longer text is looked at alone.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch, unless the session has been given another number: texts are wide.
BATCH_ROWS = 1000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def narrow_batches(fn):
    """A query or stage whose session hands texts to Python in batches of BATCH_ROWS."""
    @functools.wraps(fn)
    def run(spark, *args):
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if key not in spark.conf.getAll:
            spark.conf.set(key, str(BATCH_ROWS))
        return fn(spark, *args)
    return run


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    from webreach.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a parquet table in the shared folder: cuts the lineage and
    survives lost executors; joins on it see a bare exchange, which AQE splits
    when a key is hot. The shuffle files of the write go as soon as it ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def per_process() -> dict:
    """What a Python worker keeps from one task to the next."""
    return sys.modules.setdefault("_webreach_kept", types.ModuleType("_webreach_kept")).__dict__


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null has no bytes."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``limit`` bytes of text (one row at least),
    each with its text's bytes and row offsets."""
    raw, at = utf8(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row), raw[at[row]: at[end]], at[row: end + 1] - at[row]
        row = end


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Strings are polynomials over their bytes modulo a prime, at a base that no text
#: can know: drawn once by the driver, it goes to the workers with the functions.
_PRIME = (1 << 61) - 1
_BASE = 2 + secrets.randbelow(_PRIME - 3)
_P, _LOW, _HALF, _TOP = np.uint64(_PRIME), np.uint64((1 << 31) - 1), np.uint64(31), np.uint64(61)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x < 2 ** 64."""
    x = (x & _P) + (x >> _TOP)
    x -= _P * (x >= _P)
    return x


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of arrays below it."""
    a1, a0, b1, b0 = a >> _HALF, a & _LOW, b >> _HALF, b & _LOW
    middle = a1 * b0 + a0 * b1  # times 2 ** 31; 2 ** 61 is 1
    low = a0 * b0
    return _fold((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << _HALF) + (low & _P) + (low >> _TOP))


def _halves(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bits of the base's powers 0 to n and more."""
    power = _power("up", n)
    kept = per_process()["powers", _BASE]
    if len(kept.get("halves", ((),))[0]) < len(power):
        kept["halves"] = power >> _HALF, power & _LOW
    return kept["halves"]


def _power(which: str, n: int) -> np.ndarray:
    """Powers 0 to n and more of the base (up) or its inverse (down); a worker keeps them."""
    kept = per_process().setdefault(("powers", _BASE), {})
    have = kept.get(which)
    if have is None or len(have) <= n:
        base = _BASE if which == "up" else pow(_BASE, -1, _PRIME)
        have = np.ones(1, np.uint64) if have is None else have
        while len(have) <= n:
            have = np.append(have, times(have, np.full(1, pow(base, len(have), _PRIME), np.uint64)))
        kept[which] = have
    return have


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of the bytes times the base's powers, for the upper and lower
    bits of a power apart; differences are exact for spans under 32 MB (2 ** 25 bytes)."""
    out = np.zeros((2, len(raw) + 1), np.uint64)
    for half, to in zip(_halves(len(raw)), out, strict=True):
        np.cumsum(raw * half[: len(raw)], out=to[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end]; equal strings have equal hashes wherever they stand."""
    high, low = prefix[0][end] - prefix[0][start], prefix[1][end] - prefix[1][start]
    high = _fold(high)
    own = _fold(((high << _HALF) & _P) + (high >> np.uint64(30)) + (low & _P) + (low >> _TOP))  # 2 ** 31 turns 61 bits round
    return scramble(times(own, _power("down", prefix.shape[1])[start]) + (end - start).astype(np.uint64))


_MIX = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROUGH = 0x9E3779B97F4A7C15


def window_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all windows of n bytes, modulo 2 ** 64: quick, and good
    for choosing and grouping places, but long texts can be made to collide."""
    kept = per_process().setdefault("rough powers", {})
    if len(kept.get("up", ())) < len(raw):
        for name, base in (("up", _ROUGH), ("down", pow(_ROUGH, -1, 1 << 64))):
            power = np.full(2 * len(raw) + 1, np.uint64(base), np.uint64)
            power[0] = 1
            kept[name] = np.multiply.accumulate(power)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_MIX[raw] * kept["up"][: len(raw)], out=prefix[1:])
    return scramble((prefix[n:] - prefix[:-n]) * kept["down"][: max(0, len(raw) - n + 1)] + np.uint64(n))


def whole_groups(batches, columns: list[str], least: int) -> Iterator[pa.Table]:
    """Tables of ``least`` rows and more out of rows sorted by ``columns``; the
    rows of a group stay together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < least:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = [rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in columns]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut).combine_chunks().to_batches()
        n -= cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def column(rows: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    """A column as one array."""
    out = rows.column(rows.schema.get_field_index(name))
    if isinstance(out, pa.ChunkedArray):
        out = out.combine_chunks()
        out = out.chunk(0) if isinstance(out, pa.ChunkedArray) else out
    return out


def text_key() -> list:
    """Columns k1, k2: 128 bits that stand for a row's doc_id and text."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2")]


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges(a, b) -> (a, b): every node with the smallest node of its component,
    which has no row itself. Alternates large stars and small stars; each step is
    a table in the shared folder, and only a count and a checksum reach the driver."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = written(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(small.filter("a <> b").distinct(), name)
