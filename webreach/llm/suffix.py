"""Removal of byte strings that start in more than one place.

Two equal strings of ``length`` bytes share the anchor that they hold, the
smallest hash of their ``GRAM``-byte parts. So a text's window starts are cut
into runs with one anchor, each with a context of a few hundred bytes, and only
contexts whose anchor occurs twice can repeat. All contexts of an anchor stand
aligned at it. They are sorted column by column, from the last byte to the
first: each round inserts one symbol for each context, turns the order of the
suffixes by it (a stable sort of the column's Burrows-Wheeler symbols) and
updates the common prefixes of neighbours. A window repeats if its suffix
shares ``length`` bytes with a neighbour.

An anchor with more contexts than a task should hold is split before the sort:
its windows are dealt by ranges of their distance to the anchor and by the bytes
that all windows of a range hold, ever shorter ranges until the groups are small.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.llm.common import chunks, column, prefix_hashes, scramble, span_hashes, table, text_key, utf8, whole_groups, window_hashes, written
from webreach.llm.registry import register

LENGTH = 200
#: Contexts that are sorted together; those of one group always are.
BATCH = 16_384
#: Contexts of one group; an anchor with more is split.
HOT = 4_096


def gram(length: int) -> int:
    return max(1, length // 4)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w neighbours, by block prefixes and suffixes."""
    n = len(x)
    blocks = np.concatenate((x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1: n])


def anchors(raw: np.ndarray, at: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of window starts with one anchor: row, start in the row, number of
    starts, bytes from the start to the anchor, hashes of anchor and context."""
    g = gram(length)
    w = length - g + 1
    n = len(raw)
    if n < length:
        none = np.zeros(0, np.int64)
        return {k: none for k in ("row", "start", "count", "lead", "h", "cid")}
    prefix = prefix_hashes(raw)
    place = np.arange(n - g + 1)
    bits = np.uint64(max(1, n.bit_length()))
    found = window_hashes(raw, g)
    best = sliding_min((found >> bits << bits) | place.astype(np.uint64), w)
    anchor = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row_of = lambda x: np.searchsorted(at, x, "right") - 1
    # a window lies in the row that it starts in, if it also ends there
    inside = np.zeros(len(anchor) + 1, np.int8)
    own = np.flatnonzero(np.diff(at) >= length)
    np.add.at(inside, at[own], 1)
    np.add.at(inside, at[own + 1] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(valid):
        return {k: valid for k in ("row", "start", "count", "lead", "h", "cid")}
    new = np.flatnonzero((np.diff(anchor[valid], prepend=-1) != 0) | (np.diff(valid, prepend=-2) != 1))
    start, count = valid[new], np.diff(np.append(new, len(valid)))
    row = row_of(start)
    return {"row": row, "start": start - at[row], "count": count, "lead": anchor[start] - start,
            "h": found[anchor[start]].view(np.int64), "cid": span_hashes(prefix, start, start + count + length - 1).view(np.int64)}


def _anchor_rows(length: int):
    def run(batches):
        for batch in batches:
            for part, raw, at in chunks(batch):
                a = anchors(raw, at, length)
                row = pa.array(a["row"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a["h"]), pa.array(a["cid"]), column(part, "k1").take(row), column(part, "k2").take(row),
                     pa.array(a["start"].astype(np.int32)), pa.array(a["count"].astype(np.int32)), pa.array(a["lead"].astype(np.int32))],
                    ["h", "cid", "k1", "k2", "start", "count", "lead"])
    return run


def repeats(matrix: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """matrix: a column for each context, -1 where it has no byte. True where
    ``length`` bytes from a row on equal those of another context of its group."""
    rows, n = matrix.shape
    out = np.zeros((rows, n), bool)
    order = np.argsort(group, kind="stable")
    rank = np.cumsum(np.diff(group[order], prepend=group[order[0]]) != 0)
    common = np.zeros(n + 1, np.int32)  # of a suffix and the one before it
    for c in range(rows - 1, -1, -1):
        symbol = matrix[c][order]
        key = rank * 257 + symbol + 1
        if (key[1:] >= key[:-1]).all():
            turn = None
        else:
            turn = np.argsort(key, kind="stable")
            order, symbol, key = order[turn], symbol[turn], key[turn]
        same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] >= 0)) + 1
        new = np.zeros(n + 1, np.int32)
        if turn is None:
            new[same] = common[same] + 1
        elif len(same):
            a, b = turn[same - 1] + 1, turn[same] + 1
            far = b > a + 1
            new[same] = common[a] + 1
            if far.any():
                new[same[far]] = np.minimum.reduceat(common, np.stack([a[far], b[far]], 1).ravel())[::2] + 1
        common = new
        # the rank goes with the place, as groups stay where they are
        out[c, order[(common[:-1] >= length) | (common[1:] >= length)]] = True
    return out


def _sort_contexts(length: int):
    width = 2 * (length - gram(length)) + gram(length)  # at most so many bytes before, in and after an anchor
    zero = length - gram(length)                        # the row of an anchor's first byte

    def run(batches):
        for rows in whole_groups(batches, ["h"], BATCH):
            h, lead, count = (column(rows, c).to_numpy() for c in ("h", "lead", "count"))
            raw, at = utf8(column(rows, "context"))
            n = len(h)
            matrix = np.full((width, n), -1, np.int16)
            owner = np.repeat(np.arange(n), np.diff(at))
            matrix[np.arange(len(raw)) - at[owner] + zero - lead[owner], owner] = raw
            hit = repeats(matrix, h, length)
            own = np.flatnonzero(np.diff(np.concatenate((np.zeros((1, n), np.int8), hit.view(np.int8), np.zeros((1, n), np.int8))), axis=0).T.ravel())
            who, edge = own // (width + 1), own % (width + 1)
            first = np.searchsorted(who, np.arange(n + 1))
            edge = (edge - (zero - lead)[who]).astype(np.int32)
            starts = [edge[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([column(rows, "h"), column(rows, "cid"), pa.array(starts, pa.binary())], ["h", "cid", "starts"])
    return run


def _contexts(length: int):
    def run(batches):
        for batch in batches:
            for part, raw, at in chunks(batch):
                wanted = column(part, "wanted").to_pylist()
                h, cid, lead, count, context = [], [], [], [], []
                data = raw.tobytes()
                for r, some in enumerate(wanted):
                    for x in some:
                        s = int(at[r]) + x["start"]
                        h.append(x["h"]), cid.append(x["cid"]), lead.append(x["lead"]), count.append(x["count"])
                        context.append(data[s: s + x["count"] + length - 1])
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(cid, pa.int64()), pa.array(lead, pa.int32()), pa.array(count, pa.int32()), pa.array(context, pa.binary())],
                                                 ["h", "cid", "lead", "count", "context"])
    return run


def _pieces(length: int, step: int):
    """Contexts, cut where the distance of a window's start to the anchor passes
    a multiple of ``step``. Equal windows have the same distance, so they stand
    in one range, and share its key: the bytes that all windows of it hold."""
    far = length - gram(length)  # the largest distance

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lead, count = (column(batch, c).to_numpy().astype(np.int64) for c in ("lead", "count"))
            raw, at = utf8(column(batch, "context"))
            prefix = prefix_hashes(raw)
            last = lead - count + 1  # distance of the last window
            many = lead // step - last // step + 1
            own = np.repeat(np.arange(len(lead)), many)
            slot = lead[own] // step - (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many))
            low, high = slot * step, np.minimum(slot * step + step - 1, far)
            new_lead = np.minimum(high, lead[own])
            new_count = new_lead - np.maximum(low, last[own]) + 1
            off = lead[own] - new_lead
            anchor = at[own] + lead[own]
            start = at[own] + off
            end = start + new_count + length - 1
            key = span_hashes(prefix, anchor - low, anchor - high + length) + scramble(slot.astype(np.uint64))
            data = raw.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(span_hashes(prefix, start, end).view(np.int64)), column(batch, "h").take(pa.array(own)), column(batch, "cid").take(pa.array(own)),
                 pa.array(off.astype(np.int32)), pa.array(new_lead.astype(np.int32)), pa.array(new_count.astype(np.int32)),
                 pa.array([data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())],
                ["key", "piece", "h", "cid", "off", "lead", "count", "context"])
    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            for part, raw, at in chunks(batch):
                runs_, sha, kept_text = [], [], []
                removed = np.zeros(part.num_rows, np.int64)
                for r, some in enumerate(column(part, "found").to_pylist()):
                    own = raw[at[r]: at[r + 1]]
                    if some:
                        edge = np.zeros(len(own) + 1, np.int32)
                        for x in some:
                            a = np.frombuffer(x["starts"], np.int32).reshape(-1, 2) + x["start"]
                            np.add.at(edge, a[:, 0], 1)
                            np.add.at(edge, a[:, 1] - 1 + length, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed[r] = gone.sum()
                        runs_.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                        own = own[~gone]
                    else:
                        runs_.append(0)
                    kept_text.append(own.tobytes())
                    sha.append(hashlib.sha256(kept_text[-1]).hexdigest())
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(np.diff(at)), pa.array(removed), pa.array(runs_, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.binary())],
                                                 ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def repeated_starts(documents: DataFrame, length: int) -> DataFrame:
    """documents(k1, k2, text) -> (k1, k2, found): array of (start, starts), the
    run's place in the text and the edges of the repeated window starts in it."""
    found = documents.mapInArrow(_anchor_rows(length), "h long, cid long, k1 long, k2 long, start int, count int, lead int")
    twice = written(found.groupBy("h").count().filter("count > 1").select("h"), "anchors")
    runs_ = written(found.join(twice, "h", "left_semi"), "runs")
    # equal contexts count once, with their number
    distinct = written(runs_.groupBy("h", "cid").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start", "count", "lead")).alias("one")).select("h", "cid", "n", "one.*"), "contexts")
    several = written(distinct.groupBy("h").count().filter("count > 1"), "several")

    def contexts(of: DataFrame) -> DataFrame:
        wanted = distinct.join(of, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "cid", "start", "count", "lead")).alias("wanted"))
        texts = documents.join(written(wanted, "wanted"), ["k1", "k2"]).select("text", "wanted")
        return texts.mapInArrow(_contexts(length), "h long, cid long, lead int, count int, context binary")

    part = _sorted(contexts(several.filter(F.col("count") <= HOT)), length)
    hot = several.filter(F.col("count") > HOT)
    if hot.count():
        part = part.unionByName(_split(written(contexts(hot), "hot-contexts"), length, 1 << (length - gram(length)).bit_length() >> 1))
    spans = written(_with_whole(distinct, part), "spans")
    placed = F.struct((F.col("start") + F.col("off")).alias("start"), "starts")
    return written(runs_.join(spans, ["h", "cid"]).groupBy("k1", "k2").agg(F.collect_list(placed).alias("found")), "found")


def _sorted(contexts: DataFrame, length: int) -> DataFrame:
    """contexts(h, cid, lead, count, context) -> (h, cid, off, starts) of those that repeat in part."""
    hits = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_sort_contexts(length), "h long, cid long, starts binary")
    return hits.filter("length(starts) > 0").select("h", "cid", F.lit(0).alias("off"), "starts")


def _with_whole(distinct: DataFrame, part: DataFrame) -> DataFrame:
    """A context that stands in two places repeats as a whole."""
    whole = distinct.filter("n > 1").select("h", "cid", F.lit(0).alias("off"), F.unhex(F.concat(F.lit("00000000"), _little(F.col("count")))).alias("starts"))
    return whole.unionByName(part.join(distinct.filter("n > 1").select("h", "cid"), ["h", "cid"], "left_anti").distinct())


def _split(contexts: DataFrame, length: int, step: int) -> DataFrame:
    """Like _sorted(), for groups of any size. The pieces of a range with one
    distance are whole windows, equal ones count once, and so no group is left."""
    pieces = written(contexts.mapInArrow(_pieces(length, step), "key long, piece long, h long, cid long, off int, lead int, count int, context binary"), "pieces")
    distinct = written(pieces.groupBy("key", "piece").agg(F.count("*").alias("n"), F.min(F.struct("lead", "count", "context")).alias("one"))
                       .select(F.col("key").alias("h"), F.col("piece").alias("cid"), "n", "one.*"), "piece-contexts")
    several = written(distinct.groupBy("h").count().filter("count > 1"), "piece-groups")
    of = lambda keys: distinct.join(keys, "h", "left_semi").select("h", "cid", "lead", "count", "context")
    part = _sorted(of(several.filter(F.col("count") <= HOT)), length)
    hot = several.filter(F.col("count") > HOT)
    if step > 1 and hot.count():
        part = part.unionByName(_split(written(of(hot), "hot-pieces"), length, step // 2))
    spans = written(_with_whole(distinct, part), "piece-spans").select(F.col("h").alias("key"), F.col("cid").alias("piece"), F.col("off").alias("inner"), "starts")
    return pieces.drop("context").join(spans, ["key", "piece"]).select("h", "cid", (F.col("off") + F.col("inner")).alias("off"), "starts")


def _little(number):
    """A number as the hex digits of an unsigned little-endian 32-bit one."""
    big = F.lpad(F.hex(number), 8, "0")
    return F.concat(*[F.substring(big, i, 2) for i in (7, 5, 3, 1)])


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents(doc_id, text) -> one row per row: (doc_id, n_bytes, n_removed,
    n_spans, kept_sha256, kept), ``kept`` being the bytes that no repeated string
    of ``length`` bytes covers.

    A string repeats if it starts at another place too, in the same text or any
    other; overlaps count. Null text counts as empty, shorter texts stay as they
    are, repeated rows are copies of each other. Other columns are ignored.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *text_key())
    found = repeated_starts(docs.select("k1", "k2", "text"), length)
    both = docs.join(found, ["k1", "k2"], "left").select("doc_id", "text", "found")
    return both.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


@register("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
