"""License scans with a positional rare-token index.

The templates' words have postings (template, position). Of each file, the
licence words with the highest inverse document frequency are looked up, down
to the rank below which no template could reach the wanted share any more.
Postings are intersected by relative position: a sweep over the diagonals (place
in the file less place in the template) finds those where enough weight meets.
There the mandatory key phrase is verified word by word and the share counted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.llm.common import chunks, prefix_hashes, span_hashes, table
from webreach.llm.registry import register

#: Key phrases whose every place counts.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: label, template, mandatory key phrase. Opening sentences of public licenses.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license", "creative commons attribution sharealike"),
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
MARK_BITS = 20
#: Words of a file whose postings are held together.
BLOCK_WORDS = 1 << 15
#: Text of a table of templates, which comes to the driver and goes to the tasks.
TEMPLATE_BYTES = 1 << 24
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_EPS = 1e-6


@dataclass(frozen=True)
class Index:
    hashes: np.ndarray               # of the vocabulary's words, ascending; a word's number is its place
    mark: np.ndarray                 # top bits of a hash -> any word has them
    phrases: tuple[tuple[np.ndarray, str], ...]
    templates: tuple[tuple[np.ndarray, str, np.ndarray], ...]
    at: np.ndarray                   # word -> its first posting, and one more
    template: np.ndarray             # of each posting
    position: np.ndarray

    @property
    def size(self) -> int:
        return len(self.hashes)


def build(phrases=PHRASES, templates=TEMPLATES) -> Index:
    """Vocabulary and postings of the given phrases and templates; the size is
    theirs alone. A template without a word is left out."""
    split = lambda text: WORD.findall((text or "").translate(_ASCII_LOWER))
    phrases = [(split(p), label) for p, label in phrases]
    templates = [(split(t), label, split(key)) for label, t, key in templates if split(t)]
    vocabulary = sorted({w for part in [p for p, _ in phrases] + [t for t, _, _ in templates] + [k for _, _, k in templates] for w in part})
    raw = np.frombuffer("".join(vocabulary).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in vocabulary], dtype=np.int64)
    hashes = span_hashes(prefix_hashes(raw), np.concatenate(([0], end[:-1])), end) if vocabulary else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    number = {vocabulary[j]: i for i, j in enumerate(order.tolist())}
    mark = np.zeros(1 << MARK_BITS, bool)
    mark[(hashes >> np.uint64(64 - MARK_BITS)).astype(np.int64)] = True
    ids = lambda part: np.array([number[w] for w in part], np.int64)
    templates = tuple((ids(t), label, ids(key)) for t, label, key in templates)
    none = [np.zeros(0, np.int64)]
    word = np.concatenate(none + [t for t, _, _ in templates])
    by = np.argsort(word, kind="stable")
    return Index(hashes[order], mark, tuple((ids(p), label) for p, label in phrases), templates,
                 np.searchsorted(word[by], np.arange(len(vocabulary) + 1)),
                 np.repeat(np.arange(len(templates)), [len(t) for t, _, _ in templates])[by],
                 np.concatenate(none + [np.arange(len(t)) for t, _, _ in templates])[by])


def given(templates: DataFrame) -> list[tuple[str, str, str]]:
    """templates(label, text, key) as ``build`` takes them; rows without label or
    text are left out, a null key asks for nothing. Over TEMPLATE_BYTES of text
    is an error, as the whole index goes to every task."""
    rows = templates.filter("label is not null and text is not null").select("label", "text", F.coalesce("key", F.lit("")).alias("key")).distinct()
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("key"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"the templates hold {size} bytes of text, over {TEMPLATE_BYTES}")
    return [tuple(r) for r in rows.collect()]


def words(index: Index, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in the vocabulary or -1 of every word, words before each row)."""
    low = np.insert(_LOWER[raw], at[1:], 0)
    shift = at + np.arange(len(at))
    mask = _IS_WORD[low]
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    found = span_hashes(prefix_hashes(low), start, end)
    number = np.full(len(start), -1, np.int64)
    maybe = np.flatnonzero(index.mark[(found >> np.uint64(64 - MARK_BITS)).astype(np.int64)])
    nearest = np.searchsorted(index.hashes, found[maybe])
    nearest[nearest == index.size] = 0
    same = index.hashes[nearest] == found[maybe] if index.size else np.zeros(0, bool)
    number[maybe[same]] = nearest[same]
    return number, np.searchsorted(start, shift)


def places(number: np.ndarray, row: np.ndarray, phrase: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Starts of all places of the phrase: postings of its rarest word, kept
    where every other word stands at its relative position in the same row."""
    j = int(np.argmax(idf[phrase]))
    start = np.flatnonzero(number == phrase[j]) - j
    start = start[(start >= 0) & (start + len(phrase) <= len(number))]
    for i, word in enumerate(phrase):
        start = start[number[start + i] == word]
    return start[row[start] == row[start + len(phrase) - 1]]


def _frequencies(index: Index):
    def run(batches):
        for batch in batches:
            df, n = np.zeros(index.size, np.int64), 0
            for part, raw, at in chunks(batch):
                number, first = words(index, raw, at)
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                hit = number >= 0
                df += np.bincount(np.unique(row[hit] * index.size + number[hit]) % index.size, minlength=index.size)
                n += part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, index.size)), pa.array(np.concatenate(([n], df)))], ["word", "df"])
    return run


def idf(documents: DataFrame, index: Index) -> np.ndarray:
    """Inverse document frequency of each licence word over all rows, above 0
    for a word of every row too. What comes to the driver is one number per word
    of the vocabulary."""
    counts = {r.word: r.df for r in documents.select("text").mapInArrow(_frequencies(index), "word long, df long")
              .groupBy("word").agg(F.sum("df").alias("df")).collect()}
    return np.log1p((counts.get(-1, 0) + 1) / (np.array([counts.get(i, 0) for i in range(index.size)]) + 1))


@dataclass(frozen=True)
class Weights:
    idf: np.ndarray                  # of each word
    rank: np.ndarray                 # of each word, 0 for the highest IDF
    total: np.ndarray                # of each template, over its positions
    at: np.ndarray                   # word -> its first entry, and one more
    template: np.ndarray             # of each entry: a word and a template that holds it, in text or key
    share: np.ndarray                # weight of the word's positions there
    key: np.ndarray                  # 1 if the key phrase holds it
    n_key: np.ndarray                # distinct words in each template's key phrase


def weigh(index: Index, idf: np.ndarray) -> Weights:
    n = max(1, len(index.templates))
    in_key = np.concatenate([np.zeros(0, np.int64)] + [np.unique(key) * n + t for t, (_, _, key) in enumerate(index.templates)])
    posting = np.repeat(np.arange(index.size), np.diff(index.at))
    entry, where = np.unique(np.concatenate((posting * n + index.template, in_key)), return_inverse=True)
    word = entry // n
    rank = np.empty(index.size, np.int64)
    rank[np.lexsort((np.arange(index.size), -idf))] = np.arange(index.size)
    return Weights(idf, rank, np.array([idf[t].sum() for t, _, _ in index.templates]), np.searchsorted(word, np.arange(index.size + 1)), entry % n,
                   np.bincount(where[: len(posting)], minlength=len(entry)) * idf[word], np.isin(entry, in_key).astype(np.int64),
                   np.array([len(np.unique(key)) for _, _, key in index.templates], np.int64))


def _listed(at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the lists of the given words, and the place of the word each belongs to."""
    n = at[word + 1] - at[word]
    return np.arange(n.sum()) + np.repeat(at[word] - (np.cumsum(n) - n), n), np.repeat(np.arange(len(word)), n)


def lookups(index: Index, weights: Weights, row: np.ndarray, number: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, possible, left) of n files. A template is possible in a file that
    holds its key's words and words of ``least`` of its weight. Words up to rank
    ``depth`` (-1: none) are looked up; those below it have weight ``left`` in the
    template, too little without one that is looked up."""
    many, need = len(index.templates), least * weights.total - _EPS
    hit = np.flatnonzero(number >= 0)
    pair = np.unique(row[hit] * index.size + number[hit])
    entry, of = _listed(weights.at, pair % max(1, index.size))
    file, word = pair[of] // max(1, index.size), (pair % max(1, index.size))[of]
    cell, rank = file * many + weights.template[entry], weights.rank[word]
    total = np.bincount(cell, weights.share[entry], n * many).reshape(n, many)
    possible = (total >= need) & (np.bincount(cell, weights.key[entry], n * many).reshape(n, many) >= weights.n_key)
    own = np.flatnonzero(possible.ravel()[cell])
    own = own[np.lexsort((-rank[own], cell[own]))]  # lowest IDF first
    cell, rank, file, share = cell[own], rank[own], file[own], weights.share[entry[own]]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    before = np.cumsum(share) - share
    reached = np.cumsum(share) - np.repeat(before[first], np.diff(np.append(first, len(cell))))
    depth = np.full(n, -1)
    wanted = reached >= need[cell % max(1, many)]
    np.maximum.at(depth, file[wanted], rank[wanted])
    below = rank > depth[file]
    return depth, possible, np.bincount(cell[below], share[below], n * many).reshape(n, many)


def _crossings(index: Index, weights: Weights, place: np.ndarray, word: np.ndarray, need: np.ndarray, drift: int):
    """(template, from, to) of the diagonals within ``drift`` of which postings of
    the given words meet with weight ``need``; a template's position counts once."""
    entry, of = _listed(index.at, word)
    t, q, d = index.template[entry], index.position[entry], place[of] - index.position[entry]
    own = np.isfinite(need[t])
    if not own.any():
        return
    t, q, d, weight = t[own], q[own], d[own], weights.idf[word[of[own]]]
    order = np.lexsort((d, q, t))
    t, q, lo, weight = t[order], q[order], d[order] - drift, weight[order]
    hi = lo + 2 * drift + 1
    again = (t[1:] == t[:-1]) & (q[1:] == q[:-1])
    hi[:-1][again] = np.minimum(hi[:-1], lo[1:])[again]
    base, span = lo.min(), hi.max() - lo.min() + 1
    edge, where = np.unique(np.concatenate((t * span + lo - base, t * span + hi - base)), return_inverse=True)
    level = np.cumsum(np.bincount(where, np.concatenate((weight, -weight)), len(edge)))
    for i in np.flatnonzero(level[:-1] >= need[edge[:-1] // span]).tolist():
        yield int(edge[i] // span), int(edge[i] % span + base), int(edge[i + 1] - edge[i] + edge[i] % span + base)


def _share(number: np.ndarray, template: np.ndarray, key: np.ndarray, idf: np.ndarray, d: int, drift: int) -> float:
    """Share of the template's weight found with its start at d, every word moved
    by ``drift`` at most; 0 if the key phrase doesn't stand there."""
    window = number[max(0, d - drift): max(0, min(len(number), d + len(template) + drift))]
    if len(key) and not any(np.array_equal(window[s: s + len(key)], key) for s in np.flatnonzero(window == key[0])):
        return 0.0
    hit = np.zeros(len(template), bool)
    for off in range(-drift, drift + 1):
        pos = d + off + np.arange(len(template))
        ok = (pos >= 0) & (pos < len(number))
        hit[ok] |= number[pos[ok]] == template[ok]
    return float(idf[template[hit]].sum() / idf[template].sum())


def aligned(index: Index, weights: Weights, number: np.ndarray, depth: int, possible: np.ndarray, left: np.ndarray, drift: int, least: float) -> dict[str, float]:
    """label -> best share of the templates found in one file's words, looked
    through a block of places at a time."""
    found: dict[str, float] = {}
    need = np.where(possible, least * weights.total - left - _EPS, np.inf)
    place = np.flatnonzero(number >= 0)
    place = place[weights.rank[number[place]] <= depth]
    reach = max(len(t) for (t, _, _), p in zip(index.templates, possible, strict=True) if p) + drift
    for start in range(-reach, len(number), BLOCK_WORDS):
        own = place[slice(*np.searchsorted(place, (start - drift, start + BLOCK_WORDS + reach)))]
        for t, lo, hi in _crossings(index, weights, own, number[own], need, drift):
            template, label, key = index.templates[t]
            for d in range(max(lo, start), min(hi, start + BLOCK_WORDS)):
                if found.get(label, 0.0) < 1 and (share := _share(number, template, key, weights.idf, d, drift)) >= least:
                    found[label] = max(found.get(label, 0.0), share)
    return found


def _scan(index: Index, weights: Weights, drift: int, least: float):
    def run(batches):
        for batch in batches:
            for part, raw, at in chunks(batch):
                number, first = words(index, raw, at)
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                n_base, lo, hi = np.zeros(part.num_rows, np.int64), np.full(part.num_rows, 1 << 62), np.full(part.num_rows, -1)
                base = [set() for _ in range(part.num_rows)]
                for phrase, label in index.phrases:
                    start = places(number, row, phrase, weights.idf)
                    own = row[start]
                    np.add.at(n_base, own, 1)
                    np.minimum.at(lo, own, start - first[own])
                    np.maximum.at(hi, own, start - first[own])
                    for r in set(own.tolist()):
                        base[r].add(label)
                labels, score = [set(b) for b in base], np.where(n_base > 0, 1.0, 0.0)
                depth, possible, left = lookups(index, weights, row, number, part.num_rows, least)
                for f in np.flatnonzero(depth >= 0).tolist():
                    for label, share in aligned(index, weights, number[first[f]: first[f + 1]], depth[f], possible[f], left[f], drift, least).items():
                        score[f] = max(score[f], share)
                        labels[f].add(label)
                join = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), pa.array(np.diff(first).astype(np.int64)), pa.array(n_base),
                     pa.array(lo, mask=none), pa.array(hi, mask=none), join(base), join(labels), pa.array(np.minimum(score, 1.0))],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    return run


def scan(documents: DataFrame, templates: DataFrame | None = None, drift: int = 3, least: float = 0.6) -> DataFrame:
    """documents(doc_id, text), templates(label, text, key; default TEMPLATES) ->
    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    for every row.

    Words are counted over the whole lower-cased (A-Z) text; a null or empty
    text has none. ``n_base`` counts the places of PHRASES, ``first_word`` and
    ``last_word`` are their outermost starts (null without one). A template's
    label is added if, for some place, words with ``least`` of its IDF weight
    stand within ``drift`` of theirs and its key phrase stands there too; a label
    may have several templates. ``score`` is the best share of such a template,
    1 for a base phrase, else 0. All places of all templates are decided as by
    trying each. Repeated rows give repeated rows, an empty table none; other
    columns are ignored.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    index = build() if templates is None else build(templates=given(templates))
    return documents.select("doc_id", "text").mapInArrow(
        _scan(index, weigh(index, idf(documents, index)), drift, least),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


@register("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates of every whole text of ``documents``; see ``scan`` for the columns."""
    return scan(table(spark, sf_dir, "documents"))
