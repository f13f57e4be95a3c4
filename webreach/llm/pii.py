"""Personal data: base patterns and a linear-chain CRF over word shapes.

The CRF is fitted from a small labelled table (sentences made by rule, with
one label a word), and decoded by Viterbi over the words of every line. Its
spans are added where they hold as personal data and touch no base span.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from webreach.llm import crf as C
from webreach.llm.common import chunks, runs, table
from webreach.llm.registry import register

KINDS = ("email", "ip", "card", "phone")
_CLASS = {
    "email": (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@", 5, b"@"),
    "ip": (b"0123456789.", 7, b"."),
    "card": (b"0123456789 -", 12, b""),
    "phone": (b"+0123456789 ().-", 10, b"+"),
}
_PATTERN = {
    "email": re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(rb"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT = re.compile(rb"[0-9]")


def _lut(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_LUTS = {kind: _lut(members) for kind, (members, _, _) in _CLASS.items()}


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def holds(kind: str, match: bytes) -> bool:
    digits = b"".join(_DIGIT.findall(match))
    if kind == "ip":
        return all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in match.split(b"."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def base_spans(buf: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes of ``buf``, whose rows end with a zero
    byte. No match crosses a run of its kind's characters, so the runs that
    are long enough are searched on their own."""
    found, data = [], buf.tobytes()
    for k, kind in enumerate(KINDS):
        start, end = runs(_LUTS[kind][buf])
        long = end - start >= _CLASS[kind][1]
        must = _CLASS[kind][2]
        for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True):
            if must and data.find(must, s, e) < 0:
                continue
            for m in _PATTERN[kind].finditer(data, s, e):
                if holds(kind, m[0]):
                    found.append((m.start(), k, m.end()))
    return sorted(found)


# ---- word shapes -------------------------------------------------------------

_SPACE = _lut(b" \t\n\x0b\x0c\r\x00")
_COUNTED = {"digit": _lut(b"0123456789"), "upper": _lut(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "lower": _lut(b"abcdefghijklmnopqrstuvwxyz"), "dot": _lut(b"."),
            "at": _lut(b"@"), "dash": _lut(b"-/"), "mark": _lut(b"=:\"'_<>{}[]#$%&*|")}
_EDGE = np.full(256, 5, np.int64)  # kind of a word's first and last character
for _kind, _members in enumerate((_COUNTED["lower"], _COUNTED["upper"], _COUNTED["digit"], _lut(b"+"), _lut(b"()[]"))):
    _EDGE[_members] = _kind
_LENGTHS = np.array([1, 2, 3, 4, 5, 7, 10, 14, 20])
_DIGITS = np.array([0, 1, 2, 3, 4, 5, 9, 12, 20])
_SIZES = (10, 10, 12, 16, 9, 36, 10, 10, 36, 36)
_SHIFT = np.concatenate(([0], np.cumsum(_SIZES)))
N_FEATURES = int(_SHIFT[-1])


def shapes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (starts, ends), their feature numbers and the words of each line;
    a line ends with a newline or a zero byte."""
    start, end = runs(~_SPACE[buf])
    if not len(start):
        return start, end, np.zeros((0, len(_SIZES)), np.int64), np.zeros(0, np.int64)
    bounds = np.stack([start, end], 1).ravel()
    if bounds[-1] == len(buf):
        bounds = bounds[:-1]
    count = {n: np.add.reduceat(lut[buf], bounds, dtype=np.int32)[::2] for n, lut in _COUNTED.items()}
    size = end - start
    digits = np.searchsorted(_DIGITS, count["digit"], "left")
    dots = np.minimum(count["dot"], 5) * 2 + (count["dot"] + count["digit"] == size)
    flags = (count["at"] > 0) + 2 * (count["dash"] > 0) + 4 * (count["mark"] > 0) + 8 * (count["lower"] + count["upper"] > 0)
    case = np.minimum(count["upper"], 2) * 3 + np.minimum(count["lower"], 2)
    edges = _EDGE[buf[start]] * 6 + _EDGE[buf[end - 1]]
    line = np.searchsorted(np.flatnonzero((buf == 10) | (buf == 0)), start)
    new = np.diff(line, prepend=-1) != 0
    before, after = np.roll(digits, 1), np.roll(digits, -1)
    e_before, e_after = np.roll(edges, 1), np.roll(edges, -1)
    before[new], e_before[new] = 0, 35
    after[np.roll(new, -1)], e_after[np.roll(new, -1)] = 0, 35
    features = np.stack([np.searchsorted(_LENGTHS, size, "left"), digits, dots, flags, case, edges, before, after, e_before, e_after], 1) + _SHIFT[:-1]
    first = np.flatnonzero(new)
    return start, end, features, np.diff(np.append(first, len(start)))


@functools.cache
def labelled(n: int = 600, seed: int = 7) -> tuple[tuple[tuple[str, ...], tuple[int, ...]], ...]:
    """The small labelled table: sentences of words with their labels (0: none,
    1 + number of the kind), made by rule in common written forms, next to
    dates, prices, versions, order numbers and keys that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("th", "an", "er", "on", "re", "he", "in", "ed", "en", "es", "la", "de", "qu")) for _ in range(r.randint(1, 4)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    octet = lambda: str(r.randint(0, 255))
    forms = (
        (1, lambda: [f"{word()}.{num(2)}@{word()}{num(1)}.example.com"]), (1, lambda: [f"{word()}@{word()}.org"]),
        (2, lambda: [".".join(octet() for _ in range(4))]),
        (3, lambda: [num(16)]), (3, lambda: [num(4) for _ in range(4)]), (3, lambda: ["-".join(num(4) for _ in range(4))]),
        (4, lambda: ["+" + num(1), f"({num(3)})", f"{num(3)}-{num(4)}"]), (4, lambda: [f"({num(3)})", f"{num(3)}-{num(4)}"]),
        (4, lambda: [f"{num(3)}-{num(3)}-{num(4)}"]), (4, lambda: [f"{num(3)}.{num(3)}.{num(4)}"]), (4, lambda: ["+" + num(11)]),
        (0, lambda: [f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)}"]), (0, lambda: [f"{num(2)}/{num(2)}/20{num(2)}"]), (0, lambda: [f"${num(3)}.{num(2)}"]),
        (0, lambda: [f"v{num(1)}.{num(1)}.{num(2)}"]), (0, lambda: [f"{num(1)}.{num(2)}"]), (0, lambda: [num(r.randint(1, 8))]),
        (0, lambda: ["AKIA" + word().upper() + num(8)]), (0, lambda: [f"password={num(6)}{word()}"]), (0, lambda: ["token", "=", f'"{num(12)}{word()}"']),
        (0, lambda: [word() + "***"]), (0, lambda: [word().upper() + "!!"]), (0, lambda: ["|", word(), "|"]),
    )
    out = []
    for i in range(n):
        words, labels = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 5)):
                words.append(word().capitalize() if r.random() < 0.1 else word() + r.choice(("", "", "", ",", ".")))
                labels.append(0)
            label, make = forms[(i + r.randrange(len(forms))) % len(forms)] if r.random() < 0.8 else (0, lambda: [word()])
            new = make()
            words += new[:-1] + [new[-1] + r.choice(("", "", ".", ","))]
            labels += [label] * len(new)
        out.append((tuple(words), tuple(labels)))
    return tuple(out)


def model(rows=None, rounds: int = 80) -> C.Crf:
    """The CRF of a labelled table: sentences of (words, labels)."""
    rows = labelled() if rows is None else rows
    rows = [(w, y) for w, y in rows if w]
    buf = np.frombuffer("\n".join(" ".join(w) for w, _ in rows).encode() + b"\n", np.uint8)
    _, _, features, lengths = shapes(buf)
    return C.fit(features, np.array([y for _, ys in rows for y in ys], np.int64), lengths, N_FEATURES, 1 + len(KINDS), rounds=rounds)


def crf_spans(buf: np.ndarray, field: C.Crf) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes: runs of words of one label, without
    punctuation around them, that hold as personal data of their kind."""
    start, end, features, lengths = shapes(buf)
    if not len(start):
        return []
    label = C.viterbi(field, C.scores(field, features), lengths)
    new = np.zeros(len(start), bool)
    new[np.cumsum(lengths)[:-1]] = True
    head = np.flatnonzero((label > 0) & (new | (np.diff(label, prepend=np.int8(0)) != 0)))
    stop = np.flatnonzero((label > 0) & np.append(new[1:] | (np.diff(label) != 0), True))
    out = []
    for a, b in zip(head.tolist(), stop.tolist(), strict=True):
        k, raw = int(label[a]) - 1, buf[start[a]: end[b]].tobytes()
        body = raw.strip(b".,;:!?\"'<>[]{}*#$%&|") if KINDS[k] != "phone" else raw.strip(b".,;:!?\"'<>[]{}*#$%&|-")
        if not body or re.search(rb"[A-Za-z\x80-\xff=:\"'_/]", body) and KINDS[k] != "email":
            continue
        digits = len(_DIGIT.findall(body))
        fits = {"email": bool(_PATTERN["email"].fullmatch(body)), "ip": bool(_PATTERN["ip"].fullmatch(body)), "card": digits >= 12, "phone": 10 <= digits <= 15 and bool(re.search(rb"[() .-]", body))}[KINDS[k]]
        if fits and holds(KINDS[k], body):
            s = int(start[a]) + raw.find(body)
            out.append((s, k, s + len(body)))
    return out


def _find(field: C.Crf):
    def run(batches):
        for batch in batches:
            for part, raw, at in chunks(batch):
                buf = np.insert(raw, at[1:], 0)
                edge = at + np.arange(len(at))
                base = base_spans(buf)
                taken = np.array([(s, e) for s, _, e in base], np.int64).reshape(-1, 2)
                reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
                more = []
                for s, k, e in crf_spans(buf, field):
                    i = int(np.searchsorted(taken[:, 0], e))
                    if not i or reach[i - 1] <= s:
                        more.append((s, k, e))
                counts = np.zeros((len(KINDS), part.num_rows), np.int64)
                own, every = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
                places = {}
                for is_base, spans in ((True, base), (False, more)):
                    for s, k, e in spans:
                        r = int(np.searchsorted(edge, s, "right")) - 1
                        if r not in places:  # code points before each byte of the row
                            places[r] = np.concatenate(([0], np.cumsum((buf[edge[r]: edge[r + 1]] & 0xC0) != 0x80)))
                        item = (int(places[r][s - edge[r]]), k, int(places[r][e - edge[r]]))
                        every[r].append(item)
                        if is_base:
                            own[r].append(item)
                            counts[k, r] += 1
                line = lambda items: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(items))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), *map(pa.array, counts),
                     pa.array([hashlib.sha256(line(x).encode()).hexdigest() for x in own], pa.string()), pa.array([line(x) for x in every], pa.string())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return run


def find(documents: DataFrame, field: C.Crf | None = None) -> DataFrame:
    """documents(doc_id, text) -> one row per row: counts of the base kinds, a
    digest of the base spans, and all spans (kind:start:end, code points).

    A null or empty text has none. Repeated rows give repeated rows; other
    columns are ignored. Words of a line of any length are decoded together.
    """
    return documents.select("doc_id", "text").mapInArrow(
        _find(model() if field is None else field),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


@register("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
