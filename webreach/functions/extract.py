"""Extractor column functions (O-D1..O-D6, O-D12, O-J1..O-J6).

Each returns a Column; array-valued extractors return *distinct* values so a
single ``explode`` turns them into candidate rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webreach.functions import patterns as P
from webreach.functions.urls import col, let, nstruct, py_strip


def find_all(c, pattern: str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))


def emails(c) -> Column:
    """O-D1: distinct e-mail matches, in time linear in the text.

    The text is cut at every '@': an address is the longest local part that
    ends a piece and the longest domain that begins the next one, so no long
    run of letters is tried from each of its characters.
    """
    return F.when(col(c).contains("@"), F.array_distinct(_addresses(col(c)))) \
        .otherwise(F.array().cast("array<string>"))


def _addresses(text: Column) -> Column:
    """array<string>: what a left-to-right search for ``P.EMAIL`` finds."""
    pieces = F.transform(F.split(text, "@"), lambda p: nstruct(
        p=p, domain=F.regexp_extract(p, r"\A" + P.EMAIL_DOMAIN, 0),
        local=F.reverse(F.regexp_extract(F.reverse(p), r"\A" + P.EMAIL_LOCAL, 0))))
    return let(pieces, _joined)


def _joined(z: Column) -> Column:
    ends = F.slice(z, 1, F.greatest(F.size(z) - 1, F.lit(0)))  # the last piece has no '@' behind it

    # F: no address at this '@'. L: one, unless the address before takes the whole
    # piece between the two. T: one in any case.
    def kind(x, i):
        return (F.when((x["local"] == "") | (F.get(z, i + 1)["domain"] == ""), F.lit("F"))
                .when((i > 0) & (x["domain"] == x["p"]), F.lit("L")).otherwise(F.lit("T")))

    # In a row of Ls every other one fails: behind a T (TL) the first one, else the second
    taken = F.split(F.regexp_replace(F.regexp_replace(F.array_join(F.transform(ends, kind), ""), "TL", "TX"), "LL", "LX"), "")
    is_taken = lambda s, i: ~F.coalesce(F.get(s, i), F.lit("F")).isin("F", "X")

    def address(s):
        def at(x, i):
            used = F.when((i > 0) & is_taken(s, i - 1), F.length(x["domain"])).otherwise(F.lit(0))
            free = F.substr(x["p"], used + 1)  # what the address before leaves of the piece
            local = F.when((used > 0) & (F.length(free) < F.length(x["local"])), free).otherwise(x["local"])
            return F.when(is_taken(s, i), F.concat(local, F.lit("@"), F.get(z, i + 1)["domain"]))
        return F.filter(F.transform(ends, at), lambda v: v.isNotNull())

    return let(taken, address)


def digits_only(c) -> Column:
    """O-J2: every non-digit removed (Unicode digits kept)."""
    return F.regexp_replace(col(c), r"\P{Nd}", "")


def has_min_digits(c, n: int = P.MIN_PHONE_DIGITS) -> Column:
    """O-D3."""
    return F.length(digits_only(c)) >= n


def phones(c) -> Column:
    """O-D2: union of the three effective patterns, then the 7-digit rule.

    The scans read only the runs of phone characters, a letter between any two,
    and these only if they have the shape every pattern contains (``PHONE_GUARD``).
    A text without seven such digits in a row (``PHONE_DIGITS``) has no runs to look for.
    """
    none = F.array().cast("array<string>")

    def scanned(runs):
        a, b, cc = (find_all(runs, p) for p in P.PHONE_PATTERNS)
        raw = F.filter(F.array_union(F.array_union(a, b), cc), lambda v: has_min_digits(v))
        return F.when(runs.rlike(P.PHONE_GUARD), raw).otherwise(none)

    found = let(F.array_join(find_all(c, P.PHONE_RUN), "x"), scanned)
    return F.when(col(c).isNull() | col(c).rlike(P.PHONE_DIGITS), found).otherwise(none)


def cf_decode(c) -> Column:
    """O-D4: protected-address decode: first byte is the XOR key.

    Invalid input (non-hex, fewer than 3 chars) decodes to ''. An odd
    trailing nibble is decoded on its own, like int('a', 16).
    """
    h = col(c)
    ok = (F.length(h) >= 3) & h.rlike(r"^[0-9a-fA-F]+\z")
    key = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
    n_pairs = F.floor((F.length(h) - 1) / 2).cast("int")
    idx = F.sequence(F.lit(1), F.greatest(n_pairs, F.lit(1)))
    chars = F.transform(idx, lambda i: F.chr(
        F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key)))
    return F.when(ok, F.array_join(chars, "")).otherwise(F.lit(""))


def mailto_address(href) -> Column:
    """O-D6: text after 'mailto:' up to the first '?', stripped."""
    h = col(href)
    return py_strip(F.substring_index(F.substr(h, F.lit(8)), "?", 1))


def normalize_phone(c) -> Column:
    """O-J1: the fixed phone spelling rules, applied exactly as specified.

    10 digits starting with 7 -> '+94 dd ddd ddddd';
    11 digits starting with 947 -> '+94 ' + d[3:5] + ' ' + d[5:8] + ' ' + d[8:];
    anything else unchanged.
    """
    d = digits_only(c)
    return (F.when((F.length(d) == 10) & F.startswith(d, F.lit("7")),
                   F.concat_ws(" ", F.lit("+94"), F.substring(d, 1, 2), F.substring(d, 3, 3),
                               F.substring(d, 6, 5)))
            .when((F.length(d) == 11) & F.startswith(d, F.lit("947")),
                  F.concat_ws(" ", F.lit("+94"), F.substring(d, 4, 2), F.substring(d, 6, 3),
                              F.substring(d, 9, 3)))
            .otherwise(col(c)))


def strip_distinct(arr) -> Column:
    """O-G1 on an array: strip, drop empty, keep first occurrence."""
    return F.array_distinct(F.filter(F.transform(col(arr), py_strip), lambda s: s != ""))


def join_list(arr, empty: str = "") -> Column:
    """O-J3: ', '-joined list; ``empty`` when the list is empty or null."""
    j = F.array_join(col(arr), ", ")
    return F.when(j.isNull() | (j == ""), F.lit(empty)).otherwise(j)


def empty_cell(c) -> Column:
    """O-J4."""
    return F.when(col(c).isNull() | (col(c) == ""), F.lit(P.EMPTY_CELL)).otherwise(col(c))


def trimmed(c) -> Column:
    """O-J5: null -> '', stripped."""
    return py_strip(F.coalesce(col(c), F.lit("")))
