"""URL column functions (O-B1..O-B9, O-J2 helpers).

All functions take and return Columns and stay inside whole-stage codegen /
native higher-order functions: no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webreach.functions import patterns as P


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nstruct(**fields) -> Column:
    """Struct with explicit field names (safe inside lambdas and generators)."""
    args = []
    for k, v in fields.items():
        args += [F.lit(k), col(v) if isinstance(v, Column) else F.lit(v)]
    return F.named_struct(*args)


def let(value, fn) -> Column:
    """Bind ``value`` once and build ``fn(bound)``.

    Python-side Column composition copies a sub-expression every time it is
    reused; chained reuse grows the plan multiplicatively. Binding through a
    one-element array keeps every expression tree linear in size.
    """
    return F.element_at(F.transform(F.array(col(value)), fn), 1)


def py_strip(c) -> Column:
    """str.strip(): remove Unicode whitespace at both ends (Spark trim is ASCII-space only)."""
    return F.btrim(col(c), F.lit(P.WS_CHARS))


def normalize_url(c) -> Column:
    """O-B1: strip; empty stays empty; no scheme -> prefix https://."""
    s = py_strip(c)
    return (F.when(s == "", F.lit(""))
            .when(s.rlike(P.SCHEME), s)
            .otherwise(F.concat(F.lit("https://"), s)))


def is_valid_url(c) -> Column:
    """O-B2: anchored http(s) URL test."""
    return F.coalesce(col(c).rlike(P.VALID_URL), F.lit(False))


def _call(name: str, *cols) -> Column:
    from webreach.functions import sqlfns
    sqlfns.ensure()
    return F.call_function(name, *[col(c) for c in cols])


def clean_url(c) -> Column:
    """O-B3: strip tracking parameters (lower-cased names), drop blank values,
    group repeated keys at their first occurrence, re-encode, keep the rest,
    strip trailing '?'. Session SQL function ``webreach_clean_url``."""
    return _call("webreach_clean_url", c)


def strip_key(c) -> Column:
    """Cut at the first '#' and strip trailing '/' (O-B6 link key)."""
    return F.rtrim(F.substring_index(col(c), "#", 1), F.lit("/"))


def page_key(c) -> Column:
    """Lookup key of a URL: clean_url minus fragment and trailing '/'."""
    return strip_key(clean_url(c))


def join_key(c) -> Column:
    """``page_key`` for the side of an inner join whose rows have a URL. It is never
    null ('#', which no page key holds, stands for none), so the join asks for no
    filter on it, which would clean every URL a second time."""
    return F.coalesce(page_key(c), F.lit("#"))


_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def netloc(c) -> Column:
    u = col(c)
    return F.when(u.rlike(_NETLOC), F.regexp_extract(u, _NETLOC, 1)).otherwise(F.lit(""))


def url_domain(c) -> Column:
    """O-B4: authority of the cleaned URL, or the cleaned URL if it has none."""
    return _call("webreach_url_domain", c)


def display_url(c) -> Column:
    """O-B7: drop http(s):// and one trailing '/'."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^https?://", ""), r"/\z", "")


def resolve_link(base, href) -> Column:
    """O-B5: resolve ``href`` against ``base`` like the standard urljoin:
    another scheme is returned as is; same scheme with authority,
    protocol-relative ``//host``, query/fragment only, absolute path and
    relative path with dot segments are resolved. ``;params`` count as path.
    Session SQL function ``webreach_resolve_link``."""
    return _call("webreach_resolve_link", base, href)


def search_key(company: Column, suffix: str) -> Column:
    """O-B9: search query text built from a company name or domain."""
    return F.concat(company, F.lit(suffix))
