"""Session SQL functions for the URL operators.

``clean_url`` and ``resolve_link`` are long expression trees; building them
through the Python Column API costs hundreds of JVM round trips per use.
They are defined once per session as SQL-bodied temporary functions, which
the analyzer expands into the same built-in expressions (no UDF at run
time), and called with one round trip.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from webreach.functions import patterns as P

_SPLIT = r"(?s)^([^?#]*)(\?([^#]*))?(#(.*))?\z"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_SCHEME_OF = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_SITE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?"


def r(s: str) -> str:
    """Raw Spark SQL string literal."""
    assert "'" not in s
    return "r'" + s + "'"


def _dec(x: str) -> str:
    # a '%' that begins no escape stands for itself
    return f"try_url_decode(regexp_replace({x}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"


def _enc(x: str) -> str:
    return f"replace(replace(url_encode({x}), '*', '%2A'), '%7E', '~')"


def _tracking() -> str:
    return "array(" + ", ".join(f"'{t}'" for t in P.TRACKING_PARAMS) + ")"


def clean_query_sql(q: str) -> str:
    fields = f"transform(split({q}, '&'), (f, i) -> named_struct('i', i, 'f', f))"
    kept = f"filter({fields}, p -> instr(p.f, '=') > 0 AND length(p.f) > instr(p.f, '='))"
    key = _dec("substring_index(p.f, '=', 1)")
    value = _dec("substr(p.f, instr(p.f, '=') + 1)")
    decoded = f"transform({kept}, p -> named_struct('i', p.i, 'k', {key}, 'v', {value}))"
    grouped = ("array_sort(transform(dec, e -> named_struct('g', array_position(transform(dec, d -> d.k), e.k),"
               " 'i', e.i, 'k', e.k, 'v', e.v)))")
    clean = f"filter({grouped}, e -> NOT array_contains({_tracking()}, lower(e.k)))"
    joined = f"array_join(transform({clean}, e -> concat({_enc('e.k')}, '=', {_enc('e.v')})), '&')"
    return f"element_at(transform(array({decoded}), dec -> {joined}), 1)"


# A URL with one query field that no step of the cleaning changes: no escape, no
# character that is encoded, no tracking parameter, a lower-case scheme.
_KEPT_FIELD = (r"^https?://[^?#]*\?(?!(?i:" + "|".join(re.escape(t) for t in P.TRACKING_PARAMS)
               + r")=)[A-Za-z0-9_.~-]+=[A-Za-z0-9_.~-]+\z")


def clean_url_sql(u: str) -> str:
    sch = r(P.SCHEME)
    lowered = f"concat(lower(regexp_extract({u}, {sch}, 0)), regexp_replace({u}, {sch}, ''))"
    simple = (f"CASE WHEN instr({lowered}, '#') = length({u}) THEN substr({lowered}, 1, length({u}) - 1)"
              f" ELSE {lowered} END")
    parts = (f"named_struct('prefix', regexp_extract({u}, {r(_SPLIT)}, 1),"
             f" 'q', {clean_query_sql(f'regexp_extract({u}, {r(_SPLIT)}, 3)')},"
             f" 'frag', regexp_extract({u}, {r(_SPLIT)}, 5))")
    fixed = (f"CASE WHEN p.prefix RLIKE {sch} THEN concat(lower(regexp_extract(p.prefix, {sch}, 0)),"
             f" regexp_replace(p.prefix, {sch}, '')) ELSE p.prefix END")
    out = (f"regexp_replace(concat({fixed}, CASE WHEN p.q <> '' THEN concat('?', p.q) ELSE '' END,"
           f" CASE WHEN p.frag <> '' THEN concat('#', p.frag) ELSE '' END), {r(chr(92) + '?+' + chr(92) + 'z')}, '')")
    # most URLs: a lower-case scheme and no query, so nothing is to be lowered
    plain = f"instr({u}, '?') = 0 AND (startswith({u}, 'https://') OR startswith({u}, 'http://'))"
    cut = f"CASE WHEN instr({u}, '#') = length({u}) THEN substr({u}, 1, length({u}) - 1) ELSE {u} END"
    return (f"CASE WHEN {u} IS NULL THEN NULL WHEN {plain} THEN {cut} WHEN instr({u}, '?') = 0 THEN {simple}"
            f" WHEN {u} RLIKE {r(_KEPT_FIELD)} THEN {u}"
            f" ELSE element_at(transform(array({parts}), p -> {out}), 1) END")


def url_domain_sql(u: str) -> str:
    n = f"CASE WHEN cu RLIKE {r(_NETLOC)} THEN regexp_extract(cu, {r(_NETLOC)}, 1) ELSE '' END"
    return (f"element_at(transform(array({clean_url_sql(u)}), cu -> element_at(transform(array({n}),"
            f" n -> CASE WHEN n = '' THEN cu ELSE n END), 1)), 1)")


def _dot_resolve_sql(segments: str) -> str:
    agg = ("aggregate(seg, cast(array() AS array<string>), (acc, s) -> CASE WHEN s = '..'"
           " THEN slice(acc, 1, greatest(size(acc) - 1, 0)) WHEN s = '.' THEN acc ELSE array_append(acc, s) END)")
    fixed = (f"element_at(transform(array({agg}), res -> CASE WHEN element_at(seg, -1) IN ('.', '..')"
             f" THEN array_append(res, '') ELSE res END), 1)")
    path = f"element_at(transform(array(array_join({fixed}, '/')), pth -> CASE WHEN pth = '' THEN '/' ELSE pth END), 1)"
    return f"element_at(transform(array({segments}), seg -> {path}), 1)"


def resolve_link_sql(base: str, href: str) -> str:
    sch, so, site = r(P.SCHEME), r(_SCHEME_OF), r(_SITE)
    rpath = "regexp_extract(x.h, '^([^?#]*)', 1)"
    pieces = (
        "named_struct('b', x.b, 'h', x.h,"
        f" 'b_scheme', lower(regexp_extract(x.b, {so}, 1)),"
        f" 'h_has_scheme', x.h RLIKE {sch},"
        f" 'h_scheme', lower(regexp_extract(x.h, {so}, 1)),"
        f" 'h_rest', regexp_replace(x.h, {sch}, ''),"
        f" 'b_site', regexp_extract(x.b, {site}, 0),"
        f" 'b_path', regexp_extract(substr(x.b, length(regexp_extract(x.b, {site}, 0)) + 1), '^([^?#]*)', 1),"
        f" 'b_query', regexp_extract(substr(x.b, length(regexp_extract(x.b, {site}, 0)) + 1),"
        f" {r('^[^?#]*(' + chr(92) + '?[^#]*)?')}, 1),"
        f" 'r_path', {rpath},"
        f" 'r_query', regexp_extract(substr(x.h, length({rpath}) + 1), {r('^(' + chr(92) + '?[^#]*)?')}, 1),"
        f" 'r_frag', regexp_extract(substr(x.h, length({rpath}) + 1), {r('(#.*)?' + chr(92) + 'z')}, 1))")
    base_dir = ("element_at(transform(array(split(p.b_path, '/')), parts -> CASE WHEN element_at(parts, -1) <> ''"
                " THEN slice(parts, 1, greatest(size(parts) - 1, 1)) ELSE parts END), 1)")
    bd = f"CASE WHEN p.b_path = '' THEN array('') ELSE {base_dir} END"
    merged = (f"element_at(transform(array(concat({bd}, split(p.r_path, '/'))), m ->"
              f" filter(m, (s, i) -> i = 0 OR i = size(m) - 1 OR s <> '')), 1)")
    segments = f"CASE WHEN startswith(p.r_path, '/') THEN split(p.r_path, '/') ELSE {merged} END"
    site_fixed = (f"CASE WHEN p.b_scheme = '' THEN p.b_site ELSE concat(p.b_scheme, ':',"
                  f" regexp_replace(p.b_site, {sch}, '')) END")
    same_doc = (f"concat({site_fixed}, p.b_path, CASE WHEN p.r_query <> '' THEN p.r_query ELSE p.b_query END,"
                f" p.r_frag)")
    rel = f"concat({site_fixed}, {_dot_resolve_sql(segments)}, p.r_query, p.r_frag)"
    rel_ok = "array(" + ", ".join(f"'{s}'" for s in P.USES_RELATIVE) + ")"
    body = (f"CASE WHEN p.h = '' THEN p.b"
            f" WHEN p.h_has_scheme AND (p.h_scheme <> p.b_scheme OR NOT array_contains({rel_ok}, p.h_scheme)) THEN p.h"
            f" WHEN p.h_has_scheme AND startswith(p.h_rest, '//') THEN concat(p.h_scheme, ':', p.h_rest)"
            f" WHEN p.h_has_scheme THEN p.h"
            f" WHEN startswith(p.h, '//') THEN concat(p.b_scheme, ':', p.h)"
            f" WHEN p.r_path = '' THEN {same_doc}"
            f" ELSE {rel} END")
    return (f"element_at(transform(array(named_struct('b', {base}, 'h', {href})), x ->"
            f" element_at(transform(array({pieces}), p -> {body}), 1)), 1)")


FUNCTIONS = {
    "webreach_clean_url": ("u STRING", "STRING", lambda: clean_url_sql("u")),
    "webreach_url_domain": ("u STRING", "STRING", lambda: url_domain_sql("u")),
    "webreach_resolve_link": ("b STRING, h STRING", "STRING", lambda: resolve_link_sql("b", "h")),
}

# Set in a session that has the functions: it lives and dies with the session.
_MARK = "webreach.functions"


def ensure(spark: SparkSession | None = None) -> None:
    """Define the functions in ``spark`` (the active session by default) once."""
    spark = spark or SparkSession.getActiveSession() or SparkSession._instantiatedSession
    if spark is None:
        raise RuntimeError("no active SparkSession")
    if spark.conf.get(_MARK, None) is not None:
        return
    for name, (params, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body()}")
    spark.conf.set(_MARK, "1")
