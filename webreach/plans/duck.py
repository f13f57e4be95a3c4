"""DuckDB SQL twins of the column functions, used only by the oracle queries.

Each builder takes SQL expression text and returns SQL expression text; the
regular-expression text is shared with the Spark side (``patterns``), so both
engines run the same patterns. Lambdas use DuckDB's ``lambda x: ..`` form.
"""

from __future__ import annotations

from webreach.functions import patterns as P
from webreach.functions import html as H
from webreach.operators import pages as PG
from webreach.operators import external as E


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def strip(e: str) -> str:
    return f"regexp_replace({e}, {lit('^[' + P.WS + ']+|[' + P.WS + ']+\\z')}, '', 'g')"


def rlike(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {lit(pattern)})"


def normalize_url(e: str) -> str:
    s = strip(e)
    return f"(CASE WHEN {s} = '' THEN '' WHEN {rlike(s, P.SCHEME)} THEN {s} ELSE 'https://' || {s} END)"


def is_valid_url(e: str) -> str:
    return f"coalesce({rlike(e, P.VALID_URL)}, false)"


_SPLIT = r"(?s)^([^?#]*)(\?([^#]*))?(#(.*))?\z"


def _qs_decode(e: str) -> str:
    return f"url_decode(replace({e}, '+', ' '))"


def _qs_encode(e: str) -> str:
    return f"replace(url_encode({e}), '%20', '+')"


def clean_query(q: str) -> str:
    fields = f"list_transform(string_split({q}, '&'), lambda f, i: {{'i': i, 'f': f}})"
    kept = (f"list_filter({fields}, lambda p: instr(p.f, '=') > 0 AND length(p.f) > instr(p.f, '='))")
    decoded = (f"list_transform({kept}, lambda p: {{'i': p.i, 'k': {_qs_decode('split_part(p.f, ' + lit('=') + ', 1)')},"
               f" 'v': {_qs_decode('substr(p.f, instr(p.f, ' + lit('=') + ') + 1)')}}})")
    names = f"list_transform(d, lambda e: e.k)"
    grouped = (f"list_sort(list_transform(d, lambda e: {{'g': list_position({names}, e.k), 'i': e.i, 'k': e.k, 'v': e.v}}))")
    clean = f"list_filter({grouped}, lambda e: NOT list_contains({str_list(P.TRACKING_PARAMS)}, lower(e.k)))"
    joined = f"array_to_string(list_transform({clean}, lambda e: {_qs_encode('e.k')} || '=' || {_qs_encode('e.v')}), '&')"
    # bind the decoded list once
    return f"(list_transform([{decoded}], lambda d: {joined}))[1]"


def clean_url(u: str) -> str:
    prefix = f"regexp_extract({u}, {lit(_SPLIT)}, 1)"
    query = f"regexp_extract({u}, {lit(_SPLIT)}, 3)"
    frag = f"regexp_extract({u}, {lit(_SPLIT)}, 5)"
    fixed = (f"(CASE WHEN {rlike('x.p', P.SCHEME)} THEN lower(regexp_extract(x.p, {lit(P.SCHEME)}, 0))"
             f" || regexp_replace(x.p, {lit(P.SCHEME)}, '') ELSE x.p END)")
    out = (f"regexp_replace({fixed} || CASE WHEN x.q <> '' THEN '?' || x.q ELSE '' END"
           f" || CASE WHEN x.f <> '' THEN '#' || x.f ELSE '' END, '\\?+\\z', '')")
    bound = f"(list_transform([{{'p': {prefix}, 'q': {clean_query(query)}, 'f': {frag}}}], lambda x: {out}))[1]"
    return f"(CASE WHEN {u} IS NULL THEN NULL ELSE {bound} END)"


def strip_key(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '(?s)#.*', ''), '/+\\z', '')"


def page_key(u: str) -> str:
    return strip_key(clean_url(u))


_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def netloc(e: str) -> str:
    return f"(CASE WHEN {rlike(e, _NETLOC)} THEN regexp_extract({e}, {lit(_NETLOC)}, 1) ELSE '' END)"


def url_domain(u: str) -> str:
    return f"(list_transform([{clean_url(u)}], lambda cu: CASE WHEN {netloc('cu')} = '' THEN cu ELSE {netloc('cu')} END))[1]"


def display_url(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '^https?://', ''), '/\\z', '')"


def _dot_resolve(segments: str) -> str:
    agg = ("list_reduce(seg, lambda acc, s: CASE WHEN s = '..' THEN acc[1:greatest(len(acc) - 1, 0)]"
           " WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    fixed = f"CASE WHEN seg[-1] IN ('.', '..') THEN list_append({agg}, '') ELSE {agg} END"
    return (f"(list_transform([{segments}], lambda seg: CASE WHEN array_to_string({fixed}, '/') = '' THEN '/'"
            f" ELSE array_to_string({fixed}, '/') END))[1]")


def resolve_link(base: str, href: str) -> str:
    scheme_of = r"^([A-Za-z][A-Za-z0-9+.-]*):"
    site_re = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?"
    b, h = "x.b", "x.h"
    pieces = (
        f"{{'b': {b}, 'h': {h},"
        f" 'b_scheme': lower(regexp_extract({b}, {lit(scheme_of)}, 1)),"
        f" 'h_has_scheme': {rlike(h, P.SCHEME)},"
        f" 'h_scheme': lower(regexp_extract({h}, {lit(scheme_of)}, 1)),"
        f" 'h_rest': regexp_replace({h}, {lit(P.SCHEME)}, ''),"
        f" 'b_site': regexp_extract({b}, {lit(site_re)}, 0),"
        f" 'b_path': regexp_extract(substr({b}, length(regexp_extract({b}, {lit(site_re)}, 0)) + 1), '^([^?#]*)', 1),"
        f" 'b_query': regexp_extract(substr({b}, length(regexp_extract({b}, {lit(site_re)}, 0)) + 1), '^[^?#]*(\\?[^#]*)?', 1),"
        f" 'r_path': regexp_extract({h}, '^([^?#]*)', 1),"
        f" 'r_query': regexp_extract(substr({h}, length(regexp_extract({h}, '^([^?#]*)', 1)) + 1), '^(\\?[^#]*)?', 1),"
        f" 'r_frag': regexp_extract(substr({h}, length(regexp_extract({h}, '^([^?#]*)', 1)) + 1), '(#.*)?\\z', 1)}}")
    base_dir = ("(list_transform([string_split(p.b_path, '/')], lambda parts: CASE WHEN parts[-1] <> ''"
                " THEN parts[1:greatest(len(parts) - 1, 1)] ELSE parts END))[1]")
    bd = f"(CASE WHEN p.b_path = '' THEN [''] ELSE {base_dir} END)"
    merged = (f"(list_transform([list_concat({bd}, string_split(p.r_path, '/'))], lambda m:"
              f" list_filter(m, lambda s, i: i = 1 OR i = len(m) OR s <> '')))[1]")
    segments = f"(CASE WHEN starts_with(p.r_path, '/') THEN string_split(p.r_path, '/') ELSE {merged} END)"
    site = (f"(CASE WHEN p.b_scheme = '' THEN p.b_site ELSE p.b_scheme || ':' ||"
            f" regexp_replace(p.b_site, {lit(P.SCHEME)}, '') END)")
    same_doc = f"{site} || p.b_path || (CASE WHEN p.r_query <> '' THEN p.r_query ELSE p.b_query END) || p.r_frag"
    rel = f"{site} || {_dot_resolve(segments)} || p.r_query || p.r_frag"
    rel_ok = str_list(P.USES_RELATIVE)
    body = (f"CASE WHEN p.h = '' THEN p.b"
            f" WHEN p.h_has_scheme AND (p.h_scheme <> p.b_scheme OR NOT list_contains({rel_ok}, p.h_scheme)) THEN p.h"
            f" WHEN p.h_has_scheme AND starts_with(p.h_rest, '//') THEN p.h_scheme || ':' || p.h_rest"
            f" WHEN p.h_has_scheme THEN p.h"
            f" WHEN starts_with(p.h, '//') THEN p.b_scheme || ':' || p.h"
            f" WHEN p.r_path = '' THEN {same_doc}"
            f" ELSE {rel} END")
    return (f"(list_transform([{{'b': {base}, 'h': {href}}}], lambda x: (list_transform([{pieces}],"
            f" lambda p: {body}))[1]))[1]")


# ---------------------------------------------------------------- HTML text

def _character(code: str) -> str:
    cp1252 = str_list(P.CP1252)
    nothing = (f"{code} BETWEEN 1 AND 8 OR {code} = 11 OR {code} BETWEEN 14 AND 31 OR {code} = 127"
               f" OR {code} BETWEEN 64976 AND 65007 OR ({code} & 65534) = 65534")
    bad = f"{code} IS NULL OR {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343"
    return (f"CASE WHEN {bad} THEN '{P.REPLACEMENT}' WHEN {code} = 13 THEN chr(13)"
            f" WHEN {code} BETWEEN 128 AND 159 THEN ({cp1252})[{code} - 127]"
            f" WHEN {nothing} THEN '' ELSE chr(CAST(CASE WHEN {bad} THEN 65 ELSE {code} END AS INTEGER)) END")


def decode_entities(e: str) -> str:
    name = f"list_position({str_list(P.HTML_ENTITIES)}, regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1))"
    bare = lambda pat: f"regexp_replace(regexp_extract(x.p, '{pat}', 1), '^0+', '')"
    d, h = bare("^#([0-9]+)"), bare("^#[xX]([0-9a-fA-F]+)")
    code = (f"CASE WHEN regexp_matches(x.p, '^#[0-9]') THEN CASE WHEN length({d}) <= 7 THEN CAST('0' || {d} AS BIGINT) END"
            f" WHEN length({h}) <= 6 THEN CAST('0x0' || {h} AS BIGINT) END")
    numeric = f"(list_transform([{code}], lambda code: {_character('code')}))[1]"
    out = (f"CASE WHEN x.n > 0 THEN ({str_list(P.HTML_ENTITIES.values())})[x.n] || substr(x.p, instr(x.p, ';') + 1)"
           f" WHEN regexp_matches(x.p, '^#([xX][0-9a-fA-F]|[0-9])') THEN {numeric} || regexp_replace(x.p, '^#([xX][0-9a-fA-F]+|[0-9]+);?', '')"
           f" ELSE '&' || x.p END")
    one = f"(list_transform([{{'p': p, 'n': {name}}}], lambda x: {out}))[1]"
    return (f"(list_transform([{e}], lambda s: CASE WHEN instr(s, '&') > 0 THEN (string_split(s, '&'))[1] ||"
            f" array_to_string(list_transform((string_split(s, '&'))[2:], lambda p: {one}), '') ELSE s END))[1]")


def re2(pattern: str) -> str:
    """The pattern without possessive marks, which RE2 lacks (it never goes back anyway)."""
    return pattern.replace("*+", "*").replace("++", "+").replace("?+", "?")


def visible_html(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '\\r\\n?', '\n', 'g'), {lit(re2(H.INVISIBLE))}, '{H.EMPTY_TAG}', 'g')"


def nodes_of(vis: str) -> str:
    return f"list_transform(string_split_regex({vis}, {lit(re2(H.TAG))}), lambda n: {decode_entities('n')})"


def text_of(nodes: str) -> str:
    return f"array_to_string(list_filter(list_transform({nodes}, lambda t: {strip('t')}), lambda t: t <> ''), ' ')"


def page_text(e: str) -> str:
    return text_of(nodes_of(visible_html(e)))


def page_text_nosep(e: str) -> str:
    return f"array_to_string({nodes_of(visible_html(e))}, '')"


def page_title(e: str) -> str:
    t = strip(decode_entities(f"regexp_extract({e}, {lit(H.TITLE)}, 1)"))
    return f"(list_transform([{t}], lambda v: CASE WHEN v <> '' THEN v ELSE {lit(P.UNKNOWN_COMPANY)} END))[1]"


# ---------------------------------------------------------------- extractors

def find_all(e: str, pattern: str) -> str:
    return f"regexp_extract_all({e}, {lit(pattern)}, 0)"


def emails(e: str) -> str:
    return f"list_distinct({find_all(e, P.EMAIL)})"


def digits_only(e: str) -> str:
    return f"regexp_replace({e}, '\\P{{Nd}}', '', 'g')"


def has_min_digits(e: str, n: int = P.MIN_PHONE_DIGITS) -> str:
    return f"(length({digits_only(e)}) >= {n})"


def phones(e: str) -> str:
    a, b, c = (find_all(e, p) for p in P.PHONE_PATTERNS)
    return f"list_filter(list_distinct(list_concat({a}, {b}, {c})), lambda v: {has_min_digits('v')})"


def strip_distinct(arr: str) -> str:
    return f"list_distinct(list_filter(list_transform({arr}, lambda s: {strip('s')}), lambda s: s <> ''))"


def cf_decode(e: str) -> str:
    pairs = ("list_transform(range(1, greatest(CAST(floor((length(h) - 1) / 2) AS BIGINT), 1) + 1), lambda i:"
             " chr(xor(CAST(('0x' || substr(h, CAST(i * 2 + 1 AS BIGINT), 2)) AS INTEGER),"
             " CAST(('0x' || substr(h, 1, 2)) AS INTEGER))))")
    return (f"(list_transform([{e}], lambda h: CASE WHEN length(h) >= 3 AND regexp_matches(h, '^[0-9a-fA-F]+\\z')"
            f" THEN array_to_string({pairs}, '') ELSE '' END))[1]")


def mailto_address(e: str) -> str:
    return strip(f"split_part(substr({e}, 8), '?', 1)")


def normalize_phone(e: str) -> str:
    d = digits_only(e)
    return (f"(list_transform([{{'p': {e}, 'd': {d}}}], lambda np_: CASE"
            f" WHEN length(np_.d) = 10 AND starts_with(np_.d, '7') THEN '+94 ' || substr(np_.d, 1, 2) || ' ' || substr(np_.d, 3, 3) || ' ' || substr(np_.d, 6, 5)"
            f" WHEN length(np_.d) = 11 AND starts_with(np_.d, '947') THEN '+94 ' || substr(np_.d, 4, 2) || ' ' || substr(np_.d, 6, 3) || ' ' || substr(np_.d, 9, 3)"
            f" ELSE np_.p END))[1]")


# ---------------------------------------------------------------- tags

def attr(attrs: str, name: str) -> str:
    first = f"(list_filter({attrs}, lambda s: {rlike('s', PG.attribute_re(name))}))[1]"
    raw = f"regexp_extract(f, {lit(PG.ATTRIBUTE_VALUE)}, 1)"
    value = f"CASE WHEN regexp_matches(r, '^[\"'']') THEN substr(r, 2, length(r) - 2) ELSE r END"
    return (f"(list_transform([{first}], lambda f: CASE WHEN f IS NOT NULL THEN"
            f" (list_transform([{raw}], lambda r: {decode_entities(value)}))[1] END))[1]")


def attributes(tag: str) -> str:
    return find_all(tag, re2(PG.ATTRIBUTE))


def anchor_tags(html: str) -> str:
    """list of {pos, href, cf, text} of every <a> (pos 0-based, as in Spark)."""
    tags = f"regexp_extract_all(v, {lit(re2(H.TAG))})"
    at = f"list_filter(list_transform(x.tags, lambda t, i: {{'i': i, 't': t}}), lambda z: {rlike('z.t', PG.A_TAG)})"
    spans = "list_transform(y, lambda z, k: {'i': z.i, 't': z.t, 'e': coalesce(y[k + 1].i, len(x.tags) + 1)})"
    opened = f"list_filter((list_transform([{at}], lambda y: {spans}))[1], lambda z: {rlike('z.t', PG.A_OPEN)})"
    href = strip("a.href")
    usable = f"a.href IS NOT NULL AND {href} <> '' AND NOT starts_with({href}, 'mailto:') AND NOT starts_with({href}, '#')"
    text = text_of("x.nodes[z.i + 1 : z.e]")
    row = (f"(list_transform([(list_transform([{attributes('substr(z.t, 3)')}], lambda l: {{'href': {attr('l', 'href')}, 'cf': {attr('l', 'data-cfemail')}}}))[1]],"
           f" lambda a: {{'pos': p - 1, 'href': a.href, 'cf': a.cf, 'text': CASE WHEN {usable} THEN {text} END}}))[1]")
    return (f"(list_transform([{visible_html(html)}], lambda v: (list_transform([{{'nodes': {nodes_of('v')}, 'tags': {tags}}}],"
            f" lambda x: list_transform({opened}, lambda z, p: {row})))[1]))[1]")


def links(anchors_: str) -> str:
    return (f"list_transform(list_filter({anchors_}, lambda a: a.text IS NOT NULL),"
            f" lambda a: {{'pos': a.pos, 'href': {strip('a.href')}, 'text': a.text}})")


def anchors(html: str) -> str:
    return links(anchor_tags(html))


def cf_emails(anchors_: str) -> str:
    dec = f"list_transform(list_filter({anchors_}, lambda a: a.cf IS NOT NULL), lambda a: {cf_decode('a.cf')})"
    return f"list_distinct(list_filter({dec}, lambda d: instr(d, '@') > 0))"


def mailto_emails(anchors_: str) -> str:
    addr = f"list_transform(list_filter({anchors_}, lambda a: a.href IS NOT NULL AND starts_with(a.href, 'mailto:')), lambda a: {mailto_address('a.href')})"
    return f"list_distinct(list_filter({addr}, lambda a: a <> '' AND instr(a, '@') > 0))"


def facebook_href(anchors_: str) -> str:
    return f"(list_filter({anchors_}, lambda a: a.href IS NOT NULL AND {rlike('a.href', P.FACEBOOK)}))[1].href"


def jsonld_blocks(html: str) -> str:
    blocks = f"list_filter(regexp_extract_all({html}, {lit(re2(PG.SCRIPT))}), lambda s: {rlike('s', '(?i)^<script')})"
    part = lambda n: f"regexp_extract(s, {lit(re2(PG.SCRIPT_PARTS))}, {n})"
    return (f"list_transform(list_filter(list_transform({blocks}, lambda s: {{'k': {attr(attributes(part(1)), 'type')}, 'b': {part(2)}}}),"
            f" lambda s: s.k = 'application/ld+json'), lambda s: s.b)")


def reply_span(e: str) -> str:
    return f"regexp_extract({e}, {lit(E.OBJECT_SPAN)}, 0)"
