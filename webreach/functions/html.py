"""HTML -> text column functions (O-C1..O-C3), without a parser.

A page is cut at its tags, after the blocks whose text is not page text
(script, style, template, comments) have given way to an empty tag: n tags and
n + 1 text nodes, as two arrays. Nothing is marked inside the text, so any
character may stand there. A tag begins with '<' and a letter, '/', '!' or '?'
(any other '<' is text) and holds quoted attribute values, '>' included.
Known gaps against a real HTML parser, all rare in crawled pages: CDATA
sections, named references outside ``patterns.HTML_ENTITIES``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webreach.functions import patterns as P
from webreach.functions.urls import col, let, nstruct, py_strip

# What may follow a tag's name. Quotes bind behind a '=' only. All repeats are
# possessive: a character is read once, and no tag is too long for the stack.
# A tag that is never closed ends with the page.
ATTRS = r"[^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|)[^>=]*+)*+"
TAG_END = r"(?:>|\z)"
TAG = r"<[A-Za-z/!?]" + ATTRS + TAG_END
# Blocks whose content is not text. Replaced by an empty tag so the text on
# either side stays two separate nodes.
# A block that is never closed ends with the page, so each page is read once.
INVISIBLE = ("(?is)" + "|".join(rf"<{name}\b{ATTRS}{TAG_END}.*?(?:</{name}\s*+>|\z)" for name in ("script", "style", "template"))
             + r"|<!--.*?(?:-->|\z)")
# The same blocks with their '<' in front (Spark only): any other character is tried once, not once a kind of block.
INVISIBLE_BLOCK = "(?is)<(?:" + "|".join([*(rf"{name}\b{ATTRS}{TAG_END}.*?(?:</{name}\s*+>|\z)" for name in ("script", "style", "template")),
                                        r"!--.*?(?:-->|\z)"]) + ")"
EMPTY_TAG = "</>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"


def _text(s: str) -> str:
    """Spark SQL string literal of any text."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


# A look-up reads the map from its front: the references that most pages hold stand there.
_COMMON = ("amp", "nbsp", "lt", "gt", "quot", "copy", "middot", "raquo", "laquo", "rsquo", "lsquo", "ldquo", "rdquo", "ndash", "mdash", "hellip",
           "bull", "reg", "trade", "apos")
_ORDERED = sorted(P.HTML_ENTITIES, key=lambda k: _COMMON.index(k) if k in _COMMON else len(_COMMON))
_NAMES = "map(" + ", ".join(f"{_text(k)}, {_text(P.HTML_ENTITIES[k])}" for k in _ORDERED) + ")"
_CP1252 = "array(" + ", ".join(map(_text, P.CP1252)) + ")"


def _character(code: Column) -> Column:
    """The text of a numeric reference to ``code``, as HTML parsers read it."""
    nothing = (code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF)
               | (code.bitwiseAND(0xFFFE) == 0xFFFE))
    return (F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit(P.REPLACEMENT))
            .when(code == 13, F.lit("\r"))
            .when(code.between(0x80, 0x9F), F.get(F.expr(_CP1252), (code - 0x80).cast("int")))
            .when(nothing, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def _reference(p: Column) -> Column:
    """A piece of text that followed an '&': the reference that it begins with
    is read; a number has any length, and its ';' may be missing."""
    bare = lambda x: F.concat(F.lit("0"), F.regexp_replace(x, "^0+", ""))
    plain = F.concat(F.lit("&"), p)

    def number(x):
        code = (F.when(x["d"] != "", let(bare(x["d"]), lambda d: F.when(F.length(d) <= 8, d.cast("bigint"))))
                .otherwise(let(bare(x["h"]), lambda h: F.when(F.length(h) <= 7, F.conv(h, 16, 10).cast("bigint")))))
        return F.when((x["d"] != "") | (x["h"] != ""), F.concat(
            let(code, _character), F.regexp_replace(p, r"^#([xX][0-9a-fA-F]+|[0-9]+);?", ""))).otherwise(plain)

    numbers = nstruct(d=F.regexp_extract(p, r"^#([0-9]+)", 1), h=F.regexp_extract(p, r"^#[xX]([0-9a-fA-F]+)", 1))
    name = F.element_at(F.expr(_NAMES), F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*);", 1))
    return F.when(F.startswith(p, F.lit("#")), let(numbers, number)).otherwise(
        let(name, lambda n: F.when(n.isNotNull(), F.concat(n, F.substr(p, F.instr(p, ";") + 1))).otherwise(plain)))


def _references(s: Column) -> Column:
    return let(F.split(s, "&"), lambda parts: F.concat(F.element_at(parts, 1), F.array_join(
        F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), _reference), "")))


def decode_entities(c, bind: bool = True) -> Column:
    """Named and numeric character references, each read once from left to right.

    ``bind=False`` when ``c`` is a plain column or lambda variable (then the
    guard stays code-generated; it is referenced more than once).
    """
    guarded = lambda v: F.when(v.contains("&"), _references(v)).otherwise(v)
    return let(c, guarded) if bind else guarded(col(c))


def visible_html(c) -> Column:
    """HTML with line breaks normalised and non-text blocks removed."""
    html = col(c)
    lines = F.when(html.contains("\r"), F.replace(F.replace(html, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))).otherwise(html)
    return F.regexp_replace(lines, INVISIBLE_BLOCK, EMPTY_TAG)


def raw_nodes(vis: Column) -> Column:
    """array<string>: the visible page between its tags, undecoded."""
    return F.split(vis, TAG)


def tags(vis: Column) -> Column:
    """array<string>: the tags; tag i stands between nodes i and i + 1."""
    return F.regexp_extract_all(vis, F.lit(TAG), F.lit(0))


def decoded(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: decode_entities(n, bind=False))


def nodes_of(vis: Column) -> Column:
    """array<string>: the decoded text nodes of a visible page; one without '&' has nothing to decode."""
    return F.when(vis.contains("&"), decoded(raw_nodes(vis))).otherwise(raw_nodes(vis))


def text_nodes(c) -> Column:
    """array<string>: decoded text nodes in document order (unstripped)."""
    return decoded(raw_nodes(visible_html(c)))


def text_of(nodes: Column) -> Column:
    """Separator form: every node stripped, empty nodes dropped, the rest joined by one space."""
    return F.array_join(F.filter(F.transform(F.filter(nodes, lambda n: n != ""), py_strip), lambda n: n != ""), " ")


def page_text(c) -> Column:
    """O-C1: text nodes stripped, blanks dropped, joined by one space."""
    return text_of(text_nodes(c))


def page_text_nosep(c) -> Column:
    """O-C2: text nodes concatenated as they are."""
    return F.array_join(text_nodes(c), "")


def page_title(c) -> Column:
    """O-C3: stripped title text, 'Unknown' when absent or empty."""
    t = py_strip(decode_entities(F.regexp_extract(col(c), TITLE, 1)))
    return let(t, lambda v: F.when(v != "", v).otherwise(F.lit(P.UNKNOWN_COMPANY)))
