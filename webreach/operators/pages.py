"""Page -> relations (O-C1..O-C8, O-D1..O-D6, O-D11).

``page_facts`` reads the wide ``html`` column exactly once and turns every
page into one narrow row: title, the first 5000 text chars, candidate values
per channel, contact-link candidates, the first Facebook link and the JSON-LD
blocks. Everything downstream joins these narrow rows, never ``html``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webreach.functions import extract as X
from webreach.functions import html as H
from webreach.functions import patterns as P
from webreach.functions import urls as U
from webreach.session import materialize

# Open and close tags of anchors; how they begin, for a look at the bytes before the pattern.
A_TAG, A_OPEN = r"(?i)\A</?a[\s/>]", r"(?i)\A<a"
A_STARTS = ("<a", "</a", "<A", "</A")
HAS_ANCHOR = r"<[Aa][\s/>]"
# A tag's attributes, one after the other, so nothing inside a quoted value is taken for one.
ATTRIBUTE = r"[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+))?+"
ATTRIBUTE_VALUE = r"(?s)\A[^=]*=\s*(.*)\z"
# Comments and scripts in the order in which they begin: a comment inside a
# script is its text, a script inside a comment is none.
SCRIPT = rf"(?is)<!--.*?(?:-->|\z)|<script\b{H.ATTRS}{H.TAG_END}.*?(?:</script\s*+>|\z)"
SCRIPT_PARTS = rf"(?is)\A<script\b({H.ATTRS}){H.TAG_END}(.*?)(?:</script\s*+>|\z)"


def attribute_re(name: str) -> str:
    return rf"(?i)\A{name}\s*="


def attributes(tag: Column) -> Column:
    """array<string>: a tag's attributes as written (without the tag's name in front)."""
    return F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))


def attr(attrs: Column, name: str) -> Column:
    """Value of the first attribute ``name``, entities decoded; null if there is none."""
    def value(s):
        raw = F.regexp_extract(s, ATTRIBUTE_VALUE, 1)
        quoted = F.startswith(raw, F.lit('"')) | F.startswith(raw, F.lit("'"))
        return U.let(F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw), lambda v: H.decode_entities(v, bind=False))

    first = F.get(F.filter(attrs, lambda s: s.rlike(attribute_re(name))), F.lit(0))
    return U.let(first, lambda s: F.when(s.isNotNull(), value(s)))


def _channel(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: U.nstruct(channel=F.lit(name), value=v))


def anchor_tags(nodes: Column, tags: Column) -> Column:
    """array<struct<pos, href, cf, text>>: every <a> with its decoded href and
    data-cfemail (null if absent) and its text, which ends with the next anchor
    tag; that of an anchor without a usable href is null."""
    starts = lambda t: reduce(or_, [F.startswith(t, F.lit(s)) for s in A_STARTS])
    at = F.filter(F.transform(tags, lambda t, i: U.nstruct(i=i, t=t)), lambda z: starts(z["t"]) & z["t"].rlike(A_TAG))

    def opened(z):
        spans = F.transform(z, lambda x, k: U.nstruct(
            i=x["i"], t=x["t"], end=F.coalesce(F.get(z, k + 1)["i"], F.size(tags))))
        return F.filter(spans, lambda x: x["t"].rlike(A_OPEN))

    def row(x, pos):
        attrs = U.let(attributes(F.substr(x["t"], F.lit(3))), lambda a: U.nstruct(href=attr(a, "href"), cf=attr(a, "data-cfemail")))
        text = H.text_of(F.slice(nodes, x["i"] + 2, x["end"] - x["i"]))
        return U.let(attrs, lambda a: U.nstruct(
            pos=pos, href=a["href"], cf=a["cf"], text=F.when(_usable(a["href"]), text)))

    return F.transform(U.let(at, opened), row)


def _usable(href: Column) -> Column:
    return U.let(U.py_strip(href), lambda h: h.isNotNull() & (h != "") & ~F.startswith(h, F.lit("mailto:")) & ~F.startswith(h, F.lit("#")))


def links(anchors_: Column) -> Column:
    """O-C4: array<struct<pos, href, text>> of usable <a href> anchors.

    href stripped; empty, 'mailto:' and '#...' hrefs skipped; anchor text in
    separator form. ``pos`` is the document position among all anchors.
    """
    return F.transform(F.filter(anchors_, lambda a: a["text"].isNotNull()), lambda a: U.nstruct(
        pos=a["pos"], href=U.py_strip(a["href"]), text=a["text"]))


def anchors(html: Column) -> Column:
    """O-C4 of a page; see ``links``."""
    cut = U.let(H.visible_html(html), lambda vis: U.nstruct(nodes=H.decoded(H.raw_nodes(vis)), tags=H.tags(vis)))
    return U.let(cut, lambda z: links(anchor_tags(z["nodes"], z["tags"])))


def cf_emails(anchors_: Column) -> Column:
    """O-C6 + O-D4 + O-D5: decoded data-cfemail values on <a> tags containing '@'."""
    decoded = F.transform(F.filter(anchors_, lambda a: a["cf"].isNotNull()), lambda a: X.cf_decode(a["cf"]))
    return F.array_distinct(F.filter(decoded, lambda d: F.instr(d, "@") > 0))


def mailto_emails(anchors_: Column) -> Column:
    """O-C7 + O-D6: mailto: hrefs (case-sensitive prefix) with an '@'."""
    mail = F.filter(anchors_, lambda a: F.coalesce(F.startswith(a["href"], F.lit("mailto:")), F.lit(False)))
    addr = F.transform(mail, lambda a: X.mailto_address(a["href"]))
    return F.array_distinct(F.filter(addr, lambda a: (a != "") & (F.instr(a, "@") > 0)))


def facebook_href(anchors_: Column) -> Column:
    """O-C8 + O-H1: first <a> href (unresolved, unstripped) matching facebook.com."""
    return F.get(F.filter(anchors_, lambda a: F.coalesce(a["href"].rlike(P.FACEBOOK), F.lit(False))), F.lit(0))["href"]


def jsonld_blocks(html: Column) -> Column:
    """O-C5: raw bodies of <script type="application/ld+json"> blocks."""
    blocks = F.filter(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(0)), lambda s: s.rlike(r"(?i)\A<script"))
    parts = F.transform(blocks, lambda s: U.nstruct(
        kind=attr(attributes(F.regexp_extract(s, SCRIPT_PARTS, 1)), "type"), body=F.regexp_extract(s, SCRIPT_PARTS, 2)))
    return F.transform(F.filter(parts, lambda s: s["kind"] == "application/ld+json"), lambda s: s["body"])


def fetchable(pages: DataFrame) -> DataFrame:
    """O-A4: a page counts as fetched when its optional ``status`` is null
    or 200..399. It is looked up by the ``url`` asked for; the optional
    ``final_url`` (after redirects) is the URL that it names itself by."""
    if "status" in pages.columns:
        pages = pages.filter(F.col("status").isNull() | F.col("status").between(200, 399))
    final = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
    return pages.select("page_id", "url", final.alias("final_url"), "html")


def page_facts(pages: DataFrame) -> DataFrame:
    """One narrow row per page; the only operator that reads ``html``."""
    pages = fetchable(pages)
    html = F.col("html")
    empty_arr = F.array().cast("array<string>")
    # most pages answer under the URL asked for: it is cleaned once
    pages = pages.select("*", U.clean_url("url").alias("clean"))
    canonical = F.when(F.col("final_url").eqNullSafe(F.col("url")), F.col("clean")).otherwise(U.clean_url("final_url"))
    # stage 1: one pass over html; the visible form is computed once
    s1 = pages.select(
        "page_id", "url", U.strip_key("clean").alias("page_key"), canonical.alias("canonical_url"),
        H.visible_html(html).alias("vis"),
        H.page_title(html).alias("title"),
        F.when(html.contains("ld+json"), jsonld_blocks(html)).otherwise(empty_arr).alias("ld_blocks"),
        X.emails(html).alias("raw_emails"),
        X.phones(html).alias("raw_phones"),
        html.contains("data-cfemail").alias("has_cf"),
        html.contains("mailto:").alias("has_mailto"),
    )
    # stage 2: the page is cut at its tags once; texts and anchors are made of the pieces
    vis = F.col("vis")
    tags = F.when(vis.isNull() | vis.rlike(HAS_ANCHOR), H.tags(vis)).otherwise(empty_arr)
    s2 = s1.select("*", H.nodes_of(vis).alias("nodes"), tags.alias("tags")).drop("vis")
    df = s2.select(
        "page_id", "url", "page_key", "canonical_url", "title",
        H.text_of(F.col("nodes")).alias("text"),
        F.array_join("nodes", "").alias("text_nosep"),
        anchor_tags(F.col("nodes"), F.col("tags")).alias("anchors"),
        "ld_blocks", "raw_emails", "raw_phones", "has_cf", "has_mailto")
    found = F.col("anchors")
    cands = F.concat(
        _channel("text_email", X.emails("text")),
        _channel("text_phone", X.phones("text")),
        _channel("cf_email", F.when(F.col("has_cf"), cf_emails(found)).otherwise(empty_arr)),
        _channel("mailto_email", F.when(F.col("has_mailto"), mailto_emails(found)).otherwise(empty_arr)),
        _channel("nosep_phone", X.phones("text_nosep")),
        _channel("raw_email", F.col("raw_emails")),
        _channel("raw_phone", F.col("raw_phones")),
    )
    return df.select(
        "page_id", "url", "page_key", "canonical_url", "title",
        F.substring("text", 1, P.EXTRACTION_TEXT_CHARS).alias("text5000"),
        cands.alias("cands"),
        links(found).alias("links"),
        facebook_href(found).alias("fb_href"),
        "ld_blocks",
    )


def dedup_pages(facts: DataFrame, reuse: str = "table") -> DataFrame:
    """If several pages share a page_key, the smallest page_id is used.

    ``facts`` is a written table. Texts, links and JSON-LD stay where they are
    when the pages to drop are few enough to be broadcast, and are dealt otherwise.
    """
    return without(facts, second_pages(facts, reuse))


def second_pages(facts: DataFrame, reuse: str = "table") -> DataFrame:
    """(page_key, page_id) of the pages whose key has a page with a smaller id,
    found on these two columns alone, and written. Keys are counted by hash; only
    those that share theirs are compared."""
    ids = facts.filter("page_key is not null").select("page_key", "page_id", F.xxhash64("page_key").alias("_hash"))
    shared = ids.groupBy("_hash").agg(F.count("*").alias("n")).filter("n > 1").select("_hash")
    ids = materialize(ids.join(shared, "_hash", "left_semi").select("page_key", "page_id"), reuse)
    first = ids.groupBy("page_key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    drop = ids.join(first, "page_key").filter("page_id <> first_id").select("page_key", "page_id").distinct()
    return materialize(drop, reuse)


def without(rows: DataFrame, drop: DataFrame) -> DataFrame:
    """``rows`` (page_key, page_id, ..) but for those of the pages to drop."""
    return rows.join(drop, ["page_key", "page_id"], "left_anti")
