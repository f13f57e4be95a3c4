"""The page pass reads what it can skip no more often than it must, with the same rows."""

import re

from pyspark.sql import functions as F

from webreach.functions import html as H
from webreach.functions import urls as U
from webreach.operators import pages as PG

PAGES = [
    "plain text, no tag", "a\r\nb\rc\n\r\nd", "", None,
    "<SCRIPT>var a='</p>';</SCRIPT>x<script >y</script\n>z<scripty>w</scripty>",
    "<style>p{}</style><template><p>t</p></template><!-- <script> --> <p>after</p>",
    "<script>never closed <p>x</p>", "<!-- never closed <p>x</p>", "< script>text</script>", "<!doctype html><p>1 < 2 &amp; 3</p>",
    "<!-- a --><script><!-- b --></script>c<!--d", "<a href='/x'>one</a> <A\nHREF=/y>two</A>", "<a/href=/z>three</a>", "<a>no href</a>",
    "<abbr>no anchor</abbr><area href=/q>", "</a>closed only<br>"]


def rows(spark):
    return spark.createDataFrame([(i, f"https://s{i}.test/", v) for i, v in enumerate(PAGES)], "page_id int, url string, html string")


def test_blocks_are_those_of_the_plain_pattern(spark):
    plain = F.regexp_replace(F.regexp_replace("html", r"\r\n?", "\n"), H.INVISIBLE, H.EMPTY_TAG)
    for r in rows(spark).select("html", plain.alias("plain"), H.visible_html("html").alias("got")).collect():
        assert r.got == r.plain, r.html


def test_a_block_is_looked_for_behind_its_bracket_only():
    # one alternative a kind of block would be tried at every character
    assert re.match(r"\(\?is\)<\(\?:", H.INVISIBLE_BLOCK)


def test_links_equal_those_of_all_tags(spark):
    df = rows(spark)
    got = {r.page_id: r.links for r in PG.page_facts(df).select("page_id", "links").collect()}
    want = {r.page_id: r.links for r in df.select("page_id", PG.anchors(F.col("html")).alias("links")).collect()}
    assert got == want
    assert {i for i, found in got.items() if found} == {11, 12} and got[3] is None


def test_nodes_with_and_without_references(spark):
    for r in rows(spark).select(H.nodes_of(F.col("html")).alias("got"), H.decoded(H.raw_nodes(F.col("html"))).alias("want")).collect():
        assert r.got == r.want


def test_a_url_is_cleaned_once_unless_redirected(spark, monkeypatch):
    pages = [(1, "https://a.test/?utm_source=x", None, 200), (2, "https://b.test/", "https://www.b.test/home?ref=1&q=2", 200),
             (3, None, None, 200), (4, "https://c.test/#top", "https://c.test/#top", 200)]
    df = spark.createDataFrame([(*p, "<p>x</p>") for p in pages], "page_id int, url string, final_url string, status int, html string")
    cleaned = []
    clean_url = U.clean_url
    monkeypatch.setattr(U, "clean_url", lambda c: cleaned.append(c) or clean_url(c))
    got = {r.page_id: (r.page_key, r.canonical_url) for r in PG.page_facts(df).collect()}
    assert cleaned == ["url", "final_url"]
    assert got == {1: ("https://a.test", "https://a.test/"), 2: ("https://b.test", "https://www.b.test/home?q=2"),
                   3: (None, None), 4: ("https://c.test", "https://c.test/#top")}
