"""Markup that real pages hold and tidy ones don't, against the standard parser."""

import html
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from webreach.functions import html as H
from webreach.operators import external as E
from webreach.operators import jsonld as J
from webreach.operators import pages as PG

SF = "/root/testdata/sf0.001"


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize("text", [
    "info&commat;a.com", "a&#00000064;b", "&#9999999;", "&#xFFFFFF;", "&#xD800;", "&#0;", "&#x0;", "&#x80;&#159;", "&#1;&#xFFFE;", "&amp;lt;",
    "&#64 x", "&#x40", "&nosuch; && & &;", "&#99999999999999999999999999;", "&#x1F600;", "&#13;", "&NewLine;&Tab;", "&#;&#x;", "&lpar;&rpar;&period;&plus;"])
def test_references_as_the_standard_reads_them(spark, text):
    assert column(spark, [text], lambda c: H.decode_entities(c, bind=False)) == [html.unescape(text)]


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        href = next((v for k, v in attrs if k == "href"), None)  # of equal names the first counts
        if tag == "a" and href is not None:
            href = href.strip()
            if href and not href.startswith(("mailto:", "#")):
                self.found.append(href)


def parsed(page):
    p = Links()
    p.feed(page)
    p.close()
    return p.found


class Text(HTMLParser):
    """Stripped text nodes outside scripts, styles and templates; '</>' is no text to the newer standard."""

    def __init__(self):
        super().__init__()
        self.found, self.skip, self.open = [], 0, False

    def handle_starttag(self, tag, attrs):
        self.open = False
        self.skip += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        self.open = False
        self.skip -= tag in ("script", "style", "template") and self.skip > 0

    def handle_comment(self, data):
        self.open = False

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        if not self.skip:  # the parser hands one node over in several parts
            if self.open:
                self.found[-1] += data
            else:
                self.found.append(data)
            self.open = True


def parsed_text(page):
    p = Text()
    p.feed(page.replace("\r\n", "\n").replace("\r", "\n"))
    p.close()
    return " ".join(x for x in map(str.strip, p.found) if x), "".join(p.found)


HOSTILE_TEXT = ["a\ue000b<b>\ue001c</b> \ue000", "1 < 2 and 3 > 2 <p>x<y</p>", "<p title='a > b'>one</p><img alt=\"x > y > z\" src=q>two<input value='>'>",
                "a<!-- x > y --><!DOCTYPE html><br/>b<?pi x?>c", "<p data-x=a>b > c</p>", "<div title=\"<b>no</b>\">t</div>", "<>< ><3", "&#xE000;&#xE001;|<i>&#57344;</i>",
                "<p a='1' b=\"2\" c = '>' d>e</p>", "x<script data-a='>'>no > no</script>y<style>p > a {}</style>z<template><p>no</p></template>w",
                "<p " + " ".join(f"a{i}='{i} > 1'" for i in range(5000)) + ">many</p>", "\u00a0\u2003 padded \x1c<b> </b>\u3000", "a\r\nb<br>\rc", "\x00<p>\x00z</p>"]


def test_text_against_the_standard_parser(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + HOSTILE_TEXT
    got = column(spark, pages, lambda c: F.struct(H.page_text(c), H.page_text_nosep(c)))
    assert [tuple(g) for g in got] == [parsed_text(p) for p in pages]


def test_icon_fonts_keep_the_anchor(spark):
    pages = ['<a href="/reach"><i>\ue001</i> Contact us</a>', '<a href="/reach">\ue000Contact<i>\ue001</i></a>']
    assert column(spark, pages, lambda c: PG.anchors(c)[0]["text"]) == ["\ue001 Contact us", "\ue000Contact \ue001"]


def test_long_markup_costs_its_length(spark):
    parts = ["<p " + "x=y " * 300_000, "<a x=\"" * 200_000, "<" * 1_000_000, "<b>" * 300_000, "<script x" * 100_000, " " * 1_000_000 + "x" + "\t" * 1_000_000, "&" * 500_000, "<!-- " * 200_000]
    t = time.time()
    column(spark, parts, lambda c: F.struct(F.length(H.page_text(c)), F.size(PG.anchors(c)), F.size(PG.jsonld_blocks(c))))
    assert time.time() - t < 120


HOSTILE = ['<a title="go href=/no" href="/yes">y</a>', "<img alt='<a href=/no>'><a data-href=/no href=/10>t</a>", '<a href = "/11" href="/12">u</a><a/href=/13>v</a>', '<a href="/14"title="x">w</a>',
           '<a href="/1">one <a href="/2">two</a>', '<a title="x > y" href="/3">z</a>', "<A HREF='/4'\n class=x>q</A >", '<abbr><a\nhref=/5>r</a></abbr>',
           '<!-- <a href="/no"> --><a href="/6">s', '<script>"<a href=/no>"</script><a href="/7">', '<a href="/8" data-x=\'>\'>t</a><a href="/9">',
           "<a>no</a><a href>none</a><a href=''>x</a>", '<script>var a = 1; <a href="/no">']


def test_anchors_against_the_standard_parser(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + HOSTILE
    got = column(spark, pages, lambda c: F.transform(PG.anchors(c), lambda a: a["href"]))
    assert [list(g) for g in got] == [parsed(p) for p in pages]


def test_unclosed_anchors_cost_their_length(spark):
    def seconds(n):
        page = '<p>x' + '<a href="/a">some words ' * n
        t = time.time()
        assert column(spark, [page], lambda c: F.size(PG.anchors(c))) == [n]
        return time.time() - t
    seconds(1000)
    assert seconds(100_000) < 60


def test_jsonld_blocks(spark):
    ld = '<script type="application/ld+json">%s</script>'
    pages = [ld % '<!-- {"email":"a@b.test"} -->', "<!-- " + ld % "{}" + " -->", ld % "1" + ld % "2", '<script type="application/ld+json">unclosed']
    assert column(spark, pages, PG.jsonld_blocks) == [['<!-- {"email":"a@b.test"} -->'], [], ["1", "2"], ["unclosed"]]


def test_jsonld_at_any_depth(spark):
    rows = [(str(n), '{"a":[' * n + '{"email":"d%d@x.test"}' % n + "]}" * n) for n in (0, 1, 5, 6, 10, 20, 40)]
    rows += [("nan", '{"v":[NaN,NaN,-Infinity],"phone":"1"}'), ("bad", "{ e@x.test"), ("wrapped", '<!-- {"email":"w@x.test"} -->'), ("none", None)]
    got = {(r.page_key, r.value) for r in J.jsonld_contacts(spark.createDataFrame(rows, "page_key string, body string")).collect()}
    assert got == {(str(n), f"d{n}@x.test") for n in (0, 1, 5, 6, 10, 20, 40)} | {("nan", "1"), ("bad", "e@x.test"), ("wrapped", "w@x.test")}


def test_replies(spark):
    dec = spark.createDataFrame([("a", ""), ("b", None), ("c", "no object"), ("d", '{"emails": ["z"]}'), ("d", '{"emails": ["y"]}'), ("e", "  ")], "site string, raw string")
    got = {r.site: (r.mode, r.keep_emails) for r in E.parse_decisions(dec).collect()}
    assert got == {"c": ("jsonld", None), "d": ("list", ["y"])}
    cand = spark.createDataFrame([(s, s, "email", v, False) for s in "abde" for v in ("x", "y")], "url string, website string, kind string, value string, is_landing_ld boolean")
    kept = lambda **k: sorted((r.url, r.value) for r in E.apply_keep_list(cand, E.parse_decisions(dec), **k).collect())
    assert kept() == sorted([(s, v) for s in "abe" for v in "xy"] + [("d", "y")])
    more = spark.createDataFrame([("d", '{"emails": ["y", "new"]}')], "site string, raw string")
    assert ("d", "new") in {(r.url, r.value) for r in E.apply_keep_list(cand, E.parse_decisions(more), add_listed=True).collect()}
