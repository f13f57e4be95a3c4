"""What the page pass reads by cheaper means gives the rows of the plain ones."""

from webreach.functions import html as H
from webreach.functions import patterns as P

def test_common_references_stand_in_front():
    assert H._NAMES.startswith("map('amp', ") and sorted(H._ORDERED) == sorted(P.HTML_ENTITIES)


def test_references_are_read_as_before(spark):
    cases = {"a &amp; b": "a & b", "&copy;&nbsp;x": "\xa9\xa0x", "&bogus; &amp": "&bogus; &amp", "&#65;&#x42;&#67": "ABC", "&# &#; &#x; &#xg": "&# &#; &#x; &#xg",
             "&#0;&#128;": "�€", "&&lt;": "&<", "&#38;lt;": "&lt;", "&#99999999999;": "�", "no reference": "no reference", "&": "&", "&#1;z": "z"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.d for r in df.select("t", H.decode_entities("t").alias("d")).collect()} == cases


def test_line_breaks_and_blank_nodes(spark):
    df = spark.createDataFrame([("<p>a\r\nb\rc</p>\r<p> </p><p>\xa0</p><p></p><p> d </p>",), ("<p>a\nb</p>",), (None,)], "t string")
    assert "contains" in df.select(H.visible_html("t"))._jdf.queryExecution().analyzed().toString().lower()  # most pages have no '\r' to replace
    got = df.select(H.visible_html("t").alias("v"), H.page_text("t").alias("x")).collect()
    assert [r.v for r in got] == ["<p>a\nb\nc</p>\n<p> </p><p>\xa0</p><p></p><p> d </p>", "<p>a\nb</p>", None]
    assert [r.x for r in got] == ["a\nb\nc d", "a\nb", None]
