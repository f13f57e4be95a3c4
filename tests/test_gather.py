"""The fallback chain reads pages only for sites that need one."""

from pyspark.sql import functions as F

from webreach.operators import gather as G

PAGE = "<html><head><title>{t}</title></head><body>{b}</body></html>"


def pages(spark):
    rows = [("https://solved.test", PAGE.format(t="Solved", b='Call 011 257 4475 <a href="https://facebook.com/solved">f</a>')),
            ("https://linked.test", PAGE.format(t="Linked", b='<a href="/contact">Contact</a> <a href="https://facebook.com/linked">f</a>')),
            ("https://linked.test/contact", PAGE.format(t="c", b="Call 011 257 4476")),
            ("https://poor.test", PAGE.format(t="Poor", b='nothing <a href="https://facebook.com/poor">f</a>')),
            ("https://facebook.com/solved", PAGE.format(t="f", b="999 111 0001")), ("https://facebook.com/linked", PAGE.format(t="f", b="999 111 0002")),
            ("https://facebook.com/poor", PAGE.format(t="f", b="no number"))]
    rows += [(f"https://hits.test/{s}{k}", PAGE.format(t="h", b=f"call 077 123 00{n}{k}")) for n, s in enumerate(("solved", "linked", "poor")) for k in range(2)]
    rows += [("https://other.test", PAGE.format(t="o", b="999 111 0009"))]
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def build(spark, **kw):
    targets = spark.createDataFrame([(i, f"https://{s}.test") for i, s in enumerate(("solved", "linked", "poor"))], "input_pos long, raw string")
    search = spark.createDataFrame([(f"{s.title()} site:yelp.com phone number", k, f"https://hits.test/{s}{k}", "", "") for s in ("solved", "linked", "poor") for k in range(2)], G.SEARCH_SCHEMA)
    return G.build(targets, pages(spark), search, **kw)


def test_no_hit_page_of_a_solved_site_is_parsed(spark):
    st = build(spark, prune=True)
    parsed = {r.url for r in st.facts.select("url").collect()}
    assert parsed == {"https://solved.test", "https://linked.test", "https://linked.test/contact", "https://poor.test",
                      "https://facebook.com/poor", "https://hits.test/poor0", "https://hits.test/poor1"}
    phones = {r.url: r.phones for r in st.contacts.collect()}
    assert phones["https://poor.test"] and phones["https://solved.test"] == ["011 257 4475"] and phones["https://linked.test"] == ["011 257 4476"]


def test_pruned_build_equals_the_whole(spark):
    rows = [sorted(map(str, build(spark, prune=p).contacts.select("url", F.array_sort("emails"), F.array_sort("phones"), "summary").collect())) for p in (True, False)]
    assert rows[0] == rows[1]
