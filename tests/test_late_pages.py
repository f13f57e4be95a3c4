"""Contacts after each epoch of a page feed equal the whole batch; only touched sites are recomputed."""

from pyspark.sql import functions as F

from tests.test_gather import PAGE, pages
from webreach.functions import patterns as P
from webreach.operators import fallback as FB
from webreach.operators import gather as G
from webreach.operators import pages as PG
from webreach.streaming import contacts as C

SITES = ("solved", "linked", "poor", "gone")


def inputs(spark):
    targets = spark.createDataFrame([(i, f"https://{s}.test") for i, s in enumerate(SITES)], "input_pos long, raw string")
    search = spark.createDataFrame(
        [(f"{s.title()} site:yelp.com phone number", k, f"https://hits.test/{s}{k}", "", "") for s in ("solved", "linked", "poor") for k in range(2)]
        + [("Unknown site:yelp.com phone number", 0, "https://hits.test/poor1", "", "")], G.SEARCH_SCHEMA)
    return targets, search


def rows(df):
    return sorted(map(str, df.select("url", "website", F.array_sort("emails"), F.array_sort("phones"), "summary").collect()))


def test_late_pages_touch_their_sites_only(spark, tmp_path):
    base, src, all_pages = str(tmp_path / "run"), str(tmp_path / "in"), pages(spark)
    targets, search = inputs(spark)
    late = spark.createDataFrame([(100, "https://gone.test", PAGE.format(t="Gone", b="Call 011 257 4499")),
                                  (-1, "https://solved.test/", PAGE.format(t="Solved", b="Call 011 257 4400"))], all_pages.schema)
    first = "url in ('https://solved.test', 'https://linked.test', 'https://poor.test')"
    feed = [(all_pages.filter(first), set(SITES)),
            # a contact page, hits and Facebook pages: solved sites don't look at the last two
            (all_pages.filter(f"not ({first}) and url <> 'https://other.test'"), {"linked", "poor"}),
            (all_pages.filter("url in ('https://other.test', 'https://linked.test')"), set()),  # asked for by none; known already
            (late, {"gone", "solved"})]                                                        # a missing landing page; one that takes another's place
    for epoch, (batch, touched) in enumerate(feed):
        batch.coalesce(1).write.mode("append").parquet(src)
        got = C.run_contact_stream(spark, src, base, targets, search)
        done = {r.url for r in C.site_log(spark, base).filter(F.col("epoch") == epoch).select("url").collect()}
        assert done == {f"https://{s}.test" for s in touched}, epoch
    whole = rows(G.build(targets, all_pages.unionByName(late), search).contacts)
    assert rows(got) == whole and len(whole) == 4
    C.refresh(spark, base, 1, feed[1][0], targets, search)  # a replayed epoch replaces itself
    assert rows(C.contact_table(spark, base)) == whole


def test_an_epoch_makes_hits_and_candidates_once(spark, tmp_path, monkeypatch):
    targets, search = inputs(spark)
    ranked, copied, real_hits, real_write = [], [], FB.top_hits, G.materialize
    monkeypatch.setattr(FB, "top_hits", lambda df, k: ranked.append(k) or real_hits(df, k))
    monkeypatch.setattr(G, "materialize", lambda df, *a: copied.append(df.columns) or real_write(df, *a))
    C.refresh(spark, str(tmp_path / "run"), 0, pages(spark), targets, search)
    assert sorted(ranked) == sorted([P.SEARCH_HITS, P.SNIPPET_HITS])
    assert not [c for c in copied if "ld_blocks" in c]  # facts are joined as they stand
    found = spark.read.parquet(str(tmp_path / "run" / "cands" / "epoch=0"))
    assert found.columns == ["page_id", "page_key", "channel", "value"]
    assert found.filter("page_key = 'https://hits.test/solved0' and channel = 'raw_phone'").count() == 1


def test_pages_that_come_once_are_not_dealt(spark):
    known = PG.page_facts(pages(spark).limit(0))
    plan = C.new_facts(pages(spark), known)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_a_page_counts_once_by_id_and_key(spark):
    rows = [(1, "https://a.test/x"), (1, "https://a.test/x/"), (1, "https://a.test/x#top"), (1, "https://a.test/y"), (2, "https://a.test/x"),
            (3, None), (3, None), (None, "https://a.test/z"), (None, "https://a.test/z"), (None, None), (None, None), (4, "https://a.test/v"), (5, "https://a.test/w")]
    df = spark.createDataFrame([(i, u, "<p>x</p>") for i, u in rows], "page_id long, url string, html string")
    known = PG.page_facts(df.filter("page_id = 4 or url = 'https://a.test/z'"))
    got = [(r.page_id, r.page_key) for r in C.new_facts(df, known).collect()]
    want = [(1, "https://a.test/x"), (1, "https://a.test/y"), (2, "https://a.test/x"), (3, None), (None, "https://a.test/z"), (None, None), (5, "https://a.test/w")]
    assert sorted(map(str, got)) == sorted(map(str, want))  # no page without an id has come before


def test_a_smaller_id_takes_a_key_in_a_later_epoch(spark, tmp_path):
    base = str(tmp_path / "run")
    targets = spark.createDataFrame([(0, "https://a.test")], "input_pos long, raw string")
    html = PAGE.format(t="A", b='Call 011 257 {n} <script type="application/ld+json">{{"email": "e{n}@a.test"}}</script>')
    for epoch, page_id in enumerate((7, 3, 5)):
        page = [(page_id, "https://a.test/", html.format(n=4400 + page_id))]
        C.refresh(spark, base, epoch, spark.createDataFrame(page, "page_id long, url string, html string"), targets)
        row = C.contact_table(spark, base).first()
        smallest = min((7, 3, 5)[:epoch + 1])
        assert (row.phones, row.emails) == ([f"011 257 {4400 + smallest}"], [f"e{4400 + smallest}@a.test"])
