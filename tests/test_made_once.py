"""Costly values are made once a row, and read once a build: no filter on them makes them again."""

from pyspark.sql import functions as F

from webreach.functions import extract as X
from webreach.operators import fallback as FB
from webreach.operators import gather as G
from webreach.operators import jsonld as J
from webreach.operators import sites as S


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contact_link_is_resolved_once(spark):
    land = spark.createDataFrame([("https://a.test", "https://a.test/", 1, [
        ("/contact-us", "Reach", 0), ("/", "Contact", 1), ("/x/../contact-us/", "", 2), (None, "Contact", 3)])],
        "url string, website string, landing_id long, links array<struct<href string, text string, pos int>>")
    links = S.contact_links(land)
    assert plan(links).count("aggregate(") == 1
    assert [tuple(r) for r in links.collect()] == [("https://a.test", "https://a.test/contact-us", 0)]


def test_subpage_key_is_cleaned_once(spark):
    links = spark.createDataFrame([("u", "https://a.test/c?ref=x", 0), ("u", None, 1)], "url string, link_key string, link_pos int")
    facts = spark.createDataFrame([("https://a.test/c", 2, "c", "t"), (None, 3, "d", "t"), ("", 4, "e", "t"), ("#", 5, "f", "t")],
                                  "page_key string, page_id long, canonical_url string, text5000 string")
    subs = S.contact_subpages(links, facts)
    assert plan(subs).count("array_position(") == 1
    assert [r.sub_id for r in subs.collect()] == [2]


def test_hits_are_cleaned_once(spark):
    need = spark.createDataFrame([("s", "A", "https://www.facebook.com/a?ref=1")], "url string, company string, fb_href string")
    search = spark.createDataFrame([("A phone number", 1, None), ("A phone number", 2, "https://d.test/?x=1")],
                                   "query string, rank int, href string")
    cands = spark.createDataFrame([(None, "raw_phone", "0000000"), ("", "raw_phone", "1111111"), ("https://d.test/?x=1", "raw_phone", "0112574123"),
                                   ("https://www.facebook.com/a", "nosep_phone", "0112574999")], "page_key string, channel string, value string")
    answers = FB.stage_answers(need, search, cands)
    assert plan(answers).count("array_position(") == 3  # the Facebook link on both sides of its join, the hit
    row = answers.first()
    assert (row.facebook.phones, row.maps, row.web.phones) == (["0112574999"], None, ["0112574123"])


def test_jsonld_block_is_parsed_once_to_be_walked(spark, monkeypatch):
    blocks = spark.createDataFrame([("k", '{"email": "a@b.test"}'), ("j", '{bad "email": "c@d.test"'), ("n", None), ("s", '"text"')],
                                   "page_key string, body string")
    walked, real = [], J.materialize
    monkeypatch.setattr(J, "materialize", lambda df, *a: walked.append(plan(df)) or real(df, *a))
    found = J.jsonld_contacts(blocks)
    assert sorted(map(tuple, found.collect())) == [("j", "ld_email", "c@d.test"), ("k", "ld_email", "a@b.test")]
    assert walked[0].count("parseJson") == 2  # as it is, and with bare numbers


def test_replies_are_parsed_once_a_build(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "https://a.test/", "<p>x</p>")], "page_id long, url string, html string")
    targets = spark.createDataFrame([(0, "https://a.test")], "input_pos long, raw string")
    replies = spark.createDataFrame([("https://a.test/", '{"emails": ["e@a.test"], "phones": [], "summary": "s"}')], "url string, raw string")
    st = G.build(targets, pages, ai_contacts=replies)
    assert [tuple(r) for r in st.contacts.collect()] == [("https://a.test", "https://a.test/", ["e@a.test"], [], "s")]
    assert "parseJson" not in plan(st._ai_site)


def test_text_without_seven_digits_in_a_row_has_no_phone(spark):
    texts = [None, "", "12 345 x 6789", "tel 011 257 4123.", "(03) 9563 1234", "٠١٢ ٣٤٥ ٦٧٨٩", "1300 123 456", " 1234 5678"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.phones("t").alias("p"))
    found = {r.i: r.p for r in df.collect()}
    assert found[0] == found[1] == found[2] == [] and all(found[i] for i in range(3, len(texts)))
    assert found[7] == [" 1234 5678"]
    # the runs are looked for behind the cheaper pattern
    assert plan(df).count("){6}") == 1
