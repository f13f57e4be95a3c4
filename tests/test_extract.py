"""Unit goldens for text, phone, e-mail, protected-address and JSON-LD operators."""

from pyspark.sql import functions as F

from webreach.functions import extract as X
from webreach.functions import html as H
from webreach.functions import patterns as P
from webreach.operators import jsonld as J

NBSP = " "

PHONE_GOLDENS = [
    ("Hotline 011 2574475 now", ["011 2574475"], [" 011 2574"], []),
    ("Tel:011 2574475", ["011 2574475"], ["011 2574475"], []),
    ("(03) 9563 6578", [], ["(03) 9563 6578"], []),
    ("888 926 2289", ["888 926 2289"], ["888 926 2289"], []),
    ("+94 77 748 9289", ["77 748 9289"], ["77 748 9289"], []),
    ("+1-800-555-0100", ["800-555-0100"], ["800-555-0100"], []),
    ("1300 123 456", [], [], ["1300 123 456"]),
    ("555-1234", [], ["555-1234"], []),
    ("v1.2.3 2024-01-01", [], [], []),
    ("0112574475123", ["0112574475"], ["01125744751"], ["0112574475"]),
    (f"011{NBSP}257-4475", [f"011{NBSP}257-4475"], None, None),
]


def test_phone_patterns(spark):
    df = spark.createDataFrame([(t,) for t, *_ in PHONE_GOLDENS], "t string")
    cols = [X.find_all("t", p).alias(f"p{i}") for i, p in enumerate(P.PHONE_PATTERNS)]
    got = {r.t: (r.p0, r.p1, r.p2) for r in df.select("t", *cols).collect()}
    for text, a, b, c in PHONE_GOLDENS:
        ga, gb, gc = got[text]
        assert ga == a, text
        if b is not None:
            assert gb == b and gc == c, text


def test_phones_min_digits(spark):
    df = spark.createDataFrame([("Hotline 011 2574475 now and 555-12",)], "t string")
    got = sorted(df.select(X.phones("t").alias("p")).first().p)
    assert got == [" 011 2574", "011 2574475"]


NORMALIZE_PHONE = [
    ("7712345678", "+94 77 123 45678"),
    ("94777489289", "+94 77 489 289"),
    ("+94 77 748 9289", "+94 77 489 289"),
    ("+94 11 257 4475", "+94 11 257 4475"),
    ("(718) 555-1234", "+94 71 855 51234"),
    ("077 748 9289", "077 748 9289"),
]


def test_normalize_phone(spark):
    df = spark.createDataFrame([(a,) for a, _ in NORMALIZE_PHONE], "p string")
    got = dict(df.select("p", X.normalize_phone("p").alias("n")).collect())
    for a, b in NORMALIZE_PHONE:
        assert got[a] == b


def test_phone_sort_and_dedup(spark):
    from webreach.operators.gather import dedup_phones
    df = spark.createDataFrame([(["077 748 9289", "011 2574475", "94777489289", "+94 77 748 9289"],)], "p array<string>")
    got = df.select(dedup_phones(F.col("p")).alias("d")).first().d
    assert got == ["+94 77 489 289", "011 2574475", "077 748 9289"]


CF = [
    ("5a33343c351a3b39373f742e3f292e", "info@acme.test"),
    ("1764767b726457607e73707263643963726463", "sales@widgets.test"),
    ("ff91908bd29e91d29a929e9693", "not-an-email"),
    ("zz41", ""), ("5", ""), ("", ""),
]


def test_cf_decode(spark):
    df = spark.createDataFrame([(a,) for a, _ in CF], "h string")
    got = dict(df.select("h", X.cf_decode("h").alias("d")).collect())
    for h, want in CF:
        assert got[h] == want, h


def test_page_text_and_title(spark):
    html = ("<html><head><title> A &amp; B </title><script>var t='<p>x@y.co</p>';</script></head>"
            "<body><p><b>info</b>@x.com</p><p>mail&#64;site.test &nbsp;z</p><!-- c@d.co --></body></html>")
    df = spark.createDataFrame([(html,)], "h string")
    r = df.select(H.page_text("h").alias("t"), H.page_title("h").alias("title"),
                  H.page_text_nosep("h").alias("n")).first()
    assert r.title == "A & B"
    assert r.t == f"A & B info @x.com mail@site.test {NBSP}z"
    assert "x@y.co" not in r.t and "c@d.co" not in r.t
    assert "info@x.com" in r.n


JSONLD = [
    ('{"@graph":[{"email":"a@b.co","contactPoint":{"telephone":"+1 2","email":["x@y.z"]}}]}',
     {("ld_email", "a@b.co"), ("ld_phone", "+1 2")}),
    ('[{"E-Mail":" c@d.co ","faxNumber":"12"}]', {("ld_email", "c@d.co"), ("ld_phone", "12")}),
    ('{"email":"no-at-sign","telephone":5}', set()),
    ('{"email":"mailto:q@r.co"}', {("ld_email", "mailto:q@r.co")}),
    ('{bad "email": "e@f.co"', {("ld_email", "e@f.co")}),
]


def test_jsonld_walk(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(JSONLD)], "block long, body string")
    got = {}
    for r in J.jsonld_contacts(df, ("block",)).collect():
        got.setdefault(r.block, set()).add((r.channel, r.value))
    for i, (_, want) in enumerate(JSONLD):
        assert got.get(i, set()) == want, JSONLD[i][0]


LINKS = [
    ("/contact", "Reach the team", False), ("/contact", "Contact", True), ("/contact-us", "x", True),
    ("/contactus", "x", True), ("contact-us", "x", False), ("/pages/contact", "x", True),
    ("/get-in-touch", "x", True), ("/enquiries", "x", True), ("/inquiries", "x", False), ("/reach", "x", False),
    ("/x", "Enquiry", False), ("/x", "Contacts", False), ("/x", "CONTACT US", True),
]


def test_contact_link_patterns(spark):
    df = spark.createDataFrame([(h, t) for h, t, _ in LINKS], "href string, text string")
    got = [r.k for r in df.select((F.col("href").rlike(P.CONTACT_HREF) | F.col("text").rlike(P.CONTACT_TEXT))
                                  .alias("k")).collect()]
    assert got == [k for _, _, k in LINKS]
