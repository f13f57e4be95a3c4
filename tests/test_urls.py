"""Unit goldens for the URL operators (FIXTURES.md section 2)."""


from webreach.functions import sqlfns as S
from webreach.functions import urls as U

NORMALIZE = [
    (" example.com ", "https://example.com", True),
    ("http://a.com", "http://a.com", True),
    ("", "", False),
    ("example.com:8080", "example.com:8080", False),
    ("HTTP://a.com", "HTTP://a.com", False),
    ("ftp://a.com", "ftp://a.com", False),
    ("https://a b", "https://a b", True),
    ("https://.a", "https://.a", False),
    ("https://a", "https://a", False),
]

CLEAN = [
    ("http://e.com/a?page=2&ref=x", "http://e.com/a?page=2"),
    ("http://e.com/a?b=1&c=&b=2&REF=q#top", "http://e.com/a?b=1&b=2#top"),
    ("http://e.com?", "http://e.com"),
    ("https://e.com/x?q=a%20b~*", "https://e.com/x?q=a+b~%2A"),
    ("http://e.com/a?a=1&b=2&a=3", "http://e.com/a?a=1&a=3&b=2"),
]

RESOLVE = [
    ("http://a.com/x/y?q=1", "../c#f", "http://a.com/c#f"),
    ("http://a.com/x/y", "//b.com/z", "http://b.com/z"),
    ("http://a.com/x/y", "?z=1", "http://a.com/x/y?z=1"),
    ("http://a.com/x", "javascript:void(0)", "javascript:void(0)"),
    ("http://a.com", "contact", "http://a.com/contact"),
]


def test_normalize_and_validate(spark):
    df = spark.createDataFrame([(a,) for a, _, _ in NORMALIZE], "raw string")
    got = {r.raw: (r.url, r.ok) for r in df.select(
        "raw", U.normalize_url("raw").alias("url")).select("raw", "url", U.is_valid_url("url").alias("ok")).collect()}
    for raw, url, ok in NORMALIZE:
        assert got[raw] == (url, ok), raw


def test_clean_url(spark):
    df = spark.createDataFrame([(a,) for a, _ in CLEAN], "u string")
    got = dict(df.select("u", U.clean_url("u").alias("c")).collect())
    for u, c in CLEAN:
        assert got[u] == c, u


def test_clean_url_idempotent(spark):
    df = spark.createDataFrame([(a,) for a, _ in CLEAN], "u string")
    rows = df.select(U.clean_url("u").alias("c")).select("c", U.clean_url("c").alias("cc")).collect()
    assert all(r.c == r.cc for r in rows)


def test_resolve_link(spark):
    df = spark.createDataFrame([(b, h) for b, h, _ in RESOLVE], "b string, h string")
    got = {(r.b, r.h): r.r for r in df.select("b", "h", U.resolve_link("b", "h").alias("r")).collect()}
    for b, h, want in RESOLVE:
        assert got[(b, h)] == want, (b, h)


def test_display_and_domain(spark):
    df = spark.createDataFrame([("https://www.a.com/",), ("example.com:8080",)], "u string")
    rows = df.select(U.display_url("u").alias("d"), U.url_domain("u").alias("dom")).collect()
    assert rows[0].d == "www.a.com" and rows[0].dom == "www.a.com"
    assert rows[1].dom == "example.com:8080"


def test_page_key_joins_tracking_variants(spark):
    df = spark.createDataFrame([("https://s.test/?utm_source=feed",), ("https://s.test",), ("https://s.test/#x",)], "u string")
    keys = {r.k for r in df.select(U.page_key("u").alias("k")).collect()}
    assert keys == {"https://s.test"}


def test_one_plain_field_is_cleaned_like_any_query(spark, monkeypatch):
    """The short way for such URLs gives what the long way gives, and leaves all others to it."""
    kept = ["https://e.com/?id=1", "http://e.com?p=a-b_c.d~e", "https://e.com/a/?refer=1", "https://e.com/x?REFS=2", "https://e.com\n/?a=b"]
    rest = ["https://e.com/?ref=1", "https://e.com/?REF=1", "https://e.com/?Utm_Source=f", "https://e.com/?=1", "https://e.com/?a=", "https://e.com/?a",
            "https://e.com/?a=1#f", "https://e.com/#f?a=1", "https://e.com/?a=b=c", "https://e.com/?a=%41", "https://e.com/?a=b+c", "https://e.com/?a=*",
            "https://e.com/?a=1&a=2", "https://e.com/?a=1?", "HTTPS://e.com/?a=1", "ftp://e.com/?a=1", "//e.com/?a=1", "?a=1", "https://e.com/?a=é",
            "https://e.com/?a=1\n", "https://e.com/??a=1", None, ""]
    df = spark.createDataFrame([(u,) for u in kept + rest], "u string")
    short = {r.u: (r.c, r.k) for r in df.selectExpr("u", S.clean_url_sql("u") + " AS c", f"u RLIKE {S.r(S._KEPT_FIELD)} AS k").collect()}
    monkeypatch.setattr(S, "_KEPT_FIELD", r"\A\z.")
    long = {r.u: r.c for r in df.selectExpr("u", S.clean_url_sql("u") + " AS c").collect()}
    assert {u: c for u, (c, _) in short.items()} == long
    assert [u for u in kept + rest if short[u][1]] == kept
