"""Deny rules by table: every domain above counts, rules can be supplied; counts come with the write."""

from tests.test_gather import PAGE, build
from webreach.functions import quality as Q
from webreach.operators import deny as DN
from webreach.operators import enrich as EN
from webreach.operators import gather as G

VALUES = ["x@mail.example.com", "x@example.com", "x@notexample.com", "x@example.com.au", " Your@Shop.test ", "logo@2x.PNG", "a@png.test",
          "a@b.test", "no-at-sign", "@", "", None, "x@mail.example.com", "deep@a.b.c.shop.test", "é@ünï.test"]


def brute(value, rules):
    if value is None:
        return None
    v = value.strip().lower()
    domain, mailbox = v.rsplit("@", 1)[-1], v.split("@", 1)[0]
    labels = domain.split(".")
    for i in range(len(labels)):
        if ("domain", ".".join(labels[i:])) in rules:
            return "domain:" + ".".join(labels[i:])
    return f"mailbox:{mailbox}" if mailbox and ("mailbox", mailbox) in rules else None


def test_rules_against_plain_python(spark):
    values = spark.createDataFrame([(i, v, "x") for i, v in enumerate(VALUES)], "url long, value string, domain string")
    given = [("domain", "shop.test"), ("domain", " C.Shop.test"), ("domain", ""), ("domain", None), ("mailbox", "a"), ("mailbox", "A "), (None, "b.test"), ("other", "b.test")]
    for rules in (DN.default_rules(spark), spark.createDataFrame(given, DN.RULES_SCHEMA), spark.createDataFrame([], DN.RULES_SCHEMA)):
        plain = {(r.kind, (r.text or "").strip().lower()) for r in rules.collect() if r.text}
        got = DN.judged(values, rules)
        assert got.columns == ["value", "url", "domain", "rule"]
        assert {r.url: r.rule for r in got.collect()} == {i: brute(v, plain) for i, v in enumerate(VALUES)}
    assert DN.judged(values.limit(0), rules).count() == 0


def test_predicate_denies_domains_below(spark):
    df = spark.createDataFrame([(v,) for v in VALUES if v], "v string").select("v", Q.plausible_email("v").alias("ok"))
    ok = {r.v: r.ok for r in df.collect()}
    assert not ok["x@mail.example.com"] and not ok["x@example.com"] and not ok["logo@2x.PNG"]
    assert ok["x@notexample.com"] and ok["x@example.com.au"] and ok["deep@a.b.c.shop.test"]


def test_supplied_rules_hold_for_contacts(spark):
    page = PAGE.format(t="Shop", b="call 011 257 4475 or write to a@mail.shop.test, b@shop.test, c@other.test")
    pages = spark.createDataFrame([(1, "https://shop.test", page)], "page_id long, url string, html string")
    targets = spark.createDataFrame([(0, "https://shop.test"), (1, "https://gone.test"), (2, "https://lost.test")], "input_pos long, raw string")
    search = spark.createDataFrame([("gone.test contact email phone", 0, "h", "", "z@shop.test"), ("lost.test contact email phone", 0, "h", "", "y@shop.test z@lost.test")], G.SEARCH_SCHEMA)
    rules = spark.createDataFrame([("domain", "shop.test")], DN.RULES_SCHEMA)
    for prune in (True, False):
        free = G.build(targets, pages, search, prune=prune)
        st = G.build(targets, pages, search, prune=prune, deny_rules=rules)
        emails = lambda s: {r.url: sorted(r.emails) for r in s.contacts.collect()}
        assert emails(free) == {"https://shop.test": ["a@mail.shop.test", "b@shop.test", "c@other.test"], "https://gone.test": ["z@shop.test"],
                                "https://lost.test": ["y@shop.test", "z@lost.test"]}
        assert emails(st) == {"https://shop.test": ["c@other.test"], "https://lost.test": ["z@lost.test"]}
        assert st.contacts.columns == free.contacts.columns


def test_counts_come_with_the_write(spark):
    st = build(spark)
    assert st.counts is not None and st.counts["results"] == 3
    passed = st.contacts.agg(*EN.count_columns())
    assert EN.run_counts(st).dtypes == passed.dtypes
    assert EN.run_counts(st).collect() == passed.collect()
    st.counts = None
    assert EN.run_counts(st).collect() == passed.collect()
