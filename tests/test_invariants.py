"""Pipeline invariants on the synthetic sites."""

from pyspark.sql import functions as F

from webreach.functions import extract as X
from webreach.plans import site_queries as SQ

SF = "/root/testdata/sf0.001"


def test_final_phones_have_seven_digits(spark):
    c = SQ.stages(spark, SF).contacts
    bad = c.select(F.explode("phones").alias("p")).filter(~X.has_min_digits("p")).count()
    assert bad == 0


def test_enrich_keeps_every_row(spark):
    st = SQ.stages(spark, SF)
    n_in = st.tables["syn_targets"].count()
    from webreach.plans.registry import QUERIES
    assert QUERIES["enriched_rows"](spark, SF).count() == n_in


def test_without_external_tables_finals_are_candidates(spark):
    """No search results and no model replies: every final value is a page
    candidate of the site or came from its Facebook page."""
    from webreach.functions.urls import py_strip
    from webreach.operators import gather as G
    T = SQ.stages(spark, SF).tables
    st = G.build(T["syn_targets"], T["syn_pages"])
    finals = st.contacts.select("url", F.explode(F.concat("emails", "phones")).alias("v"))
    cands = st.site_cands.select("url", py_strip("value").alias("v"))
    fb = st.chain["all"].select("url", F.explode("phones").alias("v"))
    assert set(st.chain["all"].select("stage").distinct().toPandas()["stage"]) <= {"facebook"}
    assert finals.join(cands.unionByName(fb), ["url", "v"], "left_anti").count() == 0


def test_every_fallback_stage_and_branch_fires(spark):
    st = SQ.stages(spark, SF)
    for stage in ("facebook", "maps", "yelp", "web"):
        assert st.chain[stage].count() > 0, stage
    assert st.chain["unsolved"].count() > 0
    assert st.snippets.count() > 0
    for ch in ("text_email", "text_phone", "cf_email", "mailto_email", "ld_email", "ld_phone", "nosep_phone",
               "raw_phone"):
        assert st.cands.filter(F.col("channel") == ch).count() > 0, ch


def test_pruned_build_equals_full_build(spark):
    from webreach.operators import gather as G
    T = SQ.stages(spark, SF).tables
    some = T["syn_targets"].filter("input_pos % 7 = 0")
    args = (some, T["syn_pages"], T["search_results"], T["ai_contacts"], T["ai_decisions"])
    full, few = G.build(*args), G.build(*args, prune=True)
    rows = lambda st: sorted(map(repr, st.contacts.collect()))
    assert rows(full) == rows(few) and few.contacts.count() > 10
    assert few.facts.count() < full.facts.count() / 2
