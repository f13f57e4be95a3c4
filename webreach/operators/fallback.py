"""Phone fallback chain and search-snippet contacts (O-F3..O-F7, O-D10, O-D11,
O-H3, O-H4, O-K2, O-E4).

Each stage's answer depends only on its search query (or Facebook link), so
it is computed once per distinct query and then joined to the sites that
still need a phone. Sites sharing a query (e.g. every untitled site searches
for "Unknown ...") therefore cost one page lookup, and the many-to-one join
is split by AQE when one query is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webreach.functions import extract as X
from webreach.functions import patterns as P
from webreach.functions import urls as U


def top_hits(search: DataFrame, k: int) -> DataFrame:
    """O-H4: the first k hits of every query, by rank, then href (window group
    limit); ``hit_no`` tells hits of equal rank apart."""
    w = Window.partitionBy("query").orderBy("rank", "href")
    return (search.withColumn("hit_no", F.row_number().over(w))
            .filter(F.col("hit_no") <= k))


def facebook_phones(fb_links: DataFrame, cands: DataFrame) -> DataFrame:
    """O-F3 lookup: (fb_key, phones) for Facebook pages with phones in their
    no-separator text."""
    keys = fb_links.filter(F.col("fb_href").isNotNull()).select(U.join_key("fb_href").alias("page_key")).distinct()
    c = cands.filter(F.col("channel") == "nosep_phone")
    return (keys.join(c, "page_key").groupBy("page_key")
            .agg(F.array_sort(F.collect_set("value")).alias("phones"))
            .withColumnRenamed("page_key", "fb_key"))


STAGES = (("maps", P.MAPS_QUERY_SUFFIX, "nosep_phone", None),
          ("yelp", P.YELP_QUERY_SUFFIX, "nosep_phone", None),
          ("web", P.WEB_QUERY_SUFFIX, "raw_phone", "raw_email"))
STAGE_ORDER = ("facebook", "maps", "yelp", "web")


def _wanted(need: DataFrame) -> DataFrame:
    """(url, stage, query): what the search stages ask for each site."""
    stage_rows = F.explode(F.array(*[U.nstruct(stage=F.lit(n), query=U.search_key(F.col("company"), suffix))
                                     for n, suffix, _, _ in STAGES]))
    return need.select("url", stage_rows.alias("s")).select("url", "s.stage", "s.query")


def query_hits(need: DataFrame, search: DataFrame, k: int = P.SEARCH_HITS) -> DataFrame:
    """need(url, company, ..) -> (query, stages, hit_no, page_key): the hits that the
    search stages look up, with or without a page, and the stages that ask the query."""
    queries = _wanted(need).groupBy("query").agg(*[F.max(F.col("stage") == n).alias(n) for n, _, _, _ in STAGES])
    hits = top_hits(search.select("query", "rank", "href").join(queries, "query"), k)
    stages = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n, _, _, _ in STAGES]))
    return hits.select("query", stages.alias("stages"), "hit_no", U.page_key("href").alias("page_key"))


def asked_hits(need: DataFrame, hits: DataFrame) -> DataFrame:
    """need(url, company, ..), ``query_hits`` -> (url, page_key): the pages that the
    search stages look up for each site, whether they exist or not."""
    return _wanted(need).select("url", "query").join(hits.select("query", "page_key"), "query").select("url", "page_key")


def stage_answers(need: DataFrame, search: DataFrame, cands: DataFrame, k: int = P.SEARCH_HITS, hits: DataFrame | None = None) -> DataFrame:
    """Every stage's answer for every site that needs a phone, side by side.

    need(url, company, fb_href) -> (url, facebook, maps, yelp, web), each a
    struct<phones, emails> or null; a search stage's answer is its first hit
    whose page has a phone (O-H3). The three search stages run as one pass
    keyed by (stage, query): one top-k window, one candidate join, one
    aggregation; each per-query answer is computed once and joined back.
    ``hits``: the written ``query_hits``, if others read them too.
    """
    empty = F.array().cast("array<string>")
    fb = facebook_phones(need.filter(F.col("fb_href").isNotNull()), cands)
    # sites without a link share no key: only the others take part in the join
    linked = (need.filter(F.col("fb_href").isNotNull()).select("url", U.join_key("fb_href").alias("fb_key"))
              .join(fb, "fb_key").select("url", U.nstruct(phones=F.col("phones"), emails=empty).alias("facebook")))
    base = need.select("url").join(linked, "url", "left")

    wanted = _wanted(need)
    if hits is None:
        queries = wanted.select("stage", "query").distinct()
        hits = top_hits(search.join(queries.select("query").distinct(), "query", "left_semi")
                        .select("query", "rank", "href"), k)
        hits = hits.filter(F.col("href").isNotNull()).join(queries, "query").withColumn("page_key", U.join_key("href"))
    else:
        hits = hits.select("query", "hit_no", "page_key", F.explode("stages").alias("stage"))
    phone_ch = F.create_map(*[x for n, _, pch, _ in STAGES for x in (F.lit(n), F.lit(pch))])
    email_ch = F.create_map(*[x for n, _, _, ech in STAGES for x in (F.lit(n), F.lit(ech or ""))])
    chans = sorted({c for _, _, pch, ech in STAGES for c in (pch, ech) if c})
    c = cands.filter(F.col("channel").isin(*chans))
    joined = hits.join(c, "page_key").filter(
        (F.col("channel") == phone_ch[F.col("stage")]) | (F.col("channel") == email_ch[F.col("stage")]))
    per_hit = (joined.groupBy("stage", "query", "hit_no")
               .agg(F.array_sort(F.collect_set(F.when(F.col("channel") == phone_ch[F.col("stage")], F.col("value"))))
                    .alias("phones"),
                    F.array_sort(F.collect_set(F.when(F.col("channel") == email_ch[F.col("stage")], F.col("value"))))
                    .alias("emails")))
    best = (per_hit.filter(F.size("phones") > 0).groupBy("stage", "query")
            .agg(F.min_by(U.nstruct(phones=F.col("phones"), emails=F.col("emails")), "hit_no").alias("a")))
    answers = (wanted.join(best, ["stage", "query"])
               .groupBy("url").agg(*[F.max(F.when(F.col("stage") == n, F.col("a"))).alias(n)
                                     for n, _, _, _ in STAGES]))
    return base.join(answers, "url", "left").select("url", *STAGE_ORDER)


def run_chain(need: DataFrame, search: DataFrame, cands: DataFrame, k: int = P.SEARCH_HITS, hits: DataFrame | None = None) -> dict[str, DataFrame]:
    """O-K2: need(url, company, fb_href) -> solved rows per stage.

    Stage order: facebook, maps, yelp, web; a stage counts only for sites
    every earlier stage left without a phone, which is the left_anti cascade
    written as first-non-null over the side-by-side answers. Every result is
    (url, stage, phones, emails); 'unsolved' lists the rest.
    """
    ans = stage_answers(need, search, cands, k, hits)
    first = F.coalesce(*[F.when(F.col(n).isNotNull(), U.nstruct(stage=F.lit(n), a=F.col(n)))
                         for n in STAGE_ORDER])
    chosen = ans.select("url", first.alias("c"))
    solved = chosen.filter(F.col("c").isNotNull()).select(
        "url", F.col("c.stage").alias("stage"), F.col("c.a.phones").alias("phones"),
        F.col("c.a.emails").alias("emails"))
    out = {"all": solved}
    for n in STAGE_ORDER:
        out[n] = solved.filter(F.col("stage") == n)
    out["unsolved"] = chosen.filter(F.col("c").isNull()).select("url")
    return out


def snippet_contacts(unreachable: DataFrame, search: DataFrame,
                     k: int = P.SNIPPET_HITS) -> DataFrame:
    """O-F7 + O-D10 + O-E4: contacts from search snippets for sites with no page.

    unreachable(url) -> (url, website, emails, phones, summary); sites whose
    snippets hold neither kind are dropped.
    """
    u = (unreachable.withColumn("website", U.clean_url("url"))
         .withColumn("query", U.search_key(U.url_domain("url"), P.SNIPPET_QUERY_SUFFIX)))
    needed = search.join(u.select("query").distinct(), "query", "left_semi")
    hits = top_hits(needed.select("query", "rank", "href", "title", "body"), k)
    piece = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    # at most k pieces per query: the ordered concat is bounded
    texts = (hits.groupBy("query")
             .agg(F.array_sort(F.collect_list(U.nstruct(rank=F.col("rank"), href=F.col("href"), t=piece))).alias("ps"))
             .select("query", F.array_join(F.transform("ps", lambda p: p["t"]), " ").alias("combined")))
    found = texts.select("query",
                         F.array_sort(X.strip_distinct(X.emails("combined"))).alias("emails"),
                         F.array_sort(X.strip_distinct(X.phones("combined"))).alias("phones"))
    return (u.join(found, "query")
            .filter((F.size("emails") > 0) | (F.size("phones") > 0))
            .select("url", "website", "emails", "phones", F.lit(P.SNIPPET_SUMMARY).alias("summary")))
