"""The flagship: crawled pages + target URLs -> one contact record per site
(O-K1), with every intermediate relation exposed for inspection and tests.

Plan shape (all set-at-a-time):

  pages --page_facts (one html scan)--> facts --min page_id per page_key-->
  targets -> distinct sites --left join--> landing
  landing.links --filter/resolve--> contact links --join--> contact pages
  facts --explode + JSON-LD walk--> page candidates
  sites x (landing + contact pages) --join--> site candidates (+ ai values)
  --left join decisions--> kept --phones empty?--> fallback chain (anti joins)
  --union, strip, distinct, 7-digit rule--> contacts
  sites without a landing page --> search snippets --union--> contacts
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from webreach.functions import extract as X
from webreach.functions import patterns as P
from webreach.functions import urls as U
from webreach.operators import deny as DN
from webreach.operators import enrich as EN
from webreach.operators import external as E
from webreach.operators import fallback as FB
from webreach.operators import pages as PG
from webreach.operators import sites as S
from webreach.functions.urls import let, nstruct, py_strip
from webreach.session import materialize

SEARCH_SCHEMA = "query string, rank int, href string, title string, body string"
AI_CONTACTS_SCHEMA = "url string, raw string"
AI_DECISIONS_SCHEMA = "site string, raw string"


@dataclass
class Stages:
    """The relations of a build. Each is made, and written if several others read
    it, when it is first asked for: who wants the contact links of the sites
    doesn't pay for the fallback chain."""
    targets_raw: DataFrame
    pages: DataFrame
    search: DataFrame
    ai_contacts: DataFrame
    ai_decisions: DataFrame
    reuse: str = "table"
    search_hits: int = P.SEARCH_HITS
    snippet_hits: int = P.SNIPPET_HITS
    add_listed: bool = False
    prune: bool = False
    parsed: bool = False
    deny_rules: DataFrame | None = None
    page_cands: DataFrame | None = None

    def _kept(self, df: DataFrame) -> DataFrame:
        return materialize(df, self.reuse)

    def _parse(self, keys: DataFrame | None) -> DataFrame:
        return _facts(self.pages, keys, self.reuse, self.parsed)

    @cached_property
    def targets(self) -> DataFrame:
        return S.prepare_targets(self.targets_raw)

    @cached_property
    def sites(self) -> DataFrame:
        sites = S.sites(self.targets)
        return self._kept(sites) if self.prune else sites

    # ---- pages: one scan of html, or up to three over those that are asked for

    @cached_property
    def _site_keys(self) -> DataFrame:
        return self._kept(self.sites.select(F.col("site_key").alias("page_key")).distinct())

    @cached_property
    def _second_pages(self) -> DataFrame:
        return PG.second_pages(self.pages, self.reuse)

    @cached_property
    def _landing_facts(self) -> DataFrame:
        if self.page_cands is not None:
            asked = self.pages.join(self._site_keys, "page_key", "left_semi") if self.prune else self.pages
            return PG.without(asked, self._second_pages)
        return self._parse(self._site_keys if self.prune else None)

    @cached_property
    def _linked_keys(self) -> DataFrame:
        linked = self.links.select(U.page_key("link_key").alias("page_key")).distinct()
        return self._kept(linked.join(self._site_keys, "page_key", "left_anti"))

    @cached_property
    def _site_facts(self) -> DataFrame:
        """Landing and contact pages (all pages without ``prune``, and where they are
        only read to be joined)."""
        if self.page_cands is not None:
            return PG.without(self.pages, self._second_pages)
        return self._landing_facts.unionByName(self._parse(self._linked_keys)) if self.prune else self._landing_facts

    @cached_property
    def _site_page_cands(self) -> DataFrame:
        if self.page_cands is not None:
            return PG.without(self.page_cands, self._second_pages).select("page_key", "channel", "value")
        return self._kept(S.page_candidates(self._site_facts))

    @cached_property
    def hits(self) -> DataFrame:
        """Hits that the search stages look up for the sites without a phone."""
        return self._kept(FB.query_hits(self.need, self.search, self.search_hits))

    @cached_property
    def _fallback_facts(self) -> DataFrame:
        """Facebook and hit pages of the sites without a phone (``prune`` only)."""
        asked = (self.need.filter("fb_href is not null").select(U.page_key("fb_href").alias("page_key"))
                 .unionByName(self.hits.select("page_key"))).distinct()
        asked = asked.join(self._site_keys, "page_key", "left_anti").join(self._linked_keys, "page_key", "left_anti")
        return self._parse(self._kept(asked))

    @cached_property
    def facts(self) -> DataFrame:
        whole = self.page_cands is not None or not self.prune
        return self._site_facts if whole else self._site_facts.unionByName(self._fallback_facts)

    @cached_property
    def cands(self) -> DataFrame:
        if self.page_cands is not None or not self.prune:
            return self._site_page_cands
        return self._site_page_cands.unionByName(self._kept(S.page_candidates(self._fallback_facts)))

    # ---- sites

    @cached_property
    def landing(self) -> DataFrame:
        return self._kept(S.landing(self.sites, self._landing_facts))

    @cached_property
    def links(self) -> DataFrame:
        links = S.contact_links(self.landing)
        return self._kept(links) if self.prune else links

    @cached_property
    def subpages(self) -> DataFrame:
        return self._kept(S.contact_subpages(self.links, self._site_facts))

    @cached_property
    def primary(self) -> DataFrame:
        return self._kept(S.primary_page(self.landing, self.subpages))

    @cached_property
    def site_cands(self) -> DataFrame:
        return self._kept(S.site_candidates(S.site_pages(self.landing, self.subpages), self._site_page_cands))

    @cached_property
    def _websites(self) -> DataFrame:
        return self.landing.filter(F.col("landing_id").isNotNull()).select("url", "website", "title", "fb_href")

    # ---- external extraction on the primary page (O-F9), keep-list

    @cached_property
    def ai(self) -> DataFrame:
        return E.parse_ai_contacts(self.ai_contacts)

    @cached_property
    def _ai_site(self) -> DataFrame:
        """Parsed replies by site: read for the kept values and for the summaries."""
        replies = self.ai.withColumnRenamed("url", "primary_url")
        return self._kept(self.primary.select("url", "primary_url").join(replies, "primary_url", "left")
                          .select("url", "ai_emails", "ai_phones", "ai_summary"))

    @cached_property
    def kept(self) -> DataFrame:
        ai_vals = (self._ai_site.select("url", F.explode(F.concat(
            F.transform(F.coalesce("ai_emails", F.array().cast("array<string>")),
                        lambda v: nstruct(kind=F.lit("email"), value=v)),
            F.transform(F.coalesce("ai_phones", F.array().cast("array<string>")),
                        lambda v: nstruct(kind=F.lit("phone"), value=v)))).alias("a"))
            .select("url", F.lit("ai").alias("role"), "a.kind", F.lit("ai").alias("channel"), "a.value"))
        keyed = (self.site_cands.unionByName(ai_vals).join(self._websites.select("url", "website"), "url")
                 .withColumn("is_landing_ld", (F.col("role") == "landing") & F.col("channel").isin("ld_email", "ld_phone")))
        return self._kept(E.apply_keep_list(keyed, E.parse_decisions(self.ai_decisions), self.add_listed))

    # ---- fallback chain for sites whose kept phone list is empty

    @cached_property
    def need(self) -> DataFrame:
        has_phone = self.kept.filter(F.col("kind") == "phone").select("url").distinct()
        need = (self._websites.join(has_phone, "url", "left_anti")
                .select("url", F.col("title").alias("company"), "fb_href"))
        return self._kept(need) if self.prune else need

    @cached_property
    def chain(self) -> dict[str, DataFrame]:
        hits = self.hits if self.prune else None
        solved = self._kept(FB.run_chain(self.need, self.search, self.cands, self.search_hits, hits)["all"])
        return {"all": solved, **{n: solved.filter(F.col("stage") == n) for n in FB.STAGE_ORDER},
                "unsolved": self.need.select("url").join(solved.select("url"), "url", "left_anti")}

    # ---- contacts

    @cached_property
    def _page_contacts(self) -> DataFrame:
        extra = self.chain["all"].select("url", F.explode(F.concat(
            F.transform("phones", lambda v: nstruct(kind=F.lit("phone"), value=v)),
            F.transform("emails", lambda v: nstruct(kind=F.lit("email"), value=v)))).alias("a"))\
            .select("url", "a.kind", "a.value")
        final_vals = self.kept.unionByName(extra).withColumn("value", py_strip("value"))
        final_vals = final_vals.filter(F.col("value") != "").filter(
            (F.col("kind") == "email") | X.has_min_digits("value")).distinct()
        agg = final_vals.groupBy("url").agg(
            F.array_sort(F.collect_set(F.when(F.col("kind") == "email", F.col("value")))).alias("emails"),
            F.array_sort(F.collect_set(F.when(F.col("kind") == "phone", F.col("value")))).alias("phones"))
        return (self._websites.select("url", "website")
                .join(agg, "url", "left")
                .join(self._ai_site.select("url", F.coalesce("ai_summary", F.lit("")).alias("summary")), "url", "left")
                .select("url", "website",
                        F.coalesce("emails", F.array().cast("array<string>")).alias("emails"),
                        F.coalesce("phones", F.array().cast("array<string>")).alias("phones"),
                        F.coalesce("summary", F.lit("")).alias("summary")))

    @cached_property
    def snippets(self) -> DataFrame:
        unreachable = self.landing.filter(F.col("landing_id").isNull()).select("url")
        snippets = FB.snippet_contacts(unreachable, self.search, self.snippet_hits)
        if self.deny_rules is not None:
            snippets = DN.without_denied(snippets, self.deny_rules).filter((F.size("emails") > 0) | (F.size("phones") > 0))
        return self._kept(snippets)

    @cached_property
    def _counted(self) -> tuple[DataFrame, dict | None]:
        """Contacts, and their counts (O-G6) if they are written: the write counts,
        so that no second pass has to."""
        contacts = self._page_contacts
        if self.deny_rules is not None:
            contacts = DN.without_denied(contacts, self.deny_rules)
        contacts = contacts.unionByName(self.snippets)
        if self.reuse != "table":
            return contacts, None
        seen = Observation()
        return self._kept(contacts.observe(seen, *EN.count_columns())), seen.get

    @cached_property
    def contacts(self) -> DataFrame:
        return self._counted[0]

    @cached_property
    def counts(self) -> dict | None:
        return self._counted[1]


def _empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _facts(pages: DataFrame, keys: DataFrame | None, reuse: str, parsed: bool) -> DataFrame:
    """Parsed pages, one a key; of those keys only, if given."""
    if keys is not None:
        pages = (pages.withColumn("_asked", F.col("page_key") if parsed else U.page_key("url"))
                 .join(keys.select(F.col("page_key").alias("_asked")), "_asked", "left_semi").drop("_asked"))
    return PG.dedup_pages(materialize(pages if parsed else PG.page_facts(pages), reuse), reuse)


def build(targets_raw: DataFrame, pages: DataFrame, search_results: DataFrame | None = None,
          ai_contacts: DataFrame | None = None, ai_decisions: DataFrame | None = None,
          reuse: str = "table", search_hits: int = P.SEARCH_HITS, snippet_hits: int = P.SNIPPET_HITS,
          add_listed: bool = False, prune: bool = False, parsed: bool = False,
          deny_rules: DataFrame | None = None, page_cands: DataFrame | None = None) -> Stages:
    """``deny_rules``: a table (kind, text) of operators/deny.py; no contact has an
    e-mail that it denies. ``parsed``: ``pages`` holds the rows of ``page_facts`` already,
    one for each page_id and key; ``page_cands`` then are their candidates (page_id, page_key,
    channel, value), both written tables, which are joined as they stand and not copied.
    ``prune``: pages are first cut down, by URL alone, to those that are asked
    for, so ``html`` is read behind a semi-join: first the targets' pages, then
    the contact pages that they link to, and last, for the sites that have no
    phone by then and for no others, the Facebook and hit pages of the fallback
    chain. It pays when targets ask for few of the pages; when they ask for
    most, one parse of all of them without dealing ``html`` is less work."""
    spark = pages.sparkSession
    search = search_results if search_results is not None else _empty(spark, SEARCH_SCHEMA)
    ai_c = ai_contacts if ai_contacts is not None else _empty(spark, AI_CONTACTS_SCHEMA)
    ai_d = ai_decisions if ai_decisions is not None else _empty(spark, AI_DECISIONS_SCHEMA)

    return Stages(targets_raw, pages, search, ai_c, ai_d, reuse, search_hits, snippet_hits, add_listed, prune, parsed, deny_rules, page_cands)


def dedup_phones(phones) -> F.Column:
    """O-G3 on an array: normalise, one spelling per digit string (the
    smallest), empty-digit values dropped, sorted."""
    normed = F.transform(phones, lambda p: let(X.normalize_phone(p), lambda n: nstruct(d=X.digits_only(n), p=n)))
    normed = F.filter(normed, lambda s: s["d"] != "")
    ordered = F.array_sort(normed)  # by digits, then spelling
    firsts = F.filter(ordered, lambda s, i: (i == 0) | (s["d"] != F.try_element_at(ordered, F.greatest(i, F.lit(1)))["d"]))
    return F.array_sort(F.transform(firsts, lambda s: s["p"]))
