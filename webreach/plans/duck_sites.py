"""DuckDB twin of the site pipeline, as one CTE chain over the synthetic
tables (same SQL text as Spark reads). Oracle queries select from it."""

from __future__ import annotations

from webreach.functions import patterns as P
from webreach.operators.jsonld import BARE_NUMBER
from webreach.operators.sites import MAIN_EMAIL_CHANNELS, MAIN_PHONE_CHANNELS
from webreach.plans import duck as D
from webreach.sources import synth

_EMPTY = "[]::VARCHAR[]"


def _in(values) -> str:
    return "(" + ", ".join(D.lit(v) for v in values) + ")"


def facts_ctes(src: str, dedup: bool = True) -> list[tuple[str, str]]:
    """page facts + candidates over ``src`` (page_id, url, final_url, status, html)."""
    facts0 = f"""
SELECT page_id, url, {D.page_key('url')} AS page_key, {D.clean_url('coalesce(final_url, url)')} AS canonical_url,
  {D.page_text('html')} AS text, {D.page_text_nosep('html')} AS text_nosep, {D.page_title('html')} AS title,
  {D.anchor_tags('html')} AS tags,
  CASE WHEN instr(html, 'ld+json') > 0 THEN {D.jsonld_blocks('html')} ELSE {_EMPTY} END AS ld_blocks,
  {D.emails('html')} AS raw_emails, {D.phones('html')} AS raw_phones,
  instr(html, 'data-cfemail') > 0 AS has_cf, instr(html, 'mailto:') > 0 AS has_mailto
FROM {src} WHERE status IS NULL OR status BETWEEN 200 AND 399"""
    facts = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY page_id) AS rn FROM facts0) WHERE rn = 1"""
    if not dedup:
        facts = "SELECT * FROM facts0"
    facts_out = f"""
SELECT page_id, url, page_key, canonical_url, title, substr(text, 1, {P.EXTRACTION_TEXT_CHARS}) AS text5000,
  {D.links('tags')} AS links, {D.facebook_href('tags')} AS fb_href, ld_blocks, text, text_nosep, tags, raw_emails, raw_phones,
  has_cf, has_mailto
FROM facts1"""
    fixed = f"regexp_replace(regexp_replace(body, {D.lit(BARE_NUMBER)}, '\\1null\\2', 'g'), {D.lit(BARE_NUMBER)}, '\\1null\\2', 'g')"
    ld_blocks = f"""
SELECT page_id, page_key, body, CASE WHEN json_valid(body) THEN body WHEN json_valid({fixed}) THEN {fixed} END AS json
FROM (SELECT page_id, page_key, unnest(ld_blocks) AS body FROM facts)"""
    ld_walk = f"""
SELECT page_id, page_key, CASE WHEN lower(t.key) IN {_in(P.JSONLD_EMAIL_KEYS)} THEN 'ld_email' ELSE 'ld_phone' END AS channel,
  {D.strip("json_extract_string(t.value, '$')")} AS value
FROM ld_bodies b, json_tree(coalesce(b.json, 'null')) t
WHERE b.json IS NOT NULL AND t.type = 'VARCHAR' AND (
  (lower(t.key) IN {_in(P.JSONLD_EMAIL_KEYS)} AND instr(json_extract_string(t.value, '$'), '@') > 0)
  OR lower(t.key) IN {_in(P.JSONLD_PHONE_KEYS)})"""
    ld_fallback = f"""
SELECT page_id, page_key, 'ld_email' AS channel, unnest({D.emails('body')}) AS value FROM ld_bodies WHERE json IS NULL"""
    page_cands = f"""
SELECT DISTINCT * FROM (
  SELECT page_id, page_key, 'text_email' AS channel, unnest({D.emails('text')}) AS value FROM facts
  UNION ALL SELECT page_id, page_key, 'text_phone', unnest({D.phones('text')}) FROM facts
  UNION ALL SELECT page_id, page_key, 'cf_email', unnest(CASE WHEN has_cf THEN {D.cf_emails('tags')} ELSE {_EMPTY} END) FROM facts
  UNION ALL SELECT page_id, page_key, 'mailto_email', unnest(CASE WHEN has_mailto THEN {D.mailto_emails('tags')} ELSE {_EMPTY} END) FROM facts
  UNION ALL SELECT page_id, page_key, 'nosep_phone', unnest({D.phones('text_nosep')}) FROM facts
  UNION ALL SELECT page_id, page_key, 'raw_email', unnest(raw_emails) FROM facts
  UNION ALL SELECT page_id, page_key, 'raw_phone', unnest(raw_phones) FROM facts
  UNION ALL SELECT * FROM ld_walk
  UNION ALL SELECT * FROM ld_fallback)"""
    cands = "SELECT DISTINCT page_key, channel, value FROM page_cands"
    return [("facts0", facts0), ("facts1", facts), ("facts", facts_out), ("ld_bodies", ld_blocks), ("ld_walk", ld_walk),
            ("ld_fallback", ld_fallback), ("page_cands", page_cands), ("cands", cands)]


def site_ctes() -> list[tuple[str, str]]:
    targets = f"""
SELECT CAST(input_pos AS BIGINT) AS input_pos, raw, {D.normalize_url('raw')} AS url FROM syn_targets
WHERE {D.is_valid_url(D.normalize_url('raw'))}"""
    sites = f"SELECT url, {D.page_key('url')} AS site_key FROM (SELECT DISTINCT url FROM targets)"
    land = """
SELECT s.url, s.site_key, f.page_id AS landing_id, f.canonical_url AS website, f.title, f.links, f.fb_href
FROM sites s LEFT JOIN facts f ON f.page_key = s.site_key"""
    links = f"""
SELECT url, link_key, min(pos) AS link_pos FROM (
  SELECT url, website, pos, {D.strip_key(D.resolve_link('website', 'href'))} AS link_key FROM (
    SELECT url, website, l.pos AS pos, l.href AS href, l.text AS text
    FROM (SELECT url, website, unnest(links) AS l FROM land WHERE landing_id IS NOT NULL))
  WHERE {D.rlike('href', P.CONTACT_HREF)} OR {D.rlike('text', P.CONTACT_TEXT)})
WHERE link_key <> '' AND link_key <> regexp_replace(website, '/+\\z', '')
GROUP BY url, link_key"""
    subs = f"""
SELECT c.url, c.link_key, c.link_pos, f.page_id AS sub_id, f.canonical_url AS sub_url, f.text5000
FROM (SELECT *, {D.page_key('link_key')} AS sub_key FROM clinks) c JOIN facts f ON f.page_key = c.sub_key"""
    primary = """
SELECT l.url, l.website,
  coalesce(d.sub_url, l.website) AS primary_url,
  coalesce(d.text5000, a.last_text, lt.text5000) AS primary_text
FROM (SELECT url, website, landing_id FROM land WHERE landing_id IS NOT NULL) l
LEFT JOIN facts lt ON lt.page_id = l.landing_id
LEFT JOIN (SELECT s.url, arg_min(s.sub_url, s.link_pos) AS sub_url, arg_min(s.text5000, s.link_pos) AS text5000
           FROM subs s JOIN land w ON w.url = s.url WHERE s.sub_url <> w.website GROUP BY s.url) d ON d.url = l.url
LEFT JOIN (SELECT url, arg_max(text5000, link_pos) AS last_text FROM subs GROUP BY url) a ON a.url = l.url"""
    spages = f"""
SELECT url, site_key AS page_key, 'landing' AS role FROM land WHERE landing_id IS NOT NULL
UNION
SELECT url, {D.page_key('link_key')} AS page_key, 'contact' AS role FROM subs"""
    main = MAIN_EMAIL_CHANNELS + MAIN_PHONE_CHANNELS
    site_cands = f"""
SELECT DISTINCT sp.url, sp.role, CASE WHEN c.channel IN {_in(MAIN_EMAIL_CHANNELS)} THEN 'email' ELSE 'phone' END AS kind,
  c.channel, c.value
FROM spages sp JOIN cands c ON c.page_key = sp.page_key WHERE c.channel IN {_in(main)}"""
    span = D.reply_span("raw")
    ai = f"""
SELECT url, r.e AS ai_emails, r.p AS ai_phones, r.s AS ai_summary FROM (
SELECT url, arg_min({{'e': ai_emails, 'p': ai_phones, 's': ai_summary}}, coalesce(raw, '')) AS r
FROM (
  SELECT url, raw,
    CASE WHEN ok THEN coalesce({D.strip_distinct("try_cast(json_extract(j, '$.emails') AS VARCHAR[])")}, {_EMPTY}) ELSE {_EMPTY} END AS ai_emails,
    CASE WHEN ok THEN coalesce({D.strip_distinct("try_cast(json_extract(j, '$.phones') AS VARCHAR[])")}, {_EMPTY}) ELSE {_EMPTY} END AS ai_phones,
    CASE WHEN ok THEN coalesce(json_extract_string(j, '$.summary'), '') ELSE '' END AS ai_summary
  FROM (SELECT url, raw, {span} AS j, {span} <> '' AND json_valid({span}) AS ok FROM ai_contacts))
GROUP BY url)"""
    dec = f"""
SELECT site, r.m AS mode, r.e AS keep_emails, r.p AS keep_phones FROM (
SELECT site, arg_min({{'m': mode, 'e': keep_emails, 'p': keep_phones}}, raw) AS r
FROM (
  SELECT site, raw, CASE WHEN ok THEN 'list' ELSE 'jsonld' END AS mode,
    CASE WHEN ok AND json_exists(j, '$.emails') THEN coalesce({D.strip_distinct("try_cast(json_extract(j, '$.emails') AS VARCHAR[])")}, {_EMPTY}) END AS keep_emails,
    CASE WHEN ok AND json_exists(j, '$.phones') THEN coalesce({D.strip_distinct("try_cast(json_extract(j, '$.phones') AS VARCHAR[])")}, {_EMPTY}) END AS keep_phones
  FROM (SELECT site, raw, {span} AS j, {span} <> '' AND json_valid({span}) AS ok FROM ai_decisions WHERE {D.strip('raw')} <> ''))
GROUP BY site)"""
    ai_site = """
SELECT p.url, p.website, p.primary_url, a.ai_emails, a.ai_phones, a.ai_summary
FROM primary_page p LEFT JOIN ai a ON a.url = p.primary_url"""
    all_cands = """
SELECT url, role, kind, channel, value FROM site_cands
UNION ALL SELECT url, 'ai', 'email', 'ai', unnest(coalesce(ai_emails, []::VARCHAR[])) FROM ai_site
UNION ALL SELECT url, 'ai', 'phone', 'ai', unnest(coalesce(ai_phones, []::VARCHAR[])) FROM ai_site"""
    websites = "SELECT url, website, title, fb_href FROM land WHERE landing_id IS NOT NULL"
    kept = f"""
SELECT DISTINCT c.url, c.kind, c.value
FROM all_cands c JOIN websites w ON w.url = c.url LEFT JOIN dec d ON d.site = w.website
WHERE CASE WHEN d.mode IS NULL THEN true
           WHEN d.mode = 'jsonld' THEN c.role = 'landing' AND c.channel IN ('ld_email', 'ld_phone')
           WHEN (CASE WHEN c.kind = 'email' THEN d.keep_emails ELSE d.keep_phones END) IS NULL THEN true
           ELSE list_contains(CASE WHEN c.kind = 'email' THEN d.keep_emails ELSE d.keep_phones END, {D.strip('c.value')}) END"""
    need = """
SELECT url, title AS company, fb_href FROM websites
WHERE url NOT IN (SELECT url FROM kept WHERE kind = 'phone')"""
    fb = f"""
SELECT n.url, list_sort(list(DISTINCT c.value)) AS phones
FROM need n JOIN cands c ON c.page_key = {D.page_key('n.fb_href')} AND c.channel = 'nosep_phone'
WHERE n.fb_href IS NOT NULL GROUP BY n.url"""

    def stage(name, suffix, pch, ech):
        hits = f"""
SELECT query, hit_no, href, {D.page_key('href')} AS page_key FROM (
  SELECT query, rank, href, row_number() OVER (PARTITION BY query ORDER BY rank, href) AS hit_no
  FROM search_results WHERE query IN (SELECT company || {D.lit(suffix)} FROM need)) WHERE hit_no <= {P.SEARCH_HITS}"""
        per_hit = f"""
SELECT h.query, h.hit_no,
  list_sort(list(DISTINCT c.value) FILTER (WHERE c.channel = {D.lit(pch)})) AS phones,
  list_sort(list(DISTINCT c.value) FILTER (WHERE c.channel = {D.lit(ech or '')})) AS emails
FROM ({hits}) h JOIN cands c ON c.page_key = h.page_key AND c.channel IN ({D.lit(pch)}, {D.lit(ech or pch)})
GROUP BY h.query, h.hit_no"""
        best = f"""
SELECT query, arg_min(phones, hit_no) AS phones, arg_min(coalesce(emails, {_EMPTY}), hit_no) AS emails
FROM ({per_hit}) WHERE len(coalesce(phones, {_EMPTY})) > 0 GROUP BY query"""
        return f"""
SELECT n.url, b.phones, b.emails FROM need n JOIN ({best}) b ON b.query = n.company || {D.lit(suffix)}"""

    answers = f"""
SELECT n.url,
  CASE WHEN fb.url IS NOT NULL THEN {{'phones': fb.phones, 'emails': {_EMPTY}}} END AS facebook,
  CASE WHEN m.url IS NOT NULL THEN {{'phones': m.phones, 'emails': m.emails}} END AS maps,
  CASE WHEN y.url IS NOT NULL THEN {{'phones': y.phones, 'emails': y.emails}} END AS yelp,
  CASE WHEN w.url IS NOT NULL THEN {{'phones': w.phones, 'emails': w.emails}} END AS web
FROM need n LEFT JOIN fb_stage fb ON fb.url = n.url LEFT JOIN maps_stage m ON m.url = n.url
LEFT JOIN yelp_stage y ON y.url = n.url LEFT JOIN web_stage w ON w.url = n.url"""
    solved = """
SELECT url, CASE WHEN facebook IS NOT NULL THEN 'facebook' WHEN maps IS NOT NULL THEN 'maps'
                 WHEN yelp IS NOT NULL THEN 'yelp' WHEN web IS NOT NULL THEN 'web' END AS stage,
  coalesce(facebook, maps, yelp, web) AS a
FROM answers"""
    chain = """
SELECT url, stage, a.phones AS phones, a.emails AS emails FROM solved WHERE stage IS NOT NULL"""
    final_vals = f"""
SELECT DISTINCT url, kind, value FROM (
  SELECT url, kind, {D.strip('value')} AS value FROM (
    SELECT url, kind, value FROM kept
    UNION ALL SELECT url, 'phone', unnest(phones) FROM chain
    UNION ALL SELECT url, 'email', unnest(emails) FROM chain))
WHERE value <> '' AND (kind = 'email' OR {D.has_min_digits('value')})"""
    page_contacts = f"""
SELECT w.url, w.website,
  coalesce(list_sort(list(v.value) FILTER (WHERE v.kind = 'email')), {_EMPTY}) AS emails,
  coalesce(list_sort(list(v.value) FILTER (WHERE v.kind = 'phone')), {_EMPTY}) AS phones,
  coalesce(any_value(a.ai_summary), '') AS summary
FROM websites w LEFT JOIN final_vals v ON v.url = w.url LEFT JOIN ai_site a ON a.url = w.url
GROUP BY w.url, w.website"""
    snip_sites = f"""
SELECT url, {D.clean_url('url')} AS website, {D.url_domain('url')} || {D.lit(P.SNIPPET_QUERY_SUFFIX)} AS query
FROM land WHERE landing_id IS NULL"""
    snip_text = f"""
SELECT query, string_agg(coalesce(title, '') || ' ' || coalesce(body, ''), ' ' ORDER BY rank, href) AS combined
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, href) AS hit_no
      FROM search_results WHERE query IN (SELECT query FROM snip_sites))
WHERE hit_no <= {P.SNIPPET_HITS} GROUP BY query"""
    snippets = f"""
SELECT s.url, s.website, list_sort({D.strip_distinct(D.emails('t.combined'))}) AS emails,
  list_sort({D.strip_distinct(D.phones('t.combined'))}) AS phones, {D.lit(P.SNIPPET_SUMMARY)} AS summary
FROM snip_sites s JOIN snip_text t ON t.query = s.query"""
    snippets_kept = "SELECT * FROM snippets0 WHERE len(emails) > 0 OR len(phones) > 0"
    contacts = "SELECT url, website, emails, phones, summary FROM page_contacts UNION ALL SELECT * FROM snippets"
    out = [("targets", targets), ("sites", sites), ("land", land), ("clinks", links), ("subs", subs),
           ("primary_page", primary), ("spages", spages), ("site_cands", site_cands), ("ai", ai), ("dec", dec),
           ("ai_site", ai_site), ("all_cands", all_cands), ("websites", websites), ("kept", kept), ("need", need),
           ("fb_stage", fb)]
    for name, suffix, pch, ech in (("maps", P.MAPS_QUERY_SUFFIX, "nosep_phone", None),
                                   ("yelp", P.YELP_QUERY_SUFFIX, "nosep_phone", None),
                                   ("web", P.WEB_QUERY_SUFFIX, "raw_phone", "raw_email")):
        out.append((f"{name}_stage", stage(name, suffix, pch, ech)))
    out += [("answers", answers), ("solved", solved), ("chain", chain), ("final_vals", final_vals),
            ("page_contacts", page_contacts), ("snip_sites", snip_sites), ("snip_text", snip_text),
            ("snippets0", snippets), ("snippets", snippets_kept), ("contacts", contacts)]
    return out


def pipeline_sql(select: str) -> str:
    ctes = [(n, synth.for_dialect(s, "duckdb")) for n, s in synth.SYNTH_TABLES.items()]
    ctes += facts_ctes("syn_pages") + site_ctes()
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + "\n" + select


def pages_facts_sql(select: str, dedup: bool = True) -> str:
    """Facts + candidates over the crawled ``pages`` table."""
    ctes = facts_ctes("(SELECT page_id, url, NULL AS final_url, NULL AS status, html FROM pages)", dedup)
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + "\n" + select
