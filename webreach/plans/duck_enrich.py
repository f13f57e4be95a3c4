"""DuckDB twins of the enrichment, export and audit operators."""

from __future__ import annotations

from webreach.functions import patterns as P
from webreach.operators.fallback import STAGE_ORDER
from webreach.plans import duck as D


_LOOKUP_CTE = f"""
lk_urls AS (SELECT url, min(input_pos) AS pos FROM targets GROUP BY url),
lk_rec AS (SELECT u.url, u.pos, c.website IS NOT NULL AS found, c.website, c.emails, c.phones, c.summary
           FROM lk_urls u LEFT JOIN contacts c ON c.url = u.url),
lk_keys AS (
  SELECT {D.clean_url('url')} AS lookup_key, pos, 0 AS slot, found, website, emails, phones, summary FROM lk_rec
  UNION ALL SELECT url, pos, 1, found, website, emails, phones, summary FROM lk_rec
  UNION ALL SELECT website, pos, 2, found, website, emails, phones, summary FROM lk_rec WHERE found),
lookup AS (
  SELECT lookup_key, arg_max({{'found': found, 'website': website, 'emails': emails, 'phones': phones, 'summary': summary}},
                             {{'pos': pos, 'slot': slot}}) AS c
  FROM lk_keys GROUP BY lookup_key),
lookup_found AS (SELECT lookup_key, c FROM lookup WHERE c.found)
"""


def _djoin(e: str) -> str:
    return f"(CASE WHEN {e} IS NULL OR array_to_string({e}, ', ') = '' THEN '' ELSE array_to_string({e}, ', ') END)"


DUCK_LOOKUP = f"""
, {_LOOKUP_CTE.strip()}
SELECT lookup_key, c.found AS found, c.website AS website, array_to_string(list_sort(c.emails), ', ') AS emails,
  array_to_string(list_sort(c.phones), ', ') AS phones, c.summary AS summary FROM lookup
"""

DUCK_ENRICHED_ROWS = f"""
, {_LOOKUP_CTE.strip()},
er AS (SELECT input_pos, raw, CASE WHEN {D.is_valid_url(D.normalize_url('raw'))} THEN {D.normalize_url('raw')} END AS u
       FROM syn_targets),
er2 AS (SELECT er.*, coalesce(l1.c, l2.c) AS rec FROM er
        LEFT JOIN lookup_found l1 ON l1.lookup_key = {D.clean_url('er.u')}
        LEFT JOIN lookup_found l2 ON l2.lookup_key = er.u)
SELECT CAST(input_pos AS BIGINT) AS input_pos, raw,
  coalesce({_djoin('rec.emails')}, '') AS email, coalesce({_djoin('rec.phones')}, '') AS phone,
  CASE WHEN rec IS NOT NULL THEN {D.strip("coalesce(rec.summary, '')")} ELSE '' END AS summary
FROM er2
"""

DUCK_ENRICHED_URLS = f"""
, {_LOOKUP_CTE.strip()},
eu AS (SELECT url, min(input_pos) AS input_pos FROM targets GROUP BY url),
eu2 AS (SELECT eu.*, coalesce(l1.c, l2.c) AS rec FROM eu
        LEFT JOIN lookup_found l1 ON l1.lookup_key = {D.clean_url('eu.url')}
        LEFT JOIN lookup_found l2 ON l2.lookup_key = eu.url)
SELECT input_pos, CASE WHEN rec.website IS NULL OR rec.website = '' THEN url ELSE rec.website END AS website,
  coalesce({_djoin('rec.emails')}, '') AS email, coalesce({_djoin('rec.phones')}, '') AS phone,
  coalesce({D.strip("coalesce(rec.summary, '')")}, '') AS summary
FROM eu2
"""

_DEDUP = f"""(SELECT list_sort(list(p)) FROM (
  SELECT min(n) AS p FROM (SELECT {D.normalize_phone('ph')} AS n FROM (SELECT unnest(c.phones) AS ph))
  WHERE {D.digits_only('n')} <> '' GROUP BY {D.digits_only('n')}))"""

DUCK_EXPORT = f"""
SELECT t.input_pos, c.website,
  CASE WHEN len(c.emails) = 0 THEN '{P.EMPTY_EXPORT}' ELSE array_to_string(list_sort(c.emails), ', ') END AS email,
  coalesce(CASE WHEN len({_DEDUP}) = 0 THEN NULL ELSE array_to_string({_DEDUP}, ', ') END, '{P.EMPTY_EXPORT}') AS phone,
  c.summary
FROM targets t JOIN contacts c ON c.url = t.url
"""

_STAGE_IDX = "CASE stage " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(STAGE_ORDER)) + " END"

_AUDIT_CTE = f"""
, vals AS (
  SELECT DISTINCT url, source, kind, value FROM (
    SELECT url, role AS source, kind, value FROM site_cands
    UNION ALL SELECT p.url, 'ai', 'email', unnest(a.ai_emails) FROM primary_page p JOIN ai a ON a.url = p.primary_url
    UNION ALL SELECT p.url, 'ai', 'phone', unnest(a.ai_phones) FROM primary_page p JOIN ai a ON a.url = p.primary_url
    UNION ALL SELECT url, stage, 'phone', unnest(phones) FROM chain
    UNION ALL SELECT url, stage, 'email', unnest(emails) FROM chain
    UNION ALL SELECT url, 'snippets', 'email', unnest(emails) FROM snippets
    UNION ALL SELECT url, 'snippets', 'phone', unnest(phones) FROM snippets)),
found AS (SELECT url, source, kind, count(*) AS n FROM vals GROUP BY ALL),
reach AS (SELECT n.url, coalesce({_STAGE_IDX.replace('stage', 's.stage', 1)}, {len(STAGE_ORDER) - 1}) AS last
          FROM need n LEFT JOIN chain s ON s.url = n.url),
tried AS (
  SELECT url, 'landing' AS source FROM land WHERE landing_id IS NOT NULL
  UNION SELECT DISTINCT url, 'contact' FROM subs
  UNION SELECT url, 'ai' FROM primary_page
  UNION SELECT url, 'snippets' FROM land WHERE landing_id IS NULL
  UNION SELECT url, unnest({D.str_list(STAGE_ORDER)}[1:last + 1]) FROM reach),
audit AS (
  SELECT t.url, t.source, k.kind, CAST(coalesce(f.n, 0) AS BIGINT) AS n
  FROM tried t CROSS JOIN (VALUES ('email'), ('phone')) k(kind)
  LEFT JOIN found f ON f.url = t.url AND f.source = t.source AND f.kind = k.kind)
"""

DUCK_AUDIT = _AUDIT_CTE + "SELECT url, source, kind, n FROM audit"

DUCK_ROLLUP = _AUDIT_CTE + """
SELECT source, kind, CAST(sum(n) AS BIGINT) AS "values",
  CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_sites
FROM audit GROUP BY ROLLUP (source, kind)"""

DUCK_COUNTS = """
SELECT CAST(count(*) AS BIGINT) AS results, CAST(sum(len(emails)) AS BIGINT) AS emails,
  CAST(sum(len(phones)) AS BIGINT) AS phones FROM contacts"""
