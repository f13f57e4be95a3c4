"""Synthetic sites derived from ``customer`` (one site per customer key).

The crawled ``pages`` table has no contact markup, so the channel, join and
fallback operators are exercised on sites generated from ``customer`` rows.
Each table is one SQL text that runs unchanged in Spark SQL and DuckDB
(only ``||``, ``CAST .. AS STRING``, ``lpad``, ``CASE``, ``%``), so both
engines see byte-identical input, and it grows with ``customer``.

With k = c_custkey, site = https://site<k>.test:

* targets: every k; no scheme and padded with spaces when k%5=0; ftp (invalid)
  when k%23=0; '/?utm_source=feed' when k%7=0; listed twice when k%50=0.
* landing page missing when k%11=0 (unreachable -> search snippets).
* landing: text e-mail k%2=0; mailto k%3=0; protected e-mail k%4=0; JSON-LD
  k%5=0, malformed JSON-LD k%10=3; text phone by k%9 in {1,4,7}; contact
  links k%4=1 (by href and by text); Facebook link k%6=0; title unless
  k%13=0; e-mail split by a tag k%17=0.
* contact pages: '/contact-us' missing when k%8=1 so '/team' becomes primary.
* Facebook page has a phone when k%12=0; maps / yelp / web hits rank 1..6,
  pages exist for ranks 1, 2, 6; rank 2 has a phone when k%4 is 0 / 2 / 3;
  rank 6 (cut by top-5) always has one.
* search snippets: 14 hits per unreachable site, the 13th (cut) has a phone.
* ai_contacts by k%3 (and k%6=4), ai_decisions by k%4; two replies for one
  page when k%36=1 / k%36=2; an empty decision when k%40=5.
* hits of equal rank when k%14=1. Landing pages redirect when k%19=3 and are
  missing by status when k%19=5.
* hostile markup: references by name and number, references to no character,
  JSON-LD 20 levels deep, with NaN and inside a comment, an anchor that is not
  closed, '>' inside an attribute.

The given ``pages`` are crawled pages too, and each of their URLs is a target.
"""

from __future__ import annotations

K = "c_custkey"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _pad(expr: str, n: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {n}, '0')"


def _per_rank(select_sql: str, ranks, where: str = "") -> str:
    """Rows of ``customer`` times ``ranks`` through a per-row generator (no
    join). The generator is the one dialect-specific piece of text, filled in
    by ``for_dialect``."""
    cond = f" WHERE {where}" if where else ""
    token = "__RANKS_" + "_".join(str(r) for r in ranks) + "__"
    return select_sql.replace("{r}", "r") + f" FROM {token}{cond}"


def _ranks_source(ranks, dialect: str) -> str:
    values = ", ".join(str(r) for r in ranks)
    if dialect == "spark":
        return f"(SELECT *, explode(array({values})) AS r FROM customer) ranked"
    return f"(SELECT *, unnest([{values}]) AS r FROM customer) ranked"


def for_dialect(sql: str, dialect: str) -> str:
    """Replace rank-generator tokens with Spark or DuckDB text."""
    import re as _re
    return _re.sub(r"__RANKS_([0-9_]+)__",
                   lambda m: _ranks_source([int(x) for x in m.group(1).split("_")], dialect), sql)


KS = _s(K)
SITE = f"'https://site' || {KS} || '.test'"
COMPANY = f"CASE WHEN {K} % 13 = 0 THEN 'Unknown' ELSE 'Site ' || {KS} || ' & Co' END"
P4 = _pad(f"{K} % 10000", 4)
P3 = _pad(f"{K} % 1000", 3)

# protected-address test values
CF_INFO = "5a33343c351a3b39373f742e3f292e"          # info@acme.test
CF_SALES = "1764767b726457607e73707263643963726463"  # sales@widgets.test
CF_NOT_EMAIL = "ff91908bd29e91d29a929e9693"          # not-an-email

SYN_TARGETS = f"""
SELECT {K} * 2 AS input_pos,
  CASE WHEN {K} % 5 = 0 THEN ' ' ELSE '' END
  || CASE WHEN {K} % 23 = 0 THEN 'ftp://' WHEN {K} % 5 = 0 THEN '' ELSE 'https://' END
  || 'site' || {KS} || '.test'
  || CASE WHEN {K} % 7 = 0 THEN '/?utm_source=feed' ELSE '' END
  || CASE WHEN {K} % 5 = 0 THEN ' ' ELSE '' END AS raw
FROM customer
UNION ALL
SELECT {K} * 2 + 1 AS input_pos, 'https://site' || {KS} || '.test' AS raw
FROM customer WHERE {K} % 50 = 0
UNION ALL
SELECT page_id * 2 + 1000000000 AS input_pos, url AS raw FROM pages
"""

_DEEP = "'" + '{"a":[' * 10 + '{"email":"deep' + f"' || {KS} || '@site' || {KS} || '" + '.test"}' + ']}' * 10 + "'"

_LANDING_HTML = f"""
'<!DOCTYPE html><html><head><meta charset="utf-8">'
|| CASE WHEN {K} % 13 = 0 THEN '' ELSE '<title> Site ' || {KS} || ' &amp; Co </title>' END
|| CASE WHEN {K} % 5 = 0 THEN '<script type="application/ld+json">{{"@context":"https://schema.org","@graph":[{{"@type":"Organization","name":"Site '
     || {KS} || '","email":"ld' || {KS} || '@site' || {KS} || '.test","contactPoint":{{"telephone":"+94 11 ' || {P3} || ' ' || {P4}
     || '","email":["list' || {KS} || '@site' || {KS} || '.test"]}}}}]}}</script>'
   WHEN {K} % 10 = 3 THEN '<script type="application/ld+json">{{bad "email": "broken' || {KS} || '@site' || {KS} || '.test"</script>'
   ELSE '' END
|| '<script>var t="</p>";track(' || {KS} || ');</script><style>p{{margin:0}}</style></head><body><nav>'
|| '<a href="/">Home</a> <a href="#top">Top</a> <a href="/products?id=' || {KS} || '&amp;ref=nav">Products</a>'
|| CASE WHEN {K} % 4 = 1 THEN ' <a href="/contact-us">Reach the team</a> <a href=''/team/''>Contact</a> <a href="/enquiry-form">Enquiry</a>' ELSE '' END
|| CASE WHEN {K} % 6 = 0 THEN ' <a class="social" href="https://www.facebook.com/site' || {KS} || '">Facebook</a>' ELSE '' END
|| '</nav><!-- call 011 999 9999 --><main><h1>Site ' || {KS} || '</h1><p>Welcome to site ' || {KS} || '.</p>'
|| CASE WHEN {K} % 2 = 0 THEN '<p>Write to info' || {KS} || '@mail' || CAST({K} % 5 AS STRING) || '.example.com today.</p>' ELSE '' END
|| CASE WHEN {K} % 3 = 0 THEN '<p><a href="mailto:sales' || {KS} || '@site' || {KS} || '.test?subject=Hi">Mail us</a></p>' ELSE '' END
|| CASE WHEN {K} % 4 = 0 THEN '<p><a href="/cdn-cgi/l/email-protection" data-cfemail="'
     || CASE WHEN {K} % 8 = 0 THEN '{CF_INFO}' ELSE '{CF_SALES}' END || '">[email&#160;protected]</a></p>' ELSE '' END
|| CASE WHEN {K} % 12 = 0 THEN '<p><a data-cfemail="{CF_NOT_EMAIL}">x</a></p>' ELSE '' END
|| CASE WHEN {K} % 4 = 2 THEN '<p><span data-cfemail="{CF_INFO}">[hidden]</span></p>' ELSE '' END
|| CASE WHEN {K} % 9 = 1 THEN '<p>Hotline 011 257' || {P4} || ' now</p>'
   WHEN {K} % 9 = 4 THEN '<p>Tel: (03) 9563 ' || {P4} || '</p>'
   WHEN {K} % 9 = 7 THEN '<p>Mobile +94 77 748 ' || {P4} || '</p>'
   ELSE '' END
|| CASE WHEN {K} % 17 = 0 THEN '<p><b>info</b>@site' || {KS} || '.test</p>' ELSE '' END
|| CASE WHEN {K} % 10 = 1 THEN '<p>named' || {KS} || '&commat;mail.example.com number' || {KS} || '&#00000064;mail.example.com hex' || {KS}
     || '&#x000000040;mail.example.com bad &#9999999; &#xD800; &#0; &#x80; &bogus; &#99999999999999999999;</p>' ELSE '' END
|| CASE WHEN {K} % 10 = 2 THEN '<script type="application/ld+json">' || {_DEEP} || '</script>' ELSE '' END
|| CASE WHEN {K} % 10 = 4 THEN '<script type="application/ld+json">{{"v":[NaN,-Infinity],"w":Infinity,"telephone":"011 555 ' || {P4} || '"}}</script>' ELSE '' END
|| CASE WHEN {K} % 10 = 6 THEN '<script type="application/ld+json"><!-- {{"email":"wrapped' || {KS} || '@site' || {KS} || '.test"}} --></script>'
     || '<!-- <script type="application/ld+json">{{"email":"dead' || {KS} || '@site' || {KS} || '.test"}}</script> -->' ELSE '' END
|| CASE WHEN {K} % 8 = 1 THEN '<p><a href="/blog">Blog <a title="a > b" href="/write-to-us">Letters</a></p>' ELSE '' END
|| '</main><footer>&copy; 2024 Site ' || {KS} || ' &middot; v1.2.3 &middot; order 2024-01-01</footer></body></html>'
"""

_CONTACT_US_HTML = f"""
'<html><head><title>Contact us</title></head><body><h1>Contact</h1><p>Email: hello' || {KS} || '@site' || {KS}
|| '.test</p><p>Phone: 077 748 ' || {P4} || '</p><p><a href="mailto:desk' || {KS} || '@site' || {KS} || '.test">desk</a></p></body></html>'
"""

_TEAM_HTML = f"""
'<html><head><title>Team</title>'
|| CASE WHEN {K} % 3 = 0 THEN '<script type="application/ld+json">[{{"E-Mail":" team' || {KS} || '@site' || {KS} || '.test ","faxNumber":"12"}}]</script>' ELSE '' END
|| '</head><body><p>Team line 1300 123 ' || {P3} || '</p></body></html>'
"""

_FB_HTML = f"""
'<html><head><title>Facebook</title></head><body><div>Phone</div>'
|| CASE WHEN {K} % 12 = 0 THEN '<span>+1 212</span><span>-555-' || {P4} || '</span>' ELSE '<span>No phone listed</span>' END
|| '</body></html>'
"""


def _hit_html(label: str, has_phone: str) -> str:
    return (f"'<html><head><title>{label} ' || {KS} || '</title></head><body><div>{label} listing</div>'"
            f" || CASE WHEN {has_phone} THEN '<div>Phone</div><div>(02) 8' || {P3} || ' ' || {P4} || '</div>' "
            f"ELSE '<div>Opening hours only</div>' END || '</body></html>'")


def _web_html(has_phone: str) -> str:
    return (f"'<html><head><title>Directory ' || {KS} || '</title></head><body><p>Listing</p>'"
            f" || CASE WHEN {has_phone} THEN '<div data-tel=\"0112574' || {P3} || '\"></div><!-- dir' || {KS} "
            f"|| '@directory.test --><p>See website</p>' ELSE '<p>No details</p>' END || '</body></html>'")


_SITE_PAGES = f"""
SELECT {K} * 100 AS page_id,
  {SITE} || CASE WHEN {K} % 9 = 2 THEN '/?ref=home' ELSE '/' END AS url,
  {_LANDING_HTML} AS html
FROM customer WHERE {K} % 11 <> 0
UNION ALL
SELECT {K} * 100 + 1, {SITE} || '/contact-us', {_CONTACT_US_HTML}
FROM customer WHERE {K} % 11 <> 0 AND {K} % 8 = 5
UNION ALL
SELECT {K} * 100 + 2, {SITE} || '/team', {_TEAM_HTML}
FROM customer WHERE {K} % 11 <> 0 AND {K} % 4 = 1
UNION ALL
SELECT {K} * 100 + 3, 'https://www.facebook.com/site' || {KS}, {_FB_HTML}
FROM customer WHERE {K} % 6 = 0
UNION ALL
""" + _per_rank(
    f"SELECT {K} * 100 + 10 + {{r}} AS page_id, 'https://maps.google.com/?cid=' || {KS} || CAST({{r}} AS STRING) AS url, "
    f"{_hit_html('Maps', f'({{r}} = 2 AND {K} % 4 = 0) OR {{r}} = 6')} AS html", (1, 2, 6)) + """
UNION ALL
""" + _per_rank(
    f"SELECT {K} * 100 + 20 + {{r}}, 'https://www.yelp.com/biz/site' || {KS} || '-' || CAST({{r}} AS STRING), "
    f"{_hit_html('Yelp', f'({{r}} = 2 AND {K} % 4 = 2) OR {{r}} = 6')}", (1, 2, 6)) + """
UNION ALL
""" + _per_rank(
    f"SELECT {K} * 100 + 30 + {{r}}, 'https://dir' || {KS} || '.test/listing/' || CAST({{r}} AS STRING), "
    f"{_web_html(f'({{r}} = 2 AND {K} % 4 = 3) OR {{r}} = 6')}", (1, 2, 6))

SYN_PAGES = f"""
SELECT page_id, url,
  CASE WHEN page_id % 1900 = 300 THEN replace(url, 'https://site', 'https://www.site') || 'home' END AS final_url,
  CASE WHEN page_id % 1900 = 500 THEN 404 ELSE 200 END AS status, html
FROM ({_SITE_PAGES}) site_pages
UNION ALL
SELECT page_id + 1000000000 AS page_id, url, CAST(NULL AS STRING) AS final_url, CAST(NULL AS INT) AS status, html FROM pages
"""

_SNIPPET_BODY = (f"CASE WHEN {K} % 22 = 0 THEN 'Nothing useful here'"
                 f" WHEN {{r}} = 3 THEN 'Email us at desk' || {KS} || '@site' || {KS} || '.test today'"
                 f" WHEN {{r}} = 5 THEN 'Call 011 2574 ' || {P3} || ' or visit'"
                 f" WHEN {{r}} = 13 THEN 'Old number (03) 9999 ' || {P4}"
                 f" ELSE 'Opening hours' END")

SEARCH_RESULTS = "\nUNION ALL\n".join([
    _per_rank(f"SELECT {COMPANY} || ' site:maps.google.com phone number' AS query, {{r}} AS rank, "
              f"'https://maps.google.com/?cid=' || {KS} || CAST({{r}} AS STRING) AS href, "
              f"'Maps result ' || CAST({{r}} AS STRING) AS title, "
              f"'Map listing' AS body", range(1, 7), f"{K} % 13 <> 0"),
    _per_rank(f"SELECT {COMPANY} || ' site:yelp.com phone number', {{r}}, "
              f"'https://www.yelp.com/biz/site' || {KS} || '-' || CAST({{r}} AS STRING), "
              f"'Yelp result ' || CAST({{r}} AS STRING), 'Reviews'",
              range(1, 7), f"{K} % 13 <> 0"),
    _per_rank(f"SELECT {COMPANY} || ' phone number', {{r}}, 'https://dir' || {KS} || '.test/listing/' || CAST({{r}} AS STRING), "
              f"'Directory ' || CAST({{r}} AS STRING), 'Directory entry'", range(1, 7), f"{K} % 13 <> 0"),
    f"SELECT {COMPANY} || ' phone number', 2, 'https://dir' || {KS} || '.test/listing/6', 'Directory 2', 'Directory entry' FROM customer WHERE {K} % 13 <> 0 AND {K} % 14 = 1",
    _per_rank(f"SELECT 'site' || {KS} || '.test contact email phone', {{r}}, "
              f"'https://snip.test/' || {KS} || '/' || CAST({{r}} AS STRING), 'Site ' || {KS} || ' result ' || CAST({{r}} AS STRING), {_SNIPPET_BODY}",
              range(1, 15), f"{K} % 11 = 0"),
])

AI_CONTACTS = f"""
SELECT CASE WHEN {K} % 8 = 5 THEN {SITE} || '/contact-us' ELSE {SITE} || '/' END AS url,
  CASE WHEN {K} % 3 = 0 THEN 'Here you go: {{"emails": ["ai' || {KS} || '@site' || {KS} || '.test", " "], "phones": [" 077 748 ' || {P4}
         || ' "], "summary": "Site ' || {KS} || ' sells goods."}} Thanks!'
       WHEN {K} % 6 = 4 THEN 'Result: {{not json at all}}'
       ELSE 'Sorry, I could not read {{this page' END AS raw
FROM customer WHERE {K} % 3 <> 2 AND {K} % 11 <> 0
UNION ALL
SELECT {SITE} || '/', 'Or: {{"emails": ["second' || {KS} || '@site' || {KS} || '.test"], "phones": [], "summary": "Second reply."}}'
FROM customer WHERE {K} % 36 = 1 OR {K} % 36 = 3
"""

AI_DECISIONS = f"""
SELECT {SITE} || '/' AS site,
  CASE WHEN {K} % 4 = 0 THEN 'Kept: {{"emails": ["info' || {KS} || '@mail' || CAST({K} % 5 AS STRING)
         || '.example.com", "ghost@nowhere.test"], "phones": []}}'
       WHEN {K} % 4 = 1 THEN '{{"emails": []}}'
       ELSE 'I cannot decide.' END AS raw
FROM customer WHERE {K} % 4 <> 3 AND {K} % 11 <> 0 AND {K} % 40 <> 5
UNION ALL
SELECT {SITE} || '/', CASE WHEN {K} % 80 = 5 THEN '  ' END FROM customer WHERE {K} % 40 = 5
UNION ALL
SELECT {SITE} || '/', 'Again: {{"phones": ["none"]}}' FROM customer WHERE {K} % 36 = 2 OR {K} % 36 = 4
"""

SYNTH_TABLES = {
    "syn_targets": SYN_TARGETS,
    "syn_pages": SYN_PAGES,
    "search_results": SEARCH_RESULTS,
    "ai_contacts": AI_CONTACTS,
    "ai_decisions": AI_DECISIONS,
}


def cte_prefix(names=None) -> str:
    """'WITH a AS (...), b AS (...)' for the DuckDB twins."""
    names = names or list(SYNTH_TABLES)
    return "WITH " + ",\n".join(f"{n} AS ({for_dialect(SYNTH_TABLES[n], 'duckdb')})" for n in names)


def register(spark, customer_df, pages_df, suffix: str) -> dict:
    """The tables as DataFrames derived from ``customer`` and ``pages``."""
    views = {"customer": customer_df, "pages": pages_df}
    for name, df in views.items():
        df.createOrReplaceTempView(f"webreach_{name}_{suffix}")
    out = {}
    for table, sql in SYNTH_TABLES.items():
        sql = for_dialect(sql, "spark")
        for name in views:
            sql = sql.replace(f"FROM {name}", f"FROM webreach_{name}_{suffix}")
        out[table] = spark.sql(sql)
    return out
