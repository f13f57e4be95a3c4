"""Plausibility predicates (O-E1, O-E2).

The original leaves these decisions to a language model guided by prose
rules; here they are deterministic column predicates, with a DuckDB twin
each. Rules:

e-mail: the domain is not a placeholder/example/schema domain nor below one,
the address is not a file name, not an escaped-HTML fragment and not a
placeholder mailbox (operators/deny.py takes such rules as a table).
phone: at least 6 digits, and not a version string, a year, a date or a
zip code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webreach.functions import patterns as P
from webreach.functions.extract import digits_only
from webreach.functions.urls import col, py_strip

# fixed rule text shared by both engines
PLACEHOLDER_LOCAL = "^(" + "|".join(P.DENY_EMAIL_MAILBOXES) + ")$"
DENIED_DOMAIN = r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in P.DENY_EMAIL_DOMAINS) + ")$"
ESCAPED_LOCAL = r"^(u00[0-9a-f]{2}|x[0-9a-f]{2})"
FILE_SUFFIX = r"\.(" + "|".join(s.lstrip(".") for s in P.DENY_EMAIL_SUFFIXES) + r")$"
VERSION = r"^v?[0-9]+(\.[0-9]+){2,}$"
YEAR = r"^(19|20)[0-9]{2}$"
DATE = r"^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})$"
ZIP = r"^[0-9]{5}(-[0-9]{4})?$"
MIN_PLAUSIBLE_DIGITS = 6


def plausible_email(c) -> Column:
    v = F.lower(py_strip(col(c)))
    local = F.substring_index(v, "@", 1)
    domain = F.substring_index(v, "@", -1)
    return ~(domain.rlike(DENIED_DOMAIN) | v.rlike(FILE_SUFFIX) | local.rlike(ESCAPED_LOCAL)
             | local.rlike(PLACEHOLDER_LOCAL))


def plausible_phone(c) -> Column:
    v = py_strip(col(c))
    return ((F.length(digits_only(v)) >= MIN_PLAUSIBLE_DIGITS)
            & ~v.rlike(VERSION) & ~v.rlike(YEAR) & ~v.rlike(DATE) & ~v.rlike(ZIP))


def duck_plausible_email(e: str) -> str:
    from webreach.plans import duck as D
    v = f"lower({D.strip(e)})"
    local = f"split_part({v}, '@', 1)"
    domain = f"reverse(split_part(reverse({v}), '@', 1))"
    return (f"NOT ({D.rlike(domain, DENIED_DOMAIN)} OR {D.rlike(v, FILE_SUFFIX)}"
            f" OR {D.rlike(local, ESCAPED_LOCAL)} OR {D.rlike(local, PLACEHOLDER_LOCAL)})")


def duck_plausible_phone(e: str) -> str:
    from webreach.plans import duck as D
    v = D.strip(e)
    return (f"(length({D.digits_only(v)}) >= {MIN_PLAUSIBLE_DIGITS} AND NOT {D.rlike(v, VERSION)}"
            f" AND NOT {D.rlike(v, YEAR)} AND NOT {D.rlike(v, DATE)} AND NOT {D.rlike(v, ZIP)})")
