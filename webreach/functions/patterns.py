"""Fixed values and shared regular-expression text.

Every pattern here is written so that the *same text* means the same thing
in Spark (java.util.regex) and DuckDB (RE2), and matches what Python's
Unicode-aware ``re`` would match:

* digits are ``\\p{Nd}`` (Python ``\\d`` is Unicode; Java/RE2 ``\\d`` is ASCII);
* whitespace is the explicit class ``WS`` below (Python ``\\s`` is Unicode;
  Java/RE2 ``\\s`` is ASCII and RE2's even lacks U+000B);
* ``.`` is written ``[^\\n]`` where line breaks matter (Java's ``.`` also
  stops at U+0085/U+2028/U+2029, Python's and RE2's do not);
* no look-around, no ``(?U)`` (Unicode in Java, *ungreedy* in RE2).
"""

from html.entities import html5 as _html5

# ---------------------------------------------------------------------------
# FIXED VALUES: these must equal the behaviour being reproduced, so they are
# stated plainly and in their natural order.
# ---------------------------------------------------------------------------

# Python's str.isspace() set, as a character-class body.
WS = (r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")

# The same set as characters.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# E-mail address (ASCII only, case-sensitive).
EMAIL_LOCAL = r"[A-Za-z0-9._%+-]+"
EMAIL_DOMAIN = r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL = EMAIL_LOCAL + "@" + EMAIL_DOMAIN

# Phone patterns. Of the five original patterns only three yield whole
# matches; the other two return a <= 3 digit capture group that the 7-digit
# rule always removes, so they contribute nothing and are not evaluated.
_SEP = r"[-." + WS + r"]?"
_N = r"\p{Nd}"
PHONE_A = _N + "{2,3}" + _SEP + _N + "{3}" + _SEP + _N + "{4}"
PHONE_B = (r"(?:" + _N + r"{2,3}|\(" + _N + r"{2,3}\))?" + _SEP
           + _N + "{3,4}" + _SEP + _N + "{4}")
PHONE_C = _N + "{4}" + _SEP + _N + "{3}" + _SEP + _N + "{3}"
PHONE_PATTERNS = (PHONE_A, PHONE_B, PHONE_C)
# Every phone pattern contains three digits, an optional separator and three
# more digits (A: the middle and last groups, B: the last two groups, C: the
# last two groups): a text without this shape has no phone match.
PHONE_GUARD = _N + "{3}" + _SEP + _N + "{3}"

# Minimum number of digits for a phone candidate.
MIN_PHONE_DIGITS = 7

# A run of phone characters from its first digit on, with the character before
# it (Spark only). Every phone match has seven digits or more, one character at
# most before its first digit and phone characters only, so it stands in such a run.
PHONE_RUN = r"(?s).?" + _N + r"[\p{Nd}().\-" + WS + r"]{6,}+"

# What every phone match contains: seven digits with phone characters between them
# at most. Cheaper to look for than a run: most characters are tried once.
PHONE_DIGITS = _N + r"(?:[().\-" + WS + r"]*+" + _N + r"){6}"

# URL validity: lower-case http/https, a first host char that is not
# whitespace or one of / $ . ? #, then at least one more char.
VALID_URL = r"^https?://[^" + WS + r"/$.?#][^\n]"

# URL scheme (RFC 3986 rule as applied by the standard URL parser).
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"

# Links that point at a dedicated contact page, by path (case-insensitive).
CONTACT_HREF = (r"(?i)/(contact[-_]?us?|pages/contact|reach[-_]?us?|get[-_]in[-_]touch"
                r"|reach[-_]out|write[-_]to[-_]us|about/contact|help/contact"
                r"|support/contact|enquir|inquiry|enquiry)")

# Links that point at a contact page, by visible text (case-insensitive).
CONTACT_TEXT = (r"(?i)\b(contact|reach us|get in touch|reach out|write to us"
                r"|email us|call us|enquir|inquiry)\b")

# Facebook links ("." is any character, as in the original pattern).
FACEBOOK = r"(?i)facebook.com"

# Tracking query parameters removed by clean_url (compared lower-cased).
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "srsltid", "fbclid", "gclid", "gad_source", "msclkid", "twclid",
    "igshid", "ref", "source", "_ga", "mc_eid",
)

# Header names recognised as the URL column of an uploaded table.
URL_COLUMN_NAMES = ("website", "url", "site", "domain", "link", "website_url")

# JSON-LD keys (compared lower-cased).
JSONLD_EMAIL_KEYS = ("email", "e-mail")
JSONLD_PHONE_KEYS = ("telephone", "phone", "faxnumber")

# Schemes for which relative links are resolved against the base.
USES_RELATIVE = ("", "ftp", "http", "gopher", "nntp", "imap", "wais", "file",
                 "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu",
                 "sftp", "svn", "svn+ssh", "ws", "wss")

# Limits.
EXTRACTION_TEXT_CHARS = 5000   # text handed to the external extractor
SEARCH_HITS = 5                # hits per fallback search
SNIPPET_HITS = 12              # hits used for snippet extraction

# Search query suffixes.
MAPS_QUERY_SUFFIX = " site:maps.google.com phone number"
YELP_QUERY_SUFFIX = " site:yelp.com phone number"
WEB_QUERY_SUFFIX = " phone number"
SNIPPET_QUERY_SUFFIX = " contact email phone"

# Defaults.
UNKNOWN_COMPANY = "Unknown"
SNIPPET_SUMMARY = "Contact info from search results (site was blocked or unreachable)."
EMPTY_EXPORT = "None"          # batch export: empty list -> literal None
EMPTY_CELL = "—"          # UI: empty cell -> em dash

# Named character references that are decoded, by rule: those of the standard's
# table that stand for Latin-1 characters or white space (addresses and numbers
# are written in these), and the typographic ones below.
_TYPOGRAPHIC = ("trade;", "ndash;", "mdash;", "hellip;", "euro;", "bull;", "lsquo;", "rsquo;", "ldquo;", "rdquo;")
HTML_ENTITIES = {name[:-1]: text for name, text in sorted(_html5.items()) if name.endswith(";")
                 and (name in _TYPOGRAPHIC or text.isspace() or all(ord(c) < 256 for c in text))}
# Numeric references to these code points: 0x80..0x9F mean Windows-1252, control
# characters and non-characters mean nothing, all that is no character is U+FFFD.
CP1252 = tuple(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
REPLACEMENT = "\uFFFD"

# Plausibility deny-lists (deterministic form of the prose rules).
DENY_EMAIL_DOMAINS = ("example.com", "example.org", "example.net", "domain.com",
                      "email.com", "yourdomain.com", "sentry.io", "w3.org",
                      "schema.org")
DENY_EMAIL_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".css", ".js")
DENY_EMAIL_MAILBOXES = ("your", "yourname", "youremail", "name", "username", "email", "example")
