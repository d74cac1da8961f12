"""SQL that the engine's queries are compared with, written for DuckDB and apart from the engine's own objects.

RE2 has no lookaround and no references, but its word boundary is the ASCII one. Rules without a check on the match are
plain extractions; places come from the lengths of the pieces between matches. The others take the candidate at each
start, keep the valid ones, and fold over them. Overlaps are resolved by one more fold over a list of all findings.
"""

from __future__ import annotations

from dataclasses import dataclass

# Position, name, priority, label, prefix, on by default, group, search by, singular, plural.
REGISTRY = (
    (1, "manual", -10, "REDACTED", "REDACTED", True, "other", "literal", "Marked by you", "Marked by you"),
    (2, "email", 1, "EMAIL", "EMAIL", True, "contact", "literal", "Email address", "Email addresses"),
    (3, "url", 2, "URL", "URL", False, "contact", "literal", "Web address", "Web addresses"),
    (4, "secret", 0, "SECRET", "SECRET", True, "identifier", "literal", "API key or credential", "API keys and credentials"),
    (5, "iban", 3, "IBAN", "IBAN", True, "financial", "literal", "Bank account (IBAN)", "Bank accounts (IBAN)"),
    (6, "ssn", 5, "SSN", "SSN", True, "identifier", "digits", "Social Security Number", "Social Security Numbers"),
    (7, "creditCard", 4, "CARD", "CARD", True, "financial", "digits", "Credit card number", "Credit card numbers"),
    (8, "date", 10, "DATE", "DATE", True, "other", "literal", "Date", "Dates"),
    (9, "phone", 13, "PHONE", "PHONE", True, "contact", "digits", "Phone number", "Phone numbers"),
    (10, "nationalId", 7, "ID", "ID", True, "identifier", "digits", "National ID number", "National ID numbers"),
    (11, "routingNumber", 6, "ROUTING", "ROUTING", True, "financial", "digits", "Bank routing number", "Bank routing numbers"),
    (12, "macAddress", 8, "MAC", "MAC", True, "identifier", "literal", "MAC address", "MAC addresses"),
    (13, "ipAddress", 9, "IP", "IP", True, "identifier", "literal", "IP address", "IP addresses"),
    (14, "passport", 11, "PASSPORT", "PASSPORT", True, "identifier", "literal", "Passport number", "Passport numbers"),
    (15, "driversLicence", 12, "LICENCE", "LICENCE", True, "identifier", "literal", "Driving licence number", "Driving licence numbers"),
    (16, "postalCode", 15, "POSTCODE", "POSTCODE", False, "location", "literal", "Postal code", "Postal codes"),
    (17, "accountNumber", 14, "NUMBER", "NUMBER", True, "financial", "digits", "Long number (account, reference)", "Long numbers (account, reference)"),
    (18, "age", 16, "AGE", "AGE", True, "other", "digits", "Age", "Ages"),
    (19, "person", 17, "NAME", "PERSON", True, "other", "literal", "Name", "Names"),
    (20, "place", 18, "ADDRESS", "PLACE", True, "location", "literal", "Address", "Addresses"),
)

_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
_SHAPES = r"NOT regexp_matches(m, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND NOT regexp_matches(m, '^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$')"
LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN k % 2 = 0 THEN (CAST(substr(d, length(d) - k + 1, 1) AS INT) * 2) % 10 + (CAST(substr(d, length(d) - k + 1, 1) AS INT) * 2) // 10 ELSE CAST(substr(d, length(d) - k + 1, 1) AS INT) END)) % 10 = 0"
IL_ID = "list_sum(list_transform(range(1, 10), lambda k: (CAST(substr(d, k, 1) AS INT) * (2 - k % 2)) % 10 + (CAST(substr(d, k, 1) AS INT) * (2 - k % 2)) // 10)) % 10 = 0"
ABA = "(3 * (CAST(substr(f, 1, 1) AS INT) + CAST(substr(f, 4, 1) AS INT) + CAST(substr(f, 7, 1) AS INT)) + 7 * (CAST(substr(f, 2, 1) AS INT) + CAST(substr(f, 5, 1) AS INT) + CAST(substr(f, 8, 1) AS INT)) + CAST(substr(f, 3, 1) AS INT) + CAST(substr(f, 6, 1) AS INT) + CAST(substr(f, 9, 1) AS INT)) % 10 = 0"
_MOD97 = "list_reduce(list_transform(string_split(substr(k, 5) || substr(k, 1, 4), ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN CAST(ascii(x) - 48 AS BIGINT) ELSE CAST(ascii(x) - 55 AS BIGINT) END), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END, CAST(0 AS BIGINT)) = 1"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Madam|Mx"
_FIRST = "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Jane|Emma|Olivia|Daniel|Matthew|Anthony|Mark|Paul|Steven|Andrew|Peter|George|Alice|Anna|Laura|Kim|Al|Joe|Kate|Helen|Henry|Oliver|Jack|Lucy|Grace|Martin"
_STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Way"
_PLACES = "New York|Los Angeles|Chicago|Houston|London|Paris|Berlin|Madrid|Rome|Tel Aviv|Jerusalem|Haifa|Boston|Seattle|San Francisco|Washington|Toronto|Montreal|Sydney|Melbourne|Dublin|Manchester|Springfield|California|Texas|Florida|England|Scotland|Ireland|France|Germany|Spain|Italy|Israel|Canada|Australia|America"
_CAPITAL = r"[A-Z][\pL'’-]+"
# An IPv6 candidate: digits and colons; the check wants eight groups, or one gap and at most seven groups.
_IPV6 = "[0-9A-Fa-f:]+"
_IPV6_OK = """(regexp_full_match(m, '(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}') OR (len(string_split(m, '::')) = 2 AND m <> '::'
    AND regexp_full_match(m, '(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?') AND len(list_filter(string_split(m, ':'), lambda x: x <> '')) <= 7))"""


def _q(x: str) -> str:
    return x.replace("'", "''")


@dataclass(frozen=True)
class Take:
    """Every match of a pattern; the finding is the whole of it, or group 1, at its ``tail`` or ``inside``. ``keep``: a
    check on w, the match, and m, the finding."""

    pattern: str
    part: str = "whole"
    keep: str = "TRUE"

    def sql(self, base: str) -> str:
        """(source, key, s, m): findings with their places from 0."""
        p = f"'{_q(self.pattern)}'"
        m = "w" if self.part == "whole" else f"regexp_extract(w, {p}, 1)"
        s = {"whole": "o", "tail": "o + length(w) - length(m)", "inside": "o + strpos(w, m) - 1"}[self.part]
        return f"""SELECT source, key, CAST({s} AS BIGINT) AS s, m FROM (SELECT source, key, w, o, {m} AS m FROM (
          SELECT source, key, ms[j] AS w, list_sum(list_transform(rs[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0) AS o FROM (
            SELECT *, unnest(generate_series(1, len(ms))) AS j FROM (SELECT source, key, regexp_extract_all(text, {p}) AS ms, regexp_split_to_array(text, {p}) AS rs FROM {base} WHERE regexp_matches(text, {p}))))) WHERE {self.keep}"""


@dataclass(frozen=True)
class Fold:
    """Start-enumeration. ``first``: class of a candidate's first character; ``before``: class that may not precede it;
    ``after``: class that may not follow the match; ``valid``: check on m, the match, and d, its digits."""

    first: str
    candidate: str
    gate: str
    before: str
    after: str
    valid: str

    def sql(self, base: str) -> str:
        return f"""SELECT source, key, CAST(f.i - 1 AS BIGINT) AS s, f.m AS m FROM (SELECT source, key, unnest(z.o) AS f FROM (
          SELECT source, key, list_reduce(list_transform(list({{'i': i, 'm': m}} ORDER BY i), lambda x: {{'e': CAST(x.i + length(x.m) AS BIGINT), 'o': [x], 'i': CAST(x.i AS BIGINT)}}),
            lambda a, x: CASE WHEN x.i >= a.e THEN {{'e': x.e, 'o': list_concat(a.o, x.o), 'i': x.i}} ELSE a END) AS z FROM (
            SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM (
              SELECT source, key, i, regexp_extract(substr(text, i), '^({_q(self.candidate)})(?:[^{self.after}]|$)', 1) AS m FROM (
                SELECT source, key, text, unnest(generate_series(1, length(text))) AS i FROM {base} WHERE regexp_matches(text, '{_q(self.gate)}'))
              WHERE regexp_matches(substr(text, i, 1), '[{_q(self.first)}]') AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[{_q(self.before)}]'))) WHERE m <> '')
          WHERE {self.valid} GROUP BY source, key))"""


# The detectors' patterns as RE2 spells them, in the order in which a category's findings are listed.
RULES: dict[str, tuple[Take | Fold, ...]] = {
    "person": (Take(rf"\b(?:(?:{_TITLES})\.?\s+{_CAPITAL}(?:\s+{_CAPITAL}){{0,2}}|(?:{_FIRST})(?:\s+[A-Z]\.)?(?:\s+{_CAPITAL}){{1,2}})"),),
    "place": (Take(rf"\b(?:\d{{1,5}}\s+(?:{_CAPITAL}\s+){{1,3}}(?:{_STREET})\b|(?:{_PLACES})\b)"),),
    "email": (Take(EMAIL),),
    "url": (Take(r"""\b(?:https?://|www\.)[^\s<>()\[\]{}"'“”‘’]+[^\s<>()\[\]{}"'“”‘’.,;:!?]"""),),
    "secret": (
        Take(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"), Take(r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ABIA|ACCA)[A-Z0-9]{16}\b"), Take(r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b"),
        Take(r"\bxox[abpsr]-[A-Za-z0-9-]{10,}\b"), Take(r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}\b"), Take(r"\bAIza[0-9A-Za-z_-]{35}\b"), Take(r"\bsk-(?:ant-)?[A-Za-z0-9_-]{20,}\b"),
        Take(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
        Take(r"""(?i)\b(?:api[_-]?key|apikey|secret|access[_-]?token|auth[_-]?token|bearer|client[_-]?secret|password|passwd|pwd)\b\W{0,6}["']?([A-Za-z0-9_\-./+=]{12,})""", "tail"),
    ),
    "iban": (Fold("A-Z", r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}", "0-9A-Za-z_", "0-9A-Za-z_", f"(SELECT length(k) BETWEEN 15 AND 34 AND {_MOD97} FROM (SELECT replace(m, ' ', '') AS k))"),),
    "ssn": (
        Fold("0-9", r"[0-9]{3}(?: [0-9]{2} |-[0-9]{2}-)[0-9]{4}", r"[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}", "0-9", "0-9", "NOT regexp_matches(d, '^(?:000|666|9)|^...00|0000$')"),
        Take(r"(?i)\b(?:ssn|social\s+security(?:\s+(?:no|number|#))?)\W{0,10}((?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])[ -]?(?:0[1-9]|[1-9][0-9])[ -]?(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3}))\b", "tail"),
    ),
    "creditCard": (Fold("0-9", r"[0-9](?:[ -]?[0-9]){12,18}", r"[0-9](?:[ -]?[0-9]){12}", "0-9A-Za-z_", "0-9A-Za-z_", f"length(d) BETWEEN 13 AND 19 AND {LUHN}"),),
    "date": (
        Take(r"\b\d{4}-\d{2}-\d{2}\b"), Take(r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b"),
        Take(r"(?i)\b(?:" + _MONTHS + r")\.?\s+\d{1,2}(?:st|nd|rd|th)?(?:,?\s+\d{4})?\b"), Take(r"(?i)\b\d{1,2}(?:st|nd|rd|th)?\s+(?:" + _MONTHS + r")\.?(?:,?\s+\d{4})?\b"),
    ),
    "phone": (Fold("0-9+(", r"\+?\(?[0-9]{1,4}\)?(?:[ .\x{00A0}-]?\(?[0-9]{2,4}\)?){1,5}", r"[0-9][ .\x{00A0}()-]*[0-9][0-9]", r"\pL\pN", r"\pL\pN", f"{_SHAPES} AND regexp_matches(m, '[0-9][0-9]') AND length(d) BETWEEN 7 AND 15"),),
    "nationalId": (Fold("0-9", r"[0-9]{9}", r"[0-9]{9}", "0-9", "0-9", IL_ID),),
    "routingNumber": (Take(r"(?i)\b(?:aba|routing|rtn)\b\W{0,20}([0-9]{9})(?:[^0-9]|$)", "inside", ABA.replace("(f,", "(m,")),),
    "macAddress": (Take(r"\b[0-9A-Fa-f]{2}(?:(?::[0-9A-Fa-f]{2}){5}|(?:-[0-9A-Fa-f]{2}){5})\b"),),
    "ipAddress": (Take(r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"), Fold("0-9A-Fa-f:", _IPV6, "::|(?:[0-9A-Fa-f]{1,4}:){2}", "0-9A-Fa-f:", "0-9A-Fa-f:", _IPV6_OK)),
    "passport": (Take(r"(?i)\b(?:passport(?:\s*(?:no|number|nr|#))?)\b\W{0,12}([A-Z0-9]{6,9})\b", "tail"), Take(r"(?m)^[A-Z0-9<]{9}\d[A-Z]{3}\d{6}\d[MF<]\d{6}\d[A-Z0-9<]{14}\d\d$")),
    "driversLicence": (Take(r"(?i)\b(?:driver'?s?\s*(?:licen[cs]e|lic|dl)|licen[cs]e\s*(?:no|number|#))\b\W{0,12}([A-Z0-9][A-Z0-9-]{4,14})\b", "tail"),),
    "postalCode": (
        Fold("0-9", r"[0-9]{5}-[0-9]{4}", r"[0-9]{5}-[0-9]{4}", "0-9", "0-9", "TRUE"), Take(r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"), Take(r"(?i)\b[ABCEGHJ-NPRSTVXY]\d[A-Z]\s?\d[A-Z]\d\b"),
        Take(r"(?i)\b(?:zip(?:\s*code)?|postal\s*code|postcode)\b\W{0,10}(\d{5,7}(?:-\d{4})?)\b", "tail"),
    ),
    "accountNumber": (Fold("0-9", r"[0-9](?:[ -]?[0-9]){8,}", r"[0-9](?:[ -]?[0-9]){8}", "0-9", "0-9", f"{_SHAPES} AND length(d) >= 9"),),
    "age": (
        Take(r"(?i)\b(\d{1,3})[\s-]?years?[\s-]?old\b", "inside"), Take(r"(?i)\b(\d{1,3})\s*y\.?o\.?\b", "inside"),
        Take(r"(?i)\baged?[:\s]+(\d{1,3})\b(?:\s*(?:day|week|month|hour|minute|min|sec|second))?", "inside", "NOT regexp_matches(w, '[a-zA-Z]$')"),
    ),
}


def _found(name: str, base: str) -> str:
    """(source, key, part, s, m) of one category, part by part."""
    return " UNION ALL ".join(f"SELECT source, key, {i} AS part, s, m FROM ({r.sql(base)})" for i, r in enumerate(RULES[name]))


def detector_sql(name: str, texts: str) -> str:
    return f"WITH texts AS ({texts}) SELECT source, key, count(*) AS n, string_agg(m, '|' ORDER BY part, s) AS found FROM ({_found(name, 'texts')}) GROUP BY source, key"


_DOCUMENTS = "SELECT 'documents' AS source, doc_id AS key, text FROM documents"


def _resolved_ctes(*names: str, texts: str = _DOCUMENTS) -> str:
    """CTEs up to ``kept``: (source, key, text, l), the findings of the categories without overlaps, in order."""
    by = {r[1]: r for r in REGISTRY}
    found = " UNION ALL ".join(f"SELECT source, key, '{n}' AS k, {by[n][2]} AS p, {by[n][0]} AS pos, part, s, s + length(m) AS e FROM ({_found(n, 'texts')})" for n in names)
    return rf"""WITH texts AS ({texts}), found AS ({found}),
    folded AS (SELECT source, key, text, list_reduce(l, lambda a, x: CASE WHEN x.e <= a.e THEN a
        WHEN x.s >= a.e THEN {{'k': x.k, 's': x.s, 'e': x.e, 'o': list_append(a.o, {{'k': a.k, 's': a.s, 'e': a.e}})}}
        WHEN a.k = x.k OR regexp_matches(substr(text, a.e, 2), '^[\pL\pN_]{{2}}') THEN {{'k': a.k, 's': a.s, 'e': x.e, 'o': a.o}}
        WHEN NOT regexp_matches(substr(text, a.e + 1, x.e - a.e), '^[\s\pP\pS]*$') THEN {{'k': x.k, 's': a.e, 'e': x.e, 'o': list_append(a.o, {{'k': a.k, 's': a.s, 'e': a.e}})}}
        ELSE a END) AS z FROM (
      SELECT source, key, list({{'k': k, 's': s, 'e': e, 'o': CAST([] AS STRUCT(k VARCHAR, s BIGINT, e BIGINT)[])}} ORDER BY s, p, e DESC, pos, part) AS l FROM found GROUP BY source, key) JOIN texts USING (source, key)),
    kept AS (SELECT source, key, text, list_append(z.o, {{'k': z.k, 's': z.s, 'e': z.e}}) AS l FROM folded)"""


#: What makes two values of a category the same, by category; the others' are lower-case with single spaces.
_KEY = r"""CASE WHEN k IN ('email', 'ipAddress') THEN lower(trim(t)) WHEN k = 'url' THEN rtrim(lower(trim(t)), '/') WHEN k = 'secret' THEN trim(t) WHEN k IN ('iban', 'macAddress') THEN upper(regexp_replace(t, '[^A-Za-z0-9]', '', 'g'))
  WHEN k IN ('ssn', 'creditCard', 'phone', 'nationalId', 'routingNumber', 'accountNumber', 'age') THEN regexp_replace(t, '[^0-9]', '', 'g') WHEN k IN ('passport', 'driversLicence') THEN upper(trim(t)) ELSE regexp_replace(lower(trim(t)), '\s+', ' ', 'g') END"""
_DEFAULT = tuple(r[1] for r in REGISTRY if r[5] and r[1] != "manual")


def redacted_sql(mode: str, columns: str, texts: str = _DOCUMENTS) -> str:
    """The texts redacted with the categories that are on by default; ``columns`` of source, key, total, redacted and
    found."""
    pairs = ", ".join(f"('{r[1]}', '{r[3]}', '{r[4]}')" for r in REGISTRY)
    token = {"redacted": "'[REDACTED]'", "label": "'[' || label || ']'", "pseudonym": "'[' || prefix || '_' || n || ']'"}[mode]
    return f"""{_resolved_ctes(*_DEFAULT, texts=texts)},
    one AS (SELECT source, key, text, j, l[j].k AS k, l[j].s AS s, l[j].e AS e, substr(text, l[j].s + 1, l[j].e - l[j].s) AS t FROM (SELECT *, unnest(generate_series(1, len(l))) AS j FROM kept)),
    numbered AS (SELECT *, dense_rank() OVER (PARTITION BY source, key, k ORDER BY f) AS n, lag(e, 1, 0) OVER (PARTITION BY source, key ORDER BY j) AS after FROM (
      SELECT *, min(j) OVER (PARTITION BY source, key, k, v) AS f FROM (SELECT *, {_KEY} AS v FROM one))),
    done AS (SELECT source, key, count(*) AS total, string_agg(substr(text, after + 1, s - after) || {token}, '' ORDER BY j) || substr(any_value(text), max(e) + 1) AS redacted, string_agg(t, '|' ORDER BY j) AS found
      FROM numbered JOIN (VALUES {pairs}) AS c(k, label, prefix) USING (k) GROUP BY source, key),
    whole AS (SELECT source, key, CAST(coalesce(total, 0) AS BIGINT) AS total, coalesce(redacted, text) AS redacted, coalesce(found, '') AS found FROM texts LEFT JOIN done USING (source, key))
    SELECT {columns} FROM whole"""


def counts_sql() -> str:
    names = ", ".join(f"({r[0]}, '{r[1]}')" for r in REGISTRY)
    return f"""{_resolved_ctes(*_DEFAULT)} SELECT position, category, count(s) AS n_spans FROM (VALUES {names}) AS c(position, category) LEFT JOIN (SELECT unnest(l) AS s FROM kept) ON category = s.k GROUP BY ALL"""


def segments_sql(*names: str) -> str:
    return f"""{_resolved_ctes(*names)} SELECT doc_id, sha256(d.text) AS text_sha256, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items FROM documents d LEFT JOIN kept ON doc_id = key"""


def tokens_sql() -> str:
    """Document-wide numbers of e-mail addresses; a conversation is a document, so is each document."""
    texts = "SELECT turn AS source, conv_id AS key, text FROM conversations UNION ALL SELECT -1, doc_id, text FROM documents"
    return f"""WITH texts AS ({texts}), f AS (SELECT key, source, s, m, lower(trim(m)) AS v FROM ({Take(EMAIL).sql("texts")})),
    o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, s) AS r FROM f), g AS (SELECT *, min(r) OVER (PARTITION BY key, v) AS first FROM o)
    SELECT key AS conv_id, CAST(source AS BIGINT) AS page, s AS start, m AS text, '[EMAIL_' || dense_rank() OVER (PARTITION BY key ORDER BY first) || ']' AS token FROM g"""


def registry_sql() -> str:
    rows = ", ".join(f"({i}, '{name}', {priority}, '{label}', '{prefix}', {str(on).lower()}, '{group}', '{by}', '{one}', '{many}')" for i, name, priority, label, prefix, on, group, by, one, many in REGISTRY)
    return f"SELECT * FROM (VALUES {rows}) AS t(position, category, priority, label, prefix, enabled, grp, literal_mode, singular, plural)"
