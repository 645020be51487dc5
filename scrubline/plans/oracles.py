"""The same jobs in plain SQL (DuckDB dialect), for comparison.

RE2 has neither look-around nor Unicode word boundaries, and no replacement that
depends on the match. So look-around is written as consumed neighbours that are
put back (applied twice: the neighbour between two matches is consumed by the
first), and match-dependent labels as a walk over what lies between the matches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from scrubline.operators.redact import INLINE
from scrubline.plans.jobs import ACCOUNT_LINES, GUARD_TEXT, KEYED_CELLS, KEYWORDS, LOG_LINE, SPLIT_VALUES, WALLETS, account_text, note_line


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def found(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


class Step(str):
    """A text after one pass, as an expression over ``t``; ``n``: the number of replacements made."""

    n: str

    def replace(self, *args) -> Step:
        return step(str.replace(self, *args), self.n.replace(*args))


def step(sql: str, n: str) -> Step:
    out = Step(sql)
    out.n = n
    return out


def relabel(text: str, pattern: str, label: str, group: int = 0) -> Step:
    """Every match replaced by ``label``, an expression over ``h`` (match) and ``v`` (group)."""
    label = label.replace("{h}", "x[2]").replace("{v}", "x[3]")
    parts = f"list_zip(regexp_split_to_array({text}, {q(pattern)}), {found(text, pattern)}, {found(text, pattern, group)})"
    return step(f"array_to_string(list_transform({parts}, lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' ELSE {label} END), '')",
                f"len(list_filter({parts}, lambda x: x[2] IS NOT NULL AND {label} <> x[2]))")


def replaced(text: str, pattern: str, template: str) -> Step:
    return step(f"regexp_replace({text}, {q(pattern)}, {q(template)}, 'g')", f"len({found(text, pattern)})")


def chain(source: str, keys: str, steps: Sequence[str]) -> str:
    """A subquery with ``keys``, ``o`` (the text as it was) and ``t`` after all ``steps`` (over ``t``)."""
    sql = f"SELECT {keys}, t, t AS o FROM ({source})"
    for step in steps:
        sql = f"SELECT {keys}, {step} AS t, o FROM ({sql})"
    return sql


def made(source: str, keys: str, steps: Sequence[Step]) -> str:
    """As ``chain``, with ``n``: the replacements made, those within a later one as well."""
    sql = f"SELECT {keys}, t, t AS o, 0 AS n FROM ({source})"
    for one in steps:
        sql = f"SELECT {keys}, {one} AS t, o, n + {one.n} AS n FROM ({sql})"
    return sql


def times(text: str, needle: str) -> str:
    """How often a literal occurs, as an INTEGER."""
    return f"CAST((length({text}) - length(replace({text}, {q(needle)}, ''))) // {len(needle)} AS INTEGER)"


def counted(source: str, keys: str, steps: Sequence[str], needles: Sequence[str], text: str = "text") -> str:
    """Keys, redacted text and the number of labels written."""
    n = " + ".join(f"{times('t', needle)} - {times('o', needle)}" for needle in needles)
    return f"SELECT {keys}, t AS {text}, CAST({n} AS INTEGER) AS n FROM ({chain(source, keys, steps)})"


# --- detectors ---------------------------------------------------------------

_DOT = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\."
EMAIL = rf"[a-zA-Z0-9!#$%&'*+/=?^_`{{|}}~.-]+@((?:{_DOT})+[a-zA-Z]{{2,6}})"
MODEL_EMAIL = r"[\p{L}\p{N}_.+-]+@(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,6}"
EMAILS = [replaced("t", EMAIL, r"[EMAIL:\1]")]

_WORD = r"[\p{L}\p{N}_]"
_DOMAIN = (rf"(^|[^@\[\p{{L}}\p{{N}}_])(?:https?://)?(?:www\.)?(?:{_DOT})+([a-zA-Z]{{2,63}})"
           r"([^\p{L}\p{N}_]|$)")
DOMAINS = [replaced("t", _DOMAIN, r"\1[DOMAIN:.\2]\3")] * 2

_KEY_CASE = """CASE WHEN contains({k}, 'AKIA') THEN '[AWS_ACCESS_KEY]' WHEN contains({k}, 'AIza') THEN '[GOOGLE_API_KEY]'
    WHEN regexp_matches({k}, '^[sp]k_') THEN '[STRIPE_API_KEY]' WHEN starts_with({k}, 'gh') THEN '[GITHUB_TOKEN]'
    WHEN starts_with({k}, 'xox') THEN '[SLACK_TOKEN]' WHEN contains({k}, 'EAACEdEose0cBA') THEN '[FACEBOOK_TOKEN]'
    WHEN contains({k}, '-') AND length({k}) > 20 THEN '[UUID_API_KEY]' """
_IN_CONTEXT = _KEY_CASE.replace("{k}", "{v}") + """WHEN contains(lower({h}), 'secret') THEN '[API_SECRET]'
    WHEN contains(lower({h}), 'token') THEN '[API_TOKEN]' ELSE '[API_KEY]' END"""
_BARE = _KEY_CASE.replace("{k}", "{h}") + "ELSE '[GENERIC_API_KEY]' END"
# Fixed values from here on: the patterns, where RE2 takes them as they are.
API_KEY_RULES = [
    (r"""(?i)\b(?:api_key|apikey|api-key|access_key|access-key|secret_key|secret-key|token)\s*[:=]\s*["']?([a-zA-Z0-9_/+.-]{16,128})["']?""", _IN_CONTEXT, 1),
    (r"\bAKIA[0-9A-Z]{16}\b", _BARE, 0),
    (r"\b(A3T[A-Z0-9]|AMZN|ASCA|AGPA)[A-Z0-9]{8,}\b", _IN_CONTEXT, 1),
    (r"\bAIza[0-9A-Za-z_-]{35}", _BARE, 0),
    (r"(?i)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", _BARE, 0),
    (r"\b(?:sk|pk)_(?:live|test)_[0-9a-zA-Z]{24,}\b", _BARE, 0),
    (r"\bgh[pousr]_[a-zA-Z0-9]{36,255}\b", _BARE, 0),
    (r"\bxox[baprs]-[0-9a-zA-Z-]{10,}\b", _BARE, 0),
    (r"\b(EAACEdEose0cBA[0-9A-Za-z]+)\b", _IN_CONTEXT, 1),
    (r"\b[A-Za-z0-9/+]{30,}={0,2}\b", _BARE, 0),
]
API_KEYS = [relabel("t", p, label, group) for p, label, group in API_KEY_RULES]
API_KEY_LABELS = ("[AWS_ACCESS_KEY]", "[GOOGLE_API_KEY]", "[STRIPE_API_KEY]", "[GITHUB_TOKEN]", "[SLACK_TOKEN]",
                  "[FACEBOOK_TOKEN]", "[UUID_API_KEY]", "[API_SECRET]", "[API_TOKEN]", "[API_KEY]", "[GENERIC_API_KEY]")

# neighbours in groups 1 and 3 around the number in group 2
_LEFT, _RIGHT = r"(^|[^0-9])", r"([^0-9]|$)"


def _guarded(pattern: str, label: str) -> list[str]:
    """A number between neighbours that are no digits; ``label`` is an expression over ``{n}``, the number."""
    whole = f"{_LEFT}({pattern}){_RIGHT}"
    number = f"regexp_extract({{h}}, {q('^' + whole + '$')}, 2)"
    first, last = (f"regexp_extract({{h}}, {q('^' + whole + '$')}, {i})" for i in (1, 3))
    return [relabel("t", whole, f"{first} || {label.replace('{n}', number)} || {last}")] * 2


_DIGITS = r"regexp_replace({n}, '\D', '', 'g')"
_CARD = f"""(CASE WHEN regexp_matches({_DIGITS}, '^4(\\d{{12}}|\\d{{15}})$') THEN '[CREDIT_CARD:VISA]'
    WHEN length({_DIGITS}) = 16 AND (substr({_DIGITS}, 1, 2) BETWEEN '51' AND '55'
        OR substr({_DIGITS}, 1, 6) BETWEEN '222100' AND '272099') THEN '[CREDIT_CARD:MASTERCARD]'
    WHEN regexp_matches({_DIGITS}, '^3[47]\\d{{13}}$') THEN '[CREDIT_CARD:AMEX]'
    WHEN length({_DIGITS}) = 16 AND (substr({_DIGITS}, 1, 4) = '6011' OR substr({_DIGITS}, 1, 2) = '65'
        OR substr({_DIGITS}, 1, 6) BETWEEN '622126' AND '622925' OR substr({_DIGITS}, 1, 3) BETWEEN '644' AND '649')
        THEN '[CREDIT_CARD:DISCOVER]' ELSE '[CREDIT_CARD]' END)"""
# fixed values
CARD_PATTERNS = [
    r"4\d{3}(?:[\s-]?\d{4}){2}[\s-]?\d{1,4}",
    r"(?:5[1-5]\d{2}|222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)(?:[\s-]?\d{4}){3}",
    r"3[47]\d{2}(?:(?:[\s-]?\d{6}[\s-]?\d{5})|(?:(?:[\s-]?\d{4}){2}[\s-]?\d{3}))",
    r"(?:6011|622(?:1(?:2[6-9]|[3-9]\d)|[2-8]\d{2}|9(?:[01]\d|2[0-5]))|64[4-9]\d|65\d{2})(?:[\s-]?\d{4}){3}",
]
_CARD_WORDS = (r"(?i)(?:credit|debit|card|cc|visa|mastercard|amex|discover)\s*(?:number|num|#)?\s*[:=-]?\s*"
               r"((?:\d[\s-]*){12,19}\d)([^0-9]|$)")
CARDS = [step for p in CARD_PATTERNS for step in _guarded(p, _CARD)] + [
    relabel("t", _CARD_WORDS, _CARD.replace("{n}", "{v}") + f" || regexp_extract({{h}}, {q('([^0-9]?)$')}, 1)", 1)]

_BROAD_PHONE = (r"(?:\+\d{1,4}[\s.-]?)?(?:\(?\d{1,4}\)?[\s.-]?)?\d{2,4}[\s.-]?\d{2,4}[\s.-]?\d{2,4}")
_PHONE = f"""(CASE WHEN regexp_matches({{n}}, '^\\+\\d{{1,4}}[ -]')
        THEN '[PHONE:' || regexp_extract({{n}}, '^(\\+\\d{{1,4}})[ -]', 1) || ']'
    WHEN regexp_matches({_DIGITS}, '^05\\d{{7,8}}$') THEN '[PHONE:IL_MOBILE]'
    WHEN regexp_matches({_DIGITS}, '^0\\d{{8,9}}$') THEN '[PHONE:IL_LANDLINE]'
    WHEN regexp_matches({_DIGITS}, '^[2-9]\\d{{9}}$') THEN '[PHONE:US]'
    WHEN regexp_matches({_DIGITS}, '^1\\d{{10}}$') THEN '[PHONE:US_LONG]' ELSE '[PHONE]' END)"""
_PHONE_WORDS = (r"(?i)(?:phone|tel|cell|mobile|fax)\s*(?:number|num|#)?\s*[:=-]?\s*"
                r"((?:\+\d{1,3}[\s.-]?)?(?:\(\d+\)[\s.-]?)?[\d\s.-]{7,17}\d)([^0-9]|$)")
PHONES = [step for p in (
    _BROAD_PHONE,
    r"0(?:5\d|7[234678])(?:[\s.-]?\d{3}[\s.-]?\d{4}|[\s.-]?\d{7})",
    r"0[23489](?:[\s.-]?\d{3}[\s.-]?\d{4}|[\s.-]?\d{7})",
    r"(?:\(\d{3}\)[\s.-]?|\d{3}[\s.-]?)\d{3}[\s.-]?\d{4}",
) for step in _guarded(p, _PHONE)] + [
    relabel("t", _PHONE_WORDS, _PHONE.replace("{n}", "{v}") + f" || regexp_extract({{h}}, {q('([^0-9]?)$')}, 1)", 1)]

_ID_CASE = """CASE WHEN contains(lower({h}), 'ssn') OR regexp_matches({k}, '^\\d{3}-\\d{2}-\\d{4}$') THEN '[SSN_ID]'
    WHEN contains(lower({h}), 'passport') THEN '[PASSPORT_ID]'
    WHEN contains(lower({h}), 'tz') OR regexp_matches({k}, '^\\d{9}$') THEN '[NATIONAL_ID:IL]'
    WHEN contains(lower({h}), 'emp') OR contains(lower({h}), 'staff') THEN '[EMPLOYEE_ID]' ELSE '[ID_NUMBER]' END"""
# fixed values
ID_PATTERNS = (
    (r"(?i)(?:\b(?:TZ|T\.Z\.|ID|id number)\s*[:=-]?\s*)?(\b\d{9}\b)", 1),
    (r"(?i)(?:\bSSN\s*[:=-]?\s*)?(\b\d{3}[\s.-]?\d{2}[\s.-]?\d{4}\b)", 1),
    (r"(?i)\b(?:passport\s*(?:number|no)?\.?\s*[:=-]?\s*)([A-Z0-9]{6,15})\b", 1),
    (r"\b[A-Z]{1,2}\d{6,9}\b", 0),
    (r"(?i)\b(?:employee|emp|staff)\s*(?:id|number|#)\s*[:=-]?\s*([A-Za-z0-9\-_]{4,15})\b", 1))
IDS = [relabel("t", p, _ID_CASE.replace("{k}", "{v}" if g else "{h}"), g) for p, g in ID_PATTERNS]
ID_LABELS = ("[SSN_ID]", "[PASSPORT_ID]", "[NATIONAL_ID:IL]", "[EMPLOYEE_ID]", "[ID_NUMBER]")

IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
_OCTET = "CAST(string_split({h}, '.')[%d] AS INTEGER)"
IPV4_LABEL = f"""CASE WHEN greatest({', '.join(_OCTET % i for i in (1, 2, 3, 4))}) > 255 THEN {{h}}
    WHEN {_OCTET % 1} = 10 OR ({_OCTET % 1} = 172 AND {_OCTET % 2} BETWEEN 16 AND 31)
        OR ({_OCTET % 1} = 192 AND {_OCTET % 2} = 168) THEN '[PRIVATE_IPV4]' ELSE '[PUBLIC_IPV4]' END"""
IPV6 = (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:(?:[0-9a-fA-F]{1,4}:){0,5}"
        r"[0-9a-fA-F]{1,4}\b|::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b")
IPS = [relabel("t", IPV4, IPV4_LABEL), replaced("t", IPV6, "[IPV6_ADDRESS]")]
IP_LABELS = ("[PRIVATE_IPV4]", "[PUBLIC_IPV4]", "[IPV6_ADDRESS]")

_AMOUNT = r"[0-9]+(?:,\d{3})*(?:\.\d{1,2})?"
_NO_WORD = r"[^\p{L}\p{N}_]"
MONEY = [step for p in (
    rf"(^|{_NO_WORD})\$\s*{_AMOUNT}(\D|$)",
    rf"(?i)(^|{_NO_WORD}){_AMOUNT}\s*(?:dollars|USD|US\$)({_NO_WORD}|$)",
    rf"(^|{_NO_WORD})₪\s*{_AMOUNT}(\D|$)",
    rf"(?i)(^|{_NO_WORD}){_AMOUNT}\s*(?:shekels?|ILS|NIS)({_NO_WORD}|$)",
    rf"(?i)(^|{_NO_WORD})(?:NIS|ILS)\s*{_AMOUNT}(\D|$)",
    rf"(?i)(^|{_NO_WORD})(?:EUR|GBP|JPY|CHF|AUD|CAD|CNY)\s*{_AMOUNT}(\D|$)",
    rf"(^|{_NO_WORD})€\s*{_AMOUNT}(\D|$)",
    rf"(^|{_NO_WORD})£\s*{_AMOUNT}(\D|$)",
) for step in [replaced("t", p, r"\1[MONEY]\2")] * 2] + [replaced("t", (
    r"(?i)()(?:costs?|worth|value|amount|payment|fee|price|charge|rate|income|revenue|profit|loss|salary|wage|fine|total)"
    rf"\s+(?:is|of|:)?\s*(?:\$|₪|€|£)?\s*{_AMOUNT}"
    # the blank after the amount belongs to the match, whether a currency word follows or not
    r"(?:\s*(?:dollars|USD|shekels?|ILS|NIS|euros?|EUR|GBP|pounds?)|\s+|(\D)|$)"), r"\1[MONEY]\2")]

# fixed values
_STREET = (r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Circle|Cir|Place|Pl"
           r"|Square|Sq|Terrace|Ter|Way|Highway|Hwy|Parkway|Pkwy|Route|Rte|Trail|Trl)")
_NOT_MONTH = "CASE WHEN regexp_matches({h}, '^\\d+\\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\b') THEN {h} ELSE '[ADDRESS]' END"
ADDRESSES = [
    replaced("t", rf"(?i)\b\d+\s+(?:[A-Z][a-z]+\s+)*[A-Z][a-z]+\s+{_STREET}\b", "[ADDRESS]"),
    relabel("t", r"\b\d+\s+(?:[A-Z][a-z]+\s+){1,3}[A-Z][a-z]+\b", _NOT_MONTH),
    replaced("t", r"(?i)\bP\.?O\.?\s*Box\s+\d+\b", "[ADDRESS]"),
    replaced("t", r"(?i)(?:address|location|office|hq|headquarters|residence|property)\s*[:=-]?\s*"
                  rf"(\d+\s+.*?{_STREET}.*?\b\d{{5}}(?:-\d{{4}})?\b)", "[ADDRESS]"),
    replaced("t", r"""(^|[^\p{L}\p{N}_])(?:רחוב|רח\.?|שדרות|שד\.?|דרך|סמטה|כיכר)\s+[א-ת\s."'-]+\s+\d+(?:[/\-]\d+)?[א-ת]?([^\p{L}\p{N}_]|$)""",
             r"\1[ADDRESS]\2"),
]

_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
_MON = r"(?:0?[1-9]|1[0-2])"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
# the texts are so short that the whole of one is the neighbourhood of its date
_DATE_LABEL = """CASE WHEN regexp_matches(lower(o), 'birth|born|dob') THEN '[DATE_OF_BIRTH]'
    WHEN regexp_matches(lower(o), 'expir|valid until|good through') THEN '[EXPIRY_DATE]'
    WHEN regexp_matches(lower(o), 'issue|created on') THEN '[ISSUE_DATE]' ELSE '[DATE]' END"""
DATE_PATTERNS = (
    rf"\b(?:{_DAY}/{_MON}/(?:\d{{4}}|\d{{2}})|{_DAY}-{_MON}-(?:\d{{4}}|\d{{2}})|{_DAY}\.{_MON}\.\d{{4}})\b",
    rf"\b(?:\d{{4}}/{_MON}/{_DAY}|\d{{4}}\.{_MON}\.{_DAY}|\d{{4}}-{_MON}-{_DAY})\b",
    rf"(?i)\b{_DAY}\s+{_MONTH}[a-z]*\.?\s+(?:\d{{4}}|\d{{2}})\b",
    rf"(?i)\b{_MONTH}[a-z]*\.?\s+{_DAY},?\s+(?:\d{{4}}|\d{{2}})\b",
)
DATES = [relabel("t", p, _DATE_LABEL) for p in DATE_PATTERNS]
# a date in a line of a note stands at its end: 30 characters before it tell its purpose
_NOTE_DATE_LABEL = _DATE_LABEL.replace("lower(o)", "lower(right(t, length({h}) + 30))")
_DATE_WORDS = (
    r"(?i)(?:date\s*(?:of|of birth|issued|valid|expires|expiry|from|until|through)|dob)\s*[:=-]?\s*"
    rf"(\b(?:[0-9]+(?:st|nd|rd|th)?\s)?{_MONTH}[a-z]*\.?\s\d+[\s,]*\d{{2,4}}\b|\b\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}\b"
    r"|\b\d{4}[/.-]\d{1,2}[/.-]\d{1,2}\b)")
NOTE_DATES = [d.replace(_DATE_LABEL.replace("{h}", "x[2]"), _NOTE_DATE_LABEL.replace("{h}", "x[2]")) for d in DATES] + [
    relabel("t", _DATE_WORDS, _NOTE_DATE_LABEL, 1)]
DATE_LABELS = ("[DATE_OF_BIRTH]", "[EXPIRY_DATE]", "[ISSUE_DATE]", "[DATE]")

_SECRET = r"(?:password|passwd|pwd|passphrase|pass[\s_]?code|secret|credential|token|auth_key|private_key)"
_SECRET_CASE = """CASE WHEN starts_with({v}, '[') AND ends_with({v}, ']') THEN {h}
    WHEN starts_with({v}, 'eyJ') THEN '[JWT_TOKEN]' WHEN length({v}) < 6 THEN {h}
    WHEN contains(lower({h}), 'jwt') THEN '[JWT_TOKEN]' WHEN contains(lower({h}), 'token') THEN '[AUTH_TOKEN]'
    WHEN contains(lower({h}), 'secret') OR contains(lower({h}), 'key') THEN '[SECRET_OR_KEY]' ELSE '[PASSWORD]' END"""
# fixed values
PASSWORD_PATTERNS = (
    (rf"""(?i)\b{_SECRET}\s*[:=]\s*["']?([A-Za-z0-9!@#$%^&*()_+\-=\[\]{{}};:'",.<>\/?~`]{{6,64}})["']?""", 1),
    (rf"(?i)<{_SECRET}>([^<]+)</{_SECRET}>", 1),
    (rf"""(?i)["']{_SECRET}["']\s*:\s*["']([^"']{{6,64}})["']""", 1),
    (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{10,})?", 0))
PASSWORDS = [relabel("t", p, _SECRET_CASE, g) for p, g in PASSWORD_PATTERNS]
SECRET_LABELS = ("[JWT_TOKEN]", "[AUTH_TOKEN]", "[SECRET_OR_KEY]", "[PASSWORD]")

# --- sources -----------------------------------------------------------------

DOCUMENTS = "SELECT doc_id, text AS t FROM documents"
_PRICE = "format('{:,.2f}', o_totalprice)"
MONEY_TEXT = f"""SELECT o_orderkey, concat('order ', o_orderkey, CASE o_orderpriority
    WHEN '1-URGENT' THEN concat(': total $', {_PRICE}, ' due') WHEN '2-HIGH' THEN concat(' costs ', {_PRICE}, ' USD')
    WHEN '3-MEDIUM' THEN concat(', € ', {_PRICE}, ' or GBP ', {_PRICE})
    WHEN '4-NOT SPECIFIED' THEN concat(': NIS ', {_PRICE}, ' and 12 shekels')
    ELSE concat(' has a value of ', {_PRICE}, ' in all') END) AS t FROM orders"""
DATE_TEXT = """SELECT o_orderkey, concat(CASE o_orderstatus WHEN 'F' THEN 'born on ' WHEN 'O' THEN 'card expires '
    ELSE 'sent ' END, CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%d/%m/%Y')
    WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%d %b %Y')
    WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%B %d, %Y') ELSE strftime(o_orderdate, '%d.%m.%Y') END,
    ', version 2.2.15') AS t FROM orders"""
ID_TEXT = """SELECT c_custkey, concat(CASE c_mktsegment
    WHEN 'AUTOMOBILE' THEN concat('Employee ID: E-', lpad(c_custkey::VARCHAR, 6, '0'))
    WHEN 'BUILDING' THEN concat('passport no. AB', lpad(c_custkey::VARCHAR, 7, '0'))
    WHEN 'FURNITURE' THEN concat('TZ: ', lpad(c_custkey::VARCHAR, 9, '1'))
    WHEN 'HOUSEHOLD' THEN concat('SSN 123-45-', lpad((c_custkey % 10000)::VARCHAR, 4, '0'))
    ELSE concat('file KX', lpad(c_custkey::VARCHAR, 8, '0')) END, ' of ', c_name) AS t FROM customer"""
ADDRESS_TEXT = """SELECT s_suppkey, concat(s_name, CASE
    WHEN s_nationkey < 5 THEN concat(': ship to ', s_suppkey + 1, ' Old Mill Road today')
    WHEN s_nationkey < 10 THEN concat(' sits at ', s_suppkey + 1, ' Evergreen Garden')
    WHEN s_nationkey < 15 THEN concat(', P.O. Box ', s_suppkey + 1)
    WHEN s_nationkey < 20 THEN concat(', office: ', s_suppkey + 1, ' Main St, Springfield, IL 62704-1234')
    ELSE concat(' sold ', s_suppkey + 1, ' parts in 3 March Weeks') END) AS t FROM supplier"""
SECRET_TEXT = """SELECT c_custkey, concat(CASE c_mktsegment
    WHEN 'AUTOMOBILE' THEN concat('Password: Key_', c_custkey, '!x')
    WHEN 'BUILDING' THEN concat('<token>id-', c_custkey, '-zz</token>')
    WHEN 'FURNITURE' THEN concat('{"secret": "v ', c_custkey, ' abc"}')
    WHEN 'HOUSEHOLD' THEN concat('eyJhbGciOiJub25lIn0.eyJzdWIiOiJ4', lpad(c_custkey::VARCHAR, 8, '0'), '.c2lnbmF0dXJl')
    ELSE 'pwd = ab1' END, ' for ', c_mktsegment) AS t FROM customer"""


def _line(key: str) -> str:
    """The line of a note, in this dialect."""
    return re.sub(r"lpad\(([^,]+), ", r"lpad((\1)::VARCHAR, ", note_line(key))


def _with_line(columns: str, text: str, key: str, table: str) -> str:
    return f"SELECT {columns}, concat({text}, chr(10), {_line(key)}) AS t FROM {table}"


NOTES = _with_line("doc_id", "text", "doc_id", "documents")
CONTACTS = f"""SELECT c_custkey, c_name, concat(lower(c_mktsegment), '.', c_custkey, '@mail.example.com') AS email,
    concat('10.', c_nationkey, '.0.', c_custkey % 300) AS ip, {_line('c_custkey')} AS note, c_nationkey, c_acctbal FROM customer"""
SPLIT_PAGES = f"SELECT page_id, concat(html, {SPLIT_VALUES}, '<p>', {_line('page_id')}) AS t FROM pages"
PAGES = f"""SELECT page_id, concat('<a title="web@example.org">web@example.org</a>', html, '<p>', {_line('page_id')}) AS t FROM pages"""
TURNS = _with_line("conv_id, turn", "concat(text, ' ', role, '.', conv_id, '@chat.example.net')", "(conv_id + turn)", "conversations")
LOG_LINES = f"SELECT event_id, ts, {LOG_LINE} AS t FROM events"

EMAIL_LABELS = ("[EMAIL:",)
CARD_LABELS = ("[CREDIT_CARD",)
SIMPLE = EMAILS + IPS
SIMPLE_LABELS = EMAIL_LABELS + IP_LABELS

_KEYWORD_CASE = "CASE WHEN lower({h}) IN (" + ", ".join(q(k) for k in KEYWORDS) + ") THEN '[COMPANY_NAME]' ELSE {h} END"

# All detectors in order. The documents hold no dates, ids, amounts or passwords; the lines added to notes do.
# An address in an e-mail label is protected in one profile and taken for a domain in the other.
_KEYWORDS = [relabel("t", _WORD + "+", _KEYWORD_CASE)]
_KEPT_LABEL = rf"\[EMAIL:(?:{_DOT})+[a-zA-Z]{{2,6}}\]"
_DOMAIN_CASE = (f"CASE WHEN starts_with({{h}}, '[EMAIL:') THEN {{h}} ELSE "
                f"regexp_replace({{h}}, {q('^' + _DOMAIN + '$')}, {q(chr(92) + '1[DOMAIN:.' + chr(92) + '2]' + chr(92) + '3')}) END")
_FREE_DOMAINS = [relabel("t", f"{_KEPT_LABEL}|{_DOMAIN}", _DOMAIN_CASE)] * 2
# three numbers between dots are a date in this profile, whatever the year; the original tells its purpose
_REF_LABEL = _DATE_LABEL.replace("lower(o)", "lower(right(o, length({h}) + 30))")
REF_DATES = [relabel("t", p, _REF_LABEL) for p in (
    rf"\b(?:{_DAY}/{_MON}/(?:\d{{4}}|\d{{2}})|{_DAY}-{_MON}-(?:\d{{4}}|\d{{2}})|{_DAY}\.{_MON}\.(?:\d{{4}}|\d{{2}}))\b",
    rf"\b(?:\d{{4}}/{_MON}/{_DAY}|\d{{4}}\.{_MON}\.{_DAY}|\d{{4}}-{_MON}-{_DAY})\b",
    rf"(?i)\b{_DAY}\s+{_MONTH}[a-z]*\.?\s+(?:\d{{4}}|\d{{2}})\b",
    rf"(?i)\b{_MONTH}[a-z]*\.?\s+{_DAY},?\s+(?:\d{{4}}|\d{{2}})\b")]
_SHORT_AMOUNT = r"[0-9]{1,3}(?:,\d{3})*(?:\.\d{1,2})?"
_ANY_WORDS = replaced("t", rf"(?i)\b\d+\s+(?:[A-Z][a-z]+\s+){{1,3}}[A-Z][a-z]+({_NO_WORD}|$)", r"[ADDRESS]\1")
_LABELS = {"company_names": ("[COMPANY_NAME]",), "emails": EMAIL_LABELS, "domains": ("[DOMAIN",),
           "api_keys": API_KEY_LABELS, "credit_cards": CARD_LABELS, "money": ("[MONEY]",), "phones": ("[PHONE",),
           "ids": ID_LABELS, "ips": IP_LABELS, "addresses": ("[ADDRESS]",), "dates": DATE_LABELS,
           "passwords": SECRET_LABELS}
BY_DETECTOR = {"emails": EMAILS, "company_names": _KEYWORDS, "domains": _FREE_DOMAINS, "api_keys": API_KEYS, "passwords": PASSWORDS,
               "credit_cards": CARDS, "ips": IPS, "ids": IDS, "dates": NOTE_DATES, "addresses": ADDRESSES, "money": MONEY, "phones": PHONES}
FULL_FIXED = [step for steps in BY_DETECTOR.values() for step in steps]
FULL_LABELS = tuple(label for d in BY_DETECTOR for label in _LABELS[d])
# the second pattern of passwords as it stands wants the literal text "6, 64"; the others differ in nothing
FULL_REF = (_KEYWORDS + EMAILS + DOMAINS + API_KEYS + CARDS + [m.replace(_AMOUNT, _SHORT_AMOUNT) for m in MONEY] + PHONES
            + IDS + IPS + [ADDRESSES[0], _ANY_WORDS, *ADDRESSES[2:]] + REF_DATES + PASSWORDS[1:])


def _document(steps: Sequence[str]) -> str:
    # a label that stands in a text from the start would be counted in neither
    n = ", ".join(f"CAST({' + '.join(f'{times(chr(116), x)} - {times(chr(111), x)}' for x in labels)} AS INTEGER) AS n_{d}"
                  for d, labels in _LABELS.items())
    return f"SELECT doc_id, t AS text, {n} FROM ({chain(DOCUMENTS, 'doc_id', steps)})"


def _sum_of(labels: Sequence[str], of: str = "t") -> str:
    return " + ".join(times(of, label) for label in labels)


# one row per note with the counts of all detectors
COUNTS = ("SELECT doc_id, " + ", ".join(f"CAST({_sum_of(_LABELS[d])} - ({_sum_of(_LABELS[d], 'o')}) AS INTEGER) AS {d}" for d in BY_DETECTOR)
          + f", length(o) AS len_before, length(t) AS len_after FROM ({chain(NOTES, 'doc_id', FULL_FIXED)})")
COUNTS_LONG = (f"SELECT doc_id, detector, n FROM (UNPIVOT ({COUNTS}) ON {', '.join(BY_DETECTOR)} INTO NAME detector VALUE n)")
STATS = ("SELECT lang, source, detector, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 0) AS docs "
         f"FROM ({COUNTS_LONG}) JOIN documents USING (doc_id) GROUP BY lang, source, detector")
# whether any rule but that of names changes a text
ANY_RULE = " OR ".join(f"({step}) <> t" for d, steps in BY_DETECTOR.items() if d != "company_names" for step in steps)

# findings: the matches of one pattern with their offsets
def _matches(detector: str, no: int, pattern: str, label: str, source: str = DOCUMENTS) -> str:
    label = label.replace("{h}", "match")
    return f"""SELECT doc_id, '{detector}' AS detector, {no} AS rule_no, i, start, start + length(match) AS "end", match,
        {label} AS label, rest FROM (
        SELECT doc_id, i, g[i + 1] AS rest, m[i] AS match, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start
        FROM (SELECT doc_id, regexp_split_to_array(t, {q(pattern)}) AS g, {found('t', pattern)} AS m FROM ({source})
              WHERE regexp_matches(t, {q(pattern)})), unnest(range(1, len(m) + 1)) AS r(i))"""


def _rule(detector: str, no: int, core: str, label: str, left: str = "", right: str = "", group: int = 0, flags: str = "",
          source: str = "{source}") -> str:
    """The matches of one rule. ``left``, ``right``: the neighbours that may stand on either side, in a group.

    A neighbour between two matches is consumed by the first, so where there are neighbours on both sides the search is
    done again over the text with the matches blanked out; what it finds must have its neighbours in the text as it was."""
    whole = f"{flags}{left}({core}){right}"
    part = f"regexp_extract(hit, {q(f'{flags}^{left}({core}){right}$')}, "
    first, match = (f"length({part}1))" if left else "0", f"{part}{2 if left else 1})")
    value = f"regexp_extract(match, {q(f'{flags}^(?:{core})$')}, {group})" if group else "match"
    label = label.replace("{h}", "match").replace("{v}", "value").replace("{n}", "value").replace("{k}", "value")
    rounds = [_matches(detector, no, whole, "''", source)]
    if left and right:
        one, two, three = (f"regexp_extract({{h}}, {q(f'{flags}^{left}({core}){right}$')}, {i})" for i in (1, 2, 3))
        blanked = relabel("t", whole, f"{one} || repeat('~', length({two})) || {three}")
        rounds.append(_matches(detector, no, whole, "''", f"SELECT doc_id, {blanked} AS t FROM ({source})"))
    beside = (f" WHERE regexp_matches(substr(t, start, 1), {q(left + '$')}) AND regexp_matches(substr(t, start + length(match) + 1, 1), {q('^' + right)})"
              if left and right else "")
    found_in = " UNION ALL ".join(f"(SELECT m.doc_id, i, start, match AS hit, t FROM ({r}) m JOIN ({source}) USING (doc_id))" for r in rounds)
    return f"""SELECT *, {label} AS label FROM (SELECT *, {value} AS value FROM (SELECT doc_id, '{detector}' AS detector, {no} AS rule_no, i,
        CAST(start + {first} AS INTEGER) AS start, {match} AS match, t FROM ({found_in})){beside})"""


_WORDS_RIGHT, _WORDS_LEFT = rf"({_NO_WORD}|$)", rf"(^|{_NO_WORD})"
_PURPOSE = "lower(match || chr(10) || substr(t, greatest(start - 29, 1), least(start, 30) + length(match) + 30))"
_FOUND_DATE = _DATE_LABEL.replace("lower(o)", _PURPOSE)
_SIGN_MONEY = rf"\s*{_AMOUNT}"


def _findings_of_all(source: str) -> str:
    """All rules, each over the texts as they are."""
    rules = [_rule("emails", 1, EMAIL, "'[EMAIL:' || substr({h}, position('@' IN {h}) + 1) || ']'"),
             _rule("company_names", 1, _WORD + "+", _KEYWORD_CASE),
             _rule("domains", 1, rf"(?:https?://)?(?:www\.)?(?:{_DOT})+[a-zA-Z]{{2,63}}", "'[DOMAIN:.' || regexp_extract({h}, '[a-zA-Z]+$') || ']'",
                   r"(^|[^@\[\p{L}\p{N}_])", _WORDS_RIGHT)]
    rules += [_rule("api_keys", no, p.removeprefix("(?i)"), label, group=group, flags="(?i)" if p.startswith("(?i)") else "",
                    right="([^0-9A-Za-z_-]|$)" if no == 4 else "") for no, (p, label, group) in enumerate(API_KEY_RULES, 1)]
    rules += [_rule("credit_cards", no, p, _CARD, _LEFT, _RIGHT) for no, p in enumerate(CARD_PATTERNS, 1)]
    rules.append(_rule("credit_cards", 5, _CARD_WORDS.removeprefix("(?i)").removesuffix("([^0-9]|$)"), _CARD, "", _RIGHT, 1, "(?i)"))
    signs = ((1, r"\$", ""), (3, "₪", ""), (7, "€", ""), (8, "£", ""), (5, "(?:NIS|ILS)", "(?i)"), (6, "(?:EUR|GBP|JPY|CHF|AUD|CAD|CNY)", "(?i)"))
    rules += [_rule("money", no, sign + _SIGN_MONEY, "'[MONEY]'", _WORDS_LEFT, _RIGHT, 0, flags) for no, sign, flags in signs]
    rules += [_rule("money", no, rf"{_AMOUNT}\s*{name}", "'[MONEY]'", _WORDS_LEFT, _WORDS_RIGHT, 0, "(?i)")
              for no, name in ((2, r"(?:dollars|USD|US\$)"), (4, "(?:shekels?|ILS|NIS)"))]
    rules.append(_rule("money", 9, r"(?:costs?|worth|value|amount|payment|fee|price|charge|rate|income|revenue|profit|loss|salary|wage|fine|total)"
                       rf"\s+(?:is|of|:)?\s*(?:\$|₪|€|£)?\s*{_AMOUNT}\s*(?:dollars|USD|shekels?|ILS|NIS|euros?|EUR|GBP|pounds?)?", "'[MONEY]'", "", _RIGHT, 0, "(?i)"))
    rules += [_rule("phones", no, p, _PHONE, _LEFT, _RIGHT) for no, p in enumerate((
        _BROAD_PHONE, r"0(?:5\d|7[234678])(?:[\s.-]?\d{3}[\s.-]?\d{4}|[\s.-]?\d{7})", r"0[23489](?:[\s.-]?\d{3}[\s.-]?\d{4}|[\s.-]?\d{7})",
        r"(?:\(\d{3}\)[\s.-]?|\d{3}[\s.-]?)\d{3}[\s.-]?\d{4}"), 1)]
    rules.append(_rule("phones", 5, _PHONE_WORDS.removeprefix("(?i)").removesuffix("([^0-9]|$)"), _PHONE, "", _RIGHT, 1, "(?i)"))
    rules += [_rule("ids", no, p.removeprefix("(?i)"), _ID_CASE, group=g, flags="(?i)" if p.startswith("(?i)") else "")
              for no, (p, g) in enumerate(ID_PATTERNS, 1)]
    rules += [_rule("ips", 1, IPV4, IPV4_LABEL), _rule("ips", 2, IPV6, "'[IPV6_ADDRESS]'")]
    rules += [_rule("addresses", 1, rf"\b\d+\s+(?:[A-Z][a-z]+\s+)*[A-Z][a-z]+\s+{_STREET}\b", "'[ADDRESS]'", flags="(?i)"),
              _rule("addresses", 2, r"\b\d+\s+(?:[A-Z][a-z]+\s+){1,3}[A-Z][a-z]+\b", _NOT_MONTH),
              _rule("addresses", 3, r"\bP\.?O\.?\s*Box\s+\d+\b", "'[ADDRESS]'", flags="(?i)"),
              _rule("addresses", 4, r"(?:address|location|office|hq|headquarters|residence|property)\s*[:=-]?\s*"
                    rf"\d+\s+.*?{_STREET}.*?\b\d{{5}}(?:-\d{{4}})?\b", "'[ADDRESS]'", flags="(?i)"),
              _rule("addresses", 5, r"""(?:רחוב|רח\.?|שדרות|שד\.?|דרך|סמטה|כיכר)\s+[א-ת\s."'-]+\s+\d+(?:[/\-]\d+)?[א-ת]?""", "'[ADDRESS]'", _WORDS_LEFT, _WORDS_RIGHT)]
    rules += [_rule("dates", no, p.removeprefix("(?i)"), _FOUND_DATE, flags="(?i)" if p.startswith("(?i)") else "") for no, p in enumerate(DATE_PATTERNS, 1)]
    rules.append(_rule("dates", 5, _DATE_WORDS.removeprefix("(?i)"), _FOUND_DATE, group=1, flags="(?i)"))
    rules += [_rule("passwords", no, p.removeprefix("(?i)"), _SECRET_CASE, group=g, flags="(?i)" if p.startswith("(?i)") else "")
              for no, (p, g) in enumerate(PASSWORD_PATTERNS, 1)]
    rows = " UNION ALL ".join(f"({r})" for r in rules).replace("{source}", source)
    # the value of a contextual address is its number and street, which no label looks at
    return f"""SELECT doc_id, detector, CAST(rule_no AS INTEGER) AS rule_no,
        CAST(row_number() OVER (PARTITION BY doc_id, detector, rule_no ORDER BY start) - 1 AS INTEGER) AS ord, start,
        CAST(start + length(match) AS INTEGER) AS "end", match, CASE WHEN detector = 'addresses' AND rule_no = 4
            THEN regexp_extract(match, '[0-9].*$') ELSE value END AS value, label, CAST(1 AS DOUBLE) AS score FROM ({rows}) WHERE label <> match"""


_BENCHMARK_WORDS = "SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '') AS w FROM benchmark"
GAZETTEER = f"""SELECT DISTINCT keyword, entity_type FROM (
    SELECT unnest(w) AS keyword, 'COMPANY' AS entity_type FROM ({_BENCHMARK_WORDS}) UNION ALL
    SELECT unnest(list_transform(list_filter(range(0, len(w)), lambda i: i + 1 < len(w) AND w[i + 1] <> w[i + 2]), lambda i: w[i + 1] || ' ' || w[i + 2])),
        'PERSON' FROM ({_BENCHMARK_WORDS}) UNION ALL
    SELECT lower(p_name), 'URL' FROM part UNION ALL
    SELECT lower(n_name), 'LOCATION' FROM nation UNION ALL SELECT lower(r_name), 'LOCATION' FROM region)"""


def _words(source: str = DOCUMENTS) -> str:
    """All words with the text before each and its offset."""
    return f"""SELECT doc_id, i, gap, word, CAST(sum(length(gap) + length(coalesce(word, ''))) OVER (PARTITION BY doc_id
            ORDER BY i) - length(coalesce(word, '')) AS INTEGER) AS start
        FROM (SELECT doc_id, unnest(x)[1] AS gap, unnest(x)[2] AS word, generate_subscripts(x, 1) AS i FROM (
            SELECT doc_id, list_zip(regexp_split_to_array(t, '{_WORD}+'), regexp_extract_all(t, '{_WORD}+')) AS x
            FROM ({source})))"""


def _known(source: str = DOCUMENTS, keys: str = "doc_id") -> str:
    """Dictionary findings: single words, and entries of two words by two neighbours."""
    return f"""WITH w AS ({_words(source)}), k AS ({GAZETTEER}),
        two AS (SELECT doc_id, start, word || lead(gap) OVER d || lead(word) OVER d AS match FROM w
                WINDOW d AS (PARTITION BY doc_id ORDER BY i))
        SELECT doc_id, entity_type, start, CAST(start + length(match) AS INTEGER) AS "end", match,
            CAST(1 AS DOUBLE) AS score
        FROM (SELECT doc_id, start, word AS match FROM w UNION ALL SELECT doc_id, start, match FROM two)
        JOIN k ON keyword = lower(match)""".replace("doc_id", keys)


_TYPE_LABEL = """CASE entity_type WHEN 'COMPANY' THEN '[COMPANY_NAME]' WHEN 'LOCATION' THEN '[ADDRESS]' WHEN 'URL' THEN '[URL]'
    ELSE '[PERSON_NAME]' END"""


#: Rounds in which overlaps are resolved: in each, what nothing better overlaps is taken, and what it overlaps goes.
ROUNDS = 24


def _applied(found_in: str, source: str = DOCUMENTS, keys: str = "doc_id", text: str = "text") -> str:
    """Findings (with score and label) written into their texts: of overlapping ones the higher score, then the longer, then the earlier."""
    bins = f"SELECT id, {keys}, start, stop, unnest(range(start // 64, (stop - 1) // 64 + 1)) AS bin FROM f"
    rounds = []
    for k in range(ROUNDS):
        rounds.append(f"t{k} AS MATERIALIZED (SELECT id FROM a{k} ANTI JOIN (SELECT worse AS id FROM o JOIN a{k} ON better = id) USING (id))")
        rounds.append(f"a{k + 1} AS MATERIALIZED (SELECT id FROM a{k} ANTI JOIN t{k} USING (id) ANTI JOIN (SELECT worse AS id FROM o JOIN t{k} ON better = id) USING (id))")
    taken = " UNION ALL ".join(f"SELECT id FROM t{k}" for k in range(ROUNDS))
    over = f"(PARTITION BY {keys} ORDER BY start)"
    return f"""WITH f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, start - stop, start, stop, label, {keys}) AS id FROM (
            SELECT {keys}, start, "end" AS stop, score, label, row_number() OVER (PARTITION BY {keys}, start, "end" ORDER BY score DESC, label) AS place
            FROM ({found_in})) WHERE place = 1),
        b AS MATERIALIZED ({bins}),
        o AS MATERIALIZED (SELECT DISTINCT x.id AS better, y.id AS worse FROM b x JOIN b y USING ({keys}, bin)
            WHERE x.id < y.id AND x.start < y.stop AND y.start < x.stop),
        a0 AS (SELECT id FROM f), {', '.join(rounds)},
        s AS (SELECT f.*, coalesce(lag(stop) OVER {over}, 0) AS before, lead(stop) OVER {over} IS NULL AS is_last FROM f SEMI JOIN ({taken}) USING (id)),
        w AS (SELECT {keys}, start, count(*) OVER (PARTITION BY {keys}) AS n, substr(t, before + 1, start - before) || label
            || CASE WHEN is_last THEN substr(t, stop + 1) ELSE '' END AS piece FROM s JOIN ({source}) USING ({keys})),
        done AS (SELECT {keys}, string_agg(piece, '' ORDER BY start) AS done, any_value(n) AS n FROM w GROUP BY {keys})
        SELECT {keys}, coalesce(done, t) AS {text}, CAST(coalesce(n, 0) AS INTEGER) AS n FROM ({source}) LEFT JOIN done USING ({keys})"""


def _labelled(source: str = DOCUMENTS, keys: str = "doc_id") -> str:
    """Dictionary findings with the label of their type."""
    return f"SELECT *, {_TYPE_LABEL} AS label FROM ({_known(source, keys)})"


def _dictionary_redacted(source: str = DOCUMENTS, keys: str = "doc_id") -> str:
    return _applied(_labelled(source, keys), source, keys)


# texts that end with names of other characters, and where these stand
SYMBOL_TEXTS = "SELECT doc_id, text || ' c++, .Net and yahoo! not netc++x yahoo?' AS t FROM documents"
_SYMBOLS = """SELECT doc_id, CAST(length(text) + p AS INTEGER) AS start, CAST(length(text) + p + n AS INTEGER) AS "end", CAST(1 AS DOUBLE) AS score, '[COMPANY_NAME]' AS label
    FROM documents, (VALUES (1, 3), (6, 4), (15, 6)) AS v(p, n)"""

_EXTENSION = r"""lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''),
    '[^/.](\.[^./]+)$', 1))"""


def _profile(table: str, key: str, text: str, extra: str = "") -> str:
    return f"""SELECT {key}, CAST(length({text}) - length(replace({text}, chr(10), '')) + 1 AS INTEGER) AS lines,
        CAST(length({text}) AS INTEGER) AS chars, CAST(strlen({text}) AS INTEGER) AS bytes,
        CASE WHEN length({text}) = strlen({text}) THEN 'ascii' ELSE 'utf-8' END AS encoding{extra} FROM {table}"""


# every line under its own key: document and number
BLOCKS = """SELECT doc_id, block_no, l[block_no + 1] AS t FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM ({notes})),
    unnest(range(0, len(l))) AS r(block_no)""".replace("{notes}", NOTES)

def _text_nodes() -> str:
    """Markup taken apart at the tags, each piece of text redacted, and put together again."""
    pieces = f"""SELECT page_id, i, x[i][1] AS t, x[i][2] AS tag FROM (SELECT page_id, list_zip(
        regexp_split_to_array(t, '<[^>]*>'), regexp_extract_all(t, '<[^>]*>')) AS x FROM ({PAGES})),
        unnest(range(1, len(x) + 1)) AS r(i)"""
    return f"""SELECT page_id, string_agg(t || coalesce(tag, ''), '' ORDER BY i) AS html, CAST(sum(n) AS INTEGER) AS n
        FROM ({made(pieces, 'page_id, i, tag', FULL_FIXED)}) GROUP BY page_id"""


# inline elements, told by their names, are taken out; what lies between the other tags is one text each
_INLINE = rf"(?i)</?(?:{'|'.join(INLINE)})(?:[\s/][^>]*)?>"


def _joined_nodes() -> str:
    pieces = f"""SELECT page_id, i, x[i][1] AS t, x[i][2] AS tag, tags FROM (SELECT page_id, tags, list_zip(
        regexp_split_to_array(t, '<[^>]*>'), regexp_extract_all(t, '<[^>]*>')) AS x FROM (
            SELECT page_id, regexp_replace(t, {q(_INLINE)}, '', 'g') AS t, array_to_string(regexp_extract_all(t, '<[^>]*>'), '') AS tags FROM ({SPLIT_PAGES}))),
        unnest(range(1, len(x) + 1)) AS r(i)"""
    return f"""SELECT page_id, string_agg(t || coalesce(tag, ''), '' ORDER BY i) AS text, any_value(tags) AS tags, CAST(sum(n) AS INTEGER) AS n
        FROM ({made(pieces, 'page_id, i, tag, tags', FULL_FIXED)}) GROUP BY page_id"""


def _keyed_leaves() -> str:
    """Values read with the phrase of their key; a secret goes as a whole, unless the rules have made one label of it."""
    cells = ", ".join(f"({q(name)}, {q(phrase)}, {q(secret) if secret else 'NULL'}, {value})" for name, phrase, secret, value in KEYED_CELLS)
    rows = f"SELECT c_custkey, c, phrase, secret, v, phrase || v AS t FROM customer, LATERAL (VALUES {cells}) AS cell(c, phrase, secret, v)"
    bare = "CASE WHEN starts_with(t, phrase) THEN substr(t, length(phrase) + 1) ELSE t END"
    whole = f"""CASE WHEN secret IS NULL OR regexp_matches({bare}, '^\\[[A-Z_]+(:[^\\]]*)?\\]$') OR length(v) < 6 THEN {bare} ELSE secret END"""
    columns = ", ".join(f"max(CASE WHEN c = {q(name)} THEN w END) AS {name}" for name, *_ in KEYED_CELLS)
    return f"""SELECT c_custkey, {columns} FROM (SELECT *, {whole} AS w FROM ({chain(rows, 'c_custkey, c, phrase, secret, v', FULL_FIXED)})) GROUP BY c_custkey"""



CELLS = f"""SELECT c_custkey, c, t, c_nationkey, c_acctbal FROM (UNPIVOT ({CONTACTS}) ON c_name, email, ip, note INTO NAME c VALUE t)"""
FILE_CELLS = f"""SELECT c_custkey, c, t FROM (UNPIVOT (SELECT c_custkey, c_name, email,
    ip || chr(10) || note AS ip FROM ({CONTACTS})) ON c_name, email, ip INTO NAME c VALUE t)"""
LEAVES = f"""SELECT event_id, c, t, k, type, value FROM (UNPIVOT (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
    event_type AS type, value, 'user' || user_id || '@example.org' AS contact, '192.168.' || (user_id % 256) || '.7' AS host,
    {_line('event_id')} AS note, 'call +1 ' || (2000000000 + event_id) AS "call" FROM events) ON contact, host, note, "call" INTO NAME c VALUE t)"""
VARIANT_LEAVES = """SELECT event_id, c, t, number, k FROM (UNPIVOT (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    CAST(user_id AS BIGINT) AS number, 'user' || user_id || '@example.org' AS mail, 'say "hi" to 10.0.' || (user_id % 256) || '.7' AS say FROM events)
    ON mail, say INTO NAME c VALUE t)"""
PRINTED = """SELECT event_id, concat('{"props": ', props, ', "mail": "', event_type, user_id, '@example.org"',
    CASE event_type WHEN 'signup' THEN concat(', "id": ', 100000000 + event_id) ELSE '' END, '}') AS t FROM events"""
_PLACE_CASE = "CASE WHEN lower({h}) IN ('africa', 'america', 'asia', 'europe') OR regexp_matches({h}, '(?i)^nation_[0-9]+$') THEN '[ADDRESS]' ELSE {h} END"


def _luhn(number: str) -> str:
    digit = "CAST(string_split(reverse(%s), '')[i] AS INTEGER)" % number
    return (f"list_sum(list_transform(range(1, length({number}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} "
            f"WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0")


def _cards() -> str:
    """Card numbers with their offsets: the left neighbour is taken off again, the right one must not be a digit."""
    parts = []
    for no, pattern in enumerate(CARD_PATTERNS, start=1):
        whole = f"{_LEFT}({pattern})"
        first = f"length(regexp_extract(match, {q('^' + whole + '$')}, 1))"
        number = f"regexp_extract(match, {q('^' + whole + '$')}, 2)"
        parts.append(f"""SELECT doc_id, start + {first} AS s, {number} AS m
            FROM ({_matches("credit_cards", no, whole, "''")}) WHERE NOT regexp_matches(rest, '^[0-9]')""")
    rows = " UNION ALL ".join(f"({p})" for p in parts)
    return f"""SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(s + length(m) AS INTEGER) AS "end", m AS match,
        {_CARD.replace('{n}', 'm')} AS label, {_luhn("regexp_replace(m, '[^0-9]', '', 'g')")} AS luhn_valid
        FROM ({rows})"""


# what the lines of accounts hold, told by how they were made: entity type, number of the recognizer, pattern of the value, score
_ACCOUNTS = f"SELECT c_custkey, {account_text('HUGEINT', '//')} AS t FROM customer"


def _scored() -> str:
    whole = len(ACCOUNT_LINES)
    right = f"c_custkey // {whole} % 2 = 0"
    kinds = ((0, "IBAN_CODE", 1, r"DE[0-9]{20}", "1.0", "true"), (2, "CRYPTO", 1, WALLETS[0], "1.0", "true"), (2, "CRYPTO", 1, WALLETS[1], "1.0", "true"),
             (3, "CRYPTO", 2, WALLETS[2], "1.0", "true"), (3, "CRYPTO", 2, WALLETS[2].upper(), "1.0", "true"),
             (4, "US_BANK_NUMBER", 1, "[0-9]{9}", "0.85", right), (5, "US_BANK_NUMBER", 2, "7[0-9]{11}", "0.4", "true"),
             (8, "US_DRIVER_LICENSE", 1, "D[0-9]{7}", "0.65", "true"))
    parts = [f"""SELECT c_custkey, '{kind}' AS entity_type, {no} AS recognizer_no, CAST(position(match IN t) - 1 AS INTEGER) AS start, match, CAST({score} AS DOUBLE) AS score
        FROM (SELECT c_custkey, t, regexp_extract(t, '{pattern}') AS match FROM ({_ACCOUNTS}) WHERE c_custkey % {whole} = {line} AND {test})"""
             for line, kind, no, pattern, score, test in kinds]
    return f"""SELECT c_custkey, entity_type, recognizer_no, start, CAST(start + length(match) AS INTEGER) AS "end", match, score FROM ({' UNION ALL '.join(parts)})"""


LONG_TEXTS = f"SELECT source, doc_id // 64 AS stretch, string_agg(text, chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY 1, 2"
SECOND_CORPUS = f"""SELECT doc_id, CASE doc_id % 100 WHEN 7 THEN 'mail to changed@example.org' || chr(10) || t ELSE t END AS t FROM ({NOTES}) WHERE doc_id % 100 <> 8
    UNION ALL SELECT -1 - doc_id, 'call 10.0.0.1' || chr(10) || t FROM ({NOTES}) WHERE doc_id % 100 = 9"""
NOTE_LINES_READ = f"SELECT concat_ws(' ', 'turn', conv_id, turn, {_line('conv_id')}) AS t FROM conversations"


def _agreement() -> str:
    found_in = f"""SELECT doc_id, start, "end", label, 'rules' AS recognizer FROM ({_findings_of_all(NOTES)}) UNION ALL
        SELECT doc_id, start, "end", label, 'dictionary' FROM ({_labelled(NOTES)}) UNION ALL
        SELECT doc_id, start, "end", '[EMAIL]', 'model' FROM ({_matches('emails', 1, MODEL_EMAIL, "''", NOTES)})"""
    return f"""WITH f AS MATERIALIZED (SELECT DISTINCT doc_id, start, "end" AS stop, recognizer, regexp_extract(label, '[A-Z0-9_]+') AS kind FROM ({found_in})),
        m AS MATERIALIZED (SELECT a.recognizer AS one, b.recognizer AS two, a.doc_id, a.start AS s1, a.stop AS e1, a.kind AS k1, b.start AS s2, b.stop AS e2, b.kind AS k2
            FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.recognizer < b.recognizer AND a.start < b.stop AND b.start < a.stop),
        n AS (SELECT recognizer, count(*) AS n FROM f GROUP BY 1),
        p AS (SELECT one, two, count(*) AS met, count(*) FILTER (s1 = s2 AND e1 = e2) AS exact, count(*) FILTER (k1 <> k2) AS conflicts,
            count(DISTINCT concat_ws(chr(44), doc_id, s1, e1, k1)) AS met_one, count(DISTINCT concat_ws(chr(44), doc_id, s2, e2, k2)) AS met_two FROM m GROUP BY 1, 2)
        SELECT a.recognizer AS one, b.recognizer AS two, coalesce(met, 0) AS "overlaps", coalesce(exact, 0) AS exact, coalesce(conflicts, 0) AS conflicts,
            a.n - coalesce(met_one, 0) AS only_one, b.n - coalesce(met_two, 0) AS only_two
        FROM n a JOIN n b ON a.recognizer < b.recognizer LEFT JOIN p ON one = a.recognizer AND two = b.recognizer"""


ORACLES: dict[str, str] = {
    "stream_joined": f"SELECT event_id, t AS note, n FROM ({counted(f'SELECT c_custkey AS event_id, {_line(chr(99) + chr(95) + "custkey")} AS t FROM customer SEMI JOIN events ON event_id = c_custkey', 'event_id', FULL_FIXED, FULL_LABELS, 't')})",
    "stream_matched": f"""SELECT v.event_id AS view_id, p.event_id AS purchase_id, text FROM events v JOIN events p ON v.user_id = p.user_id
        AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR
        JOIN ({counted(LOG_LINES, 'event_id', FULL_FIXED, FULL_LABELS)}) t ON t.event_id = p.event_id""",
    "stream_first_findings": f"""SELECT DISTINCT detector, match, label FROM ({_findings_of_all("SELECT event_id AS doc_id, t FROM (" + LOG_LINES + ")")})""",
    "stream_late": f"""SELECT event_id, text, CASE event_id % 50 WHEN 0 THEN ts < second - INTERVAL 1 DAY WHEN 1 THEN ts < first - INTERVAL 1 DAY ELSE false END AS late
        FROM ({counted(LOG_LINES, 'event_id', FULL_FIXED, FULL_LABELS)}) JOIN events USING (event_id),
        (SELECT max(ts) FILTER (event_id % 50 > 1) AS first, max(ts) FILTER (event_id % 50 > 0) AS second FROM events)""",
    "redact_long_texts": f"SELECT source, stretch, t AS text, CAST(n AS INTEGER) AS n FROM ({made(LONG_TEXTS, 'source, stretch', FULL_FIXED)})",
    "redact_incremental": f"SELECT doc_id, text, n, doc_id < 0 OR doc_id % 100 = 7 AS fresh FROM ({counted(SECOND_CORPUS, 'doc_id', FULL_FIXED, FULL_LABELS)})",
    "recognizer_agreement": _agreement(),
    "sketched_values": f"""SELECT detector, CAST(sum(n) AS BIGINT) AS n, count(*) AS exact, true AS near, true AS top_found
        FROM (SELECT detector, match, count(*) AS n FROM ({_findings_of_all(NOTES)}) GROUP BY 1, 2) GROUP BY detector""",
    "observed_metrics": f"""SELECT 'run-1' AS run_id, 'documents' AS job, detector, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 0) AS docs,
        CAST(sum(length(t)) AS BIGINT) AS chars, true AS timed FROM ({COUNTS_LONG}) JOIN ({NOTES}) USING (doc_id) GROUP BY detector""",
    "placeholder_guard": f"SELECT c_custkey, t AS text, CAST(n AS INTEGER) AS n FROM ({made(f'SELECT c_custkey, {GUARD_TEXT} AS t FROM customer', 'c_custkey', PASSWORDS)})",
    "lines_of_files": f"SELECT t AS text, CAST(n AS INTEGER) AS n FROM ({made(NOTE_LINES_READ, '1 AS one', FULL_FIXED)})",
    "scored_entities": _scored(),
    "redact_scored": _applied(f"""SELECT *, CASE entity_type WHEN 'CRYPTO' THEN '[CRYPTO_ADDRESS]' WHEN 'US_DRIVER_LICENSE' THEN '[DRIVER_LICENSE]'
        ELSE '[BANK_ACCOUNT]' END AS label FROM ({_scored()})""", _ACCOUNTS, "c_custkey"),
    "redact_emails": counted(DOCUMENTS, "doc_id", EMAILS, EMAIL_LABELS),
    "redact_keywords": counted(DOCUMENTS, "doc_id", [relabel("t", _WORD + "+", _KEYWORD_CASE)], ("[COMPANY_NAME]",)),
    "redact_domains": counted("SELECT page_id, html AS t FROM pages", "page_id", DOMAINS, ("[DOMAIN",), "html"),
    "redact_api_keys": counted(DOCUMENTS, "doc_id", API_KEYS, API_KEY_LABELS),
    "redact_credit_cards": counted(DOCUMENTS, "doc_id", CARDS, CARD_LABELS),
    "redact_money": counted(MONEY_TEXT, "o_orderkey", MONEY, ("[MONEY]",)),
    "redact_phones": counted(DOCUMENTS, "doc_id", PHONES, ("[PHONE",)),
    "redact_ids": counted(ID_TEXT, "c_custkey", IDS, ID_LABELS),
    "redact_ips": counted(DOCUMENTS, "doc_id", IPS, IP_LABELS),
    "redact_addresses": counted(ADDRESS_TEXT, "s_suppkey", ADDRESSES, ("[ADDRESS]",)),
    "redact_dates": counted(DATE_TEXT, "o_orderkey", DATES, DATE_LABELS),
    "redact_passwords": counted(SECRET_TEXT, "c_custkey", PASSWORDS, SECRET_LABELS),
    "redact_document": _document(FULL_FIXED),
    "redact_document_ref": _document(FULL_REF),
    "redact_notes": counted(NOTES, "doc_id", FULL_FIXED, FULL_LABELS),
    "redaction_stats": STATS,
    "redaction_stats_cube": f"""SELECT lang, source, detector, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs
        FROM ({STATS}) GROUP BY CUBE (lang, source, detector)""",
    "length_change": f"""SELECT doc_id, CAST(len_before AS INTEGER) AS before, CAST(len_after AS INTEGER) AS after,
        CAST(len_after - len_before AS INTEGER) AS diff FROM ({COUNTS})""",
    "findings": _findings_of_all(DOCUMENTS),
    "findings_all": _findings_of_all(NOTES),
    "apply_findings": _applied(_findings_of_all(NOTES), NOTES),
    "recognize_dictionary": _known(),
    "entity_stats": f"""SELECT t.entity_type, count(f.entity_type) AS n FROM (SELECT unnest(['PERSON', 'EMAIL_ADDRESS',
        'PHONE_NUMBER', 'CREDIT_CARD', 'DOMAIN', 'DATE_TIME', 'LOCATION', 'NRP', 'IP_ADDRESS', 'US_SSN', 'US_BANK_NUMBER',
        'IBAN_CODE', 'US_DRIVER_LICENSE', 'CRYPTO', 'URL', 'COMPANY', 'MONEY', 'PASSWORD']) AS entity_type) t
        LEFT JOIN ({_known()}) f USING (entity_type) GROUP BY t.entity_type""",
    "redact_dictionary": _dictionary_redacted(),
    "redact_dictionary_joined": _applied(f"SELECT doc_id, start, \"end\", score, label FROM ({_labelled(SYMBOL_TEXTS)}) UNION ALL {_SYMBOLS}", SYMBOL_TEXTS),
    "redact_dictionary_turns": _dictionary_redacted("SELECT conv_id, turn, text AS t FROM conversations", "conv_id, turn"),
    "redact_many_keywords": counted("SELECT c_custkey, concat('By ', c_name, ' with c++ and .NET, not ', c_name, 'x or NETC++') AS t FROM customer",
        "c_custkey", [relabel("t", r"[\p{L}\p{N}_#]+(?:\+\+)?|\.NET",
                              r"CASE WHEN regexp_matches({h}, '^(Customer#[0-9]+|c\+\+|\.NET)$') THEN '[COMPANY_NAME]' ELSE {h} END")],
        ("[COMPANY_NAME]",)),
    "recognize_model": f"""SELECT doc_id, 'EMAIL_ADDRESS' AS entity_type, start, "end", match, CAST(0.9 AS DOUBLE) AS score
        FROM ({_matches('emails', 1, MODEL_EMAIL, "''")})""",
    "redact_entities": counted(DOCUMENTS, "doc_id", [replaced("t", MODEL_EMAIL, "[EMAIL]")], ("[EMAIL]",)),
    "findings_not_allowed": f"""SELECT * FROM ({_known()}) WHERE lower(match) NOT IN (
        SELECT keyword FROM ({GAZETTEER}) WHERE length(keyword) = 7 AND entity_type = 'COMPANY')""",
    "redact_lines": f"""SELECT b.doc_id, string_agg(t, chr(10) ORDER BY block_no) AS text,
        CAST(count(*) FILTER (trim(o, ' ' || chr(9) || chr(13)) <> '') AS INTEGER) AS n_blocks,
        CAST(count(*) FILTER (t <> o) AS INTEGER) AS n_changed
        FROM ({chain(BLOCKS, 'doc_id, block_no', FULL_FIXED)}) b GROUP BY b.doc_id""",
    "redact_blocks": f"""SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, 'body' AS kind, t AS redacted, t <> o AS changed
        FROM ({chain(BLOCKS, 'doc_id, block_no', FULL_FIXED)})""",
    "assemble_blocks": f"""SELECT doc_id, string_agg(t, chr(10) ORDER BY block_no) AS text,
        CAST(count(*) FILTER (trim(t, ' ' || chr(9) || chr(13)) <> '') AS INTEGER) AS n_blocks,
        CAST(count(*) FILTER (t <> o) AS INTEGER) AS n_changed
        FROM ({chain(BLOCKS, 'doc_id, block_no', FULL_FIXED)}) GROUP BY doc_id""",
    "redact_table": f"""SELECT c_custkey, max(CASE WHEN c = 'c_name' THEN t END) AS c_name, max(CASE WHEN c = 'email' THEN t END) AS email,
        max(CASE WHEN c = 'ip' THEN t END) AS ip, max(CASE WHEN c = 'note' THEN t END) AS note, any_value(c_nationkey) AS c_nationkey,
        any_value(c_acctbal) AS c_acctbal FROM ({chain(CELLS, 'c_custkey, c, c_nationkey, c_acctbal', FULL_FIXED)}) GROUP BY c_custkey""",
    "redact_nested": f"""SELECT event_id, any_value(k) AS k, any_value(type) AS type, max(CASE WHEN c = 'contact' THEN t END) AS contact,
        any_value(type) AS kind, max(CASE WHEN c = 'host' THEN t END) AS host, CAST(NULL AS VARCHAR) AS host_to,
        max(CASE WHEN c = 'note' THEN t END) AS note, max(CASE WHEN c = 'call' THEN t END) AS "call", any_value(value) AS value
        FROM ({chain(LEAVES, 'event_id, c, k, type, value', FULL_FIXED)}) GROUP BY event_id""",
    "redact_variant": f"""SELECT event_id, max(CASE WHEN c = 'mail' THEN t END) AS mail, any_value(number) AS number,
        max(CASE WHEN c = 'say' THEN t END) AS note, any_value(k) AS k FROM ({chain(VARIANT_LEAVES, 'event_id, c, number, k', FULL_FIXED)})
        GROUP BY event_id""",
    "redact_json_text": f"""SELECT event_id, t AS json, CAST({_sum_of(FULL_LABELS)} AS INTEGER) AS n, json_valid(t) AS is_json
        FROM ({chain(PRINTED, 'event_id', FULL_FIXED)})""",
    "redact_markup": f"SELECT page_id, t AS html, CAST(n AS INTEGER) AS n FROM ({made(PAGES, 'page_id', FULL_FIXED)})",
    "redact_markup_text": _text_nodes(),
    "redact_markup_joined": _joined_nodes(),
    "redact_nested_keys": _keyed_leaves(),
    "redact_conversations": counted(TURNS, "conv_id, turn", FULL_FIXED, FULL_LABELS),
    "conversation_totals": f"""SELECT conv_id, count(*) AS turns, CAST(sum(n) AS BIGINT) AS n
        FROM ({counted(TURNS, 'conv_id, turn', FULL_FIXED, FULL_LABELS)}) GROUP BY conv_id""",
    "method_chain": f"SELECT doc_id, text FROM ({_dictionary_redacted(chain(NOTES, 'doc_id', FULL_FIXED))})",
    "method_chain_model_first": f"SELECT doc_id, t AS text FROM ({chain('SELECT doc_id, text AS t FROM (' + _dictionary_redacted(NOTES) + ')', 'doc_id', FULL_FIXED)})",
    "profile_documents": _profile("documents", "doc_id", "text"),
    "profile_pages": _profile("pages", "page_id", "html", f", {_EXTENSION} AS extension"),
    "audit_detectors": f"""SELECT detector, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 0) AS docs, count(*) AS docs_total,
        count(*) FILTER (n > 0) / count(*) AS share FROM ({COUNTS_LONG}) GROUP BY detector""",
    "audit_columns": f"""SELECT "column", count(*) AS rows, detector, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 0) AS rows_hit,
        count(*) FILTER (n > 0) / count(*) AS share FROM (UNPIVOT (SELECT c AS "column", {', '.join(
            f"CAST({_sum_of(_LABELS[d])} - ({_sum_of(_LABELS[d], 'o')}) AS INTEGER) AS {d}" for d in BY_DETECTOR)}
        FROM ({chain(CELLS, 'c_custkey, c', FULL_FIXED)})) ON {', '.join(BY_DETECTOR)} INTO NAME detector VALUE n) GROUP BY "column", detector""",
    "riskiest_documents": f"""SELECT source, doc_id, n_total, CAST(rank AS INTEGER) AS rank FROM (SELECT source, doc_id,
        n_total, row_number() OVER (PARTITION BY source ORDER BY n_total DESC, doc_id) AS rank
        FROM (SELECT doc_id, CAST({' + '.join(BY_DETECTOR)} AS INTEGER) AS n_total FROM ({COUNTS})) JOIN documents USING (doc_id)
        WHERE n_total > 0) WHERE rank <= 3""",
    "distinct_values": f"""SELECT detector, count(*) AS n, count(DISTINCT match) AS values FROM ({_findings_of_all(NOTES)}) GROUP BY detector""",
    "top_values": f"""SELECT detector, match, count(*) AS n FROM ({_findings_of_all(NOTES)}) GROUP BY detector, match
        ORDER BY n DESC, detector, match LIMIT 20""",
    "residual_scan": f"""SELECT doc_id, n AS n_total FROM ({counted(
        chain(NOTES, 'doc_id', EMAILS + CARDS + MONEY), 'doc_id', FULL_FIXED, FULL_LABELS)}) WHERE n > 0""",
    "residual_scan_clean": f"""SELECT doc_id, n AS n_total FROM ({counted(
        chain(NOTES, 'doc_id', FULL_FIXED), 'doc_id', FULL_FIXED, FULL_LABELS)}) WHERE n > 0""",
    "luhn_valid": _cards(),
    "clean_documents": f"SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, text AS t, text AS o FROM documents) WHERE NOT ({ANY_RULE})",
    "documents_with_pii": f"SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, text AS t, text AS o FROM documents) WHERE {ANY_RULE}",
    "united_findings": _applied(f"""SELECT doc_id, start, "end", score, label FROM ({_findings_of_all(NOTES)}) UNION ALL
        SELECT doc_id, start, "end", score, label FROM ({_labelled(NOTES)}) UNION ALL
        SELECT doc_id, start, "end", CAST(0.9 AS DOUBLE), '[EMAIL]' FROM ({_matches('emails', 1, MODEL_EMAIL, "''", NOTES)})""", NOTES),
    "redact_blocks_chain": f"""SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, t AS redacted, t <> o AS changed
        FROM ({chain(BLOCKS, 'doc_id, block_no', CARDS + IPS + [replaced("t", MODEL_EMAIL, "[EMAIL]")])})""",
    "redact_user_rule": counted(MONEY_TEXT, "o_orderkey", [replaced("t", r"\border \d+\b", "[ORDER]"),
        relabel("t", r"\$(\d+),", "'[OVER:' || length({v}) || ']'", 1)], ("[ORDER]", "[OVER:")),
    "files_round_trip": f"""SELECT format, c_custkey, max(CASE WHEN c = 'c_name' THEN t END) AS c_name, max(CASE WHEN c = 'email' THEN t END) AS email,
        max(CASE WHEN c = 'ip' THEN t END) AS note FROM ({chain(FILE_CELLS, 'c_custkey, c', FULL_FIXED)}),
        (VALUES ('csv'), ('tsv'), ('json'), ('xml'), ('parquet')) AS f(format) GROUP BY format, c_custkey""",
    "files_as_documents": """SELECT role, conv_id // 1000 AS stretch, '.txt' AS extension, 'text/plain' AS mime_type, 'text' AS format, 'UTF-8' AS encoding,
        CAST(count(*) + 1 AS INTEGER) AS lines, CAST(sum(length(concat_ws(' ', 'turn', conv_id, turn)) + 1) AS BIGINT) AS chars
        FROM conversations GROUP BY 1, 2""",
    "run_metrics": f"""SELECT 'run-1' AS run_id, 'documents' AS job, detector, CAST(sum(n) AS BIGINT) AS n,
        count(*) FILTER (n > 0) AS docs, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(NULL AS DOUBLE) AS seconds
        FROM ({COUNTS_LONG}) JOIN ({NOTES}) USING (doc_id) GROUP BY detector""",
    "stream_counts": f"""WITH lines AS ({LOG_LINES}), marks AS (SELECT max(ts) FILTER (event_id % 50 > 1) - INTERVAL 1 HOUR AS first,
            max(ts) FILTER (event_id % 50 > 0) - INTERVAL 1 HOUR AS second, max(ts) - INTERVAL 1 HOUR AS last FROM events)
        SELECT window_start, detector, CAST(sum(n) AS BIGINT) AS n, count(*) AS events
        FROM (SELECT event_id, date_trunc('day', ts) AS window_start, d.detector, CASE d.detector WHEN 'emails' THEN len({found('t', EMAIL)})
            ELSE len(list_filter({found('t', IPV4)}, lambda h: {IPV4_LABEL.replace('{h}', 'h')} <> h)) END AS n
            FROM lines, (VALUES ('emails'), ('ips')) AS d(detector)), marks
        WHERE n > 0 AND window_start + INTERVAL 1 DAY <= last AND window_start + INTERVAL 1 DAY > CASE event_id % 50
            WHEN 0 THEN second WHEN 1 THEN first ELSE window_start END GROUP BY 1, 2""",
    "redact_stream": f"SELECT event_id, text, n FROM ({counted(LOG_LINES, 'event_id', FULL_FIXED, FULL_LABELS)})",
}
