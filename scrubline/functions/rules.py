"""The rule table: twelve detectors, two profiles.

``ref`` finds exactly what the established rules find, including their known
oddities. ``fixed`` is the profile for users: the oddities are put right, the
detectors run in an order in which they do not eat each other's input, and no
pass looks inside a label an earlier pass has written.

Notes on the Java dialect:

* ``(?U)`` makes ``\\w \\d \\s \\b`` Unicode-aware; ``(?iU)`` also folds case for
  every script; ``(?d)`` limits the line ends ``.`` stops at to ``\\n``.
* Java recurses once per round of a repeated group, so a text with thousands of
  dotted labels or words overflows the stack. Such repeats are written
  possessively, round by round up to the last place from which the rest of the
  pattern still matches. That finds the same text without recursion.
* What follows the first street type of a line holds all that follows a later
  one, so the search for a postal code after it need not be tried again: the
  group is atomic, and the cost linear.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from scrubline.functions import labels

DETECTORS = ("company_names", "emails", "domains", "api_keys", "credit_cards", "money",
             "phones", "ids", "ips", "addresses", "dates", "passwords")

ORDER = {
    "ref": DETECTORS,
    "fixed": ("emails", "company_names", "domains", "api_keys", "passwords", "credit_cards",
              "ips", "ids", "dates", "addresses", "money", "phones"),
}
PROFILES = tuple(ORDER)

@dataclass(frozen=True)
class Rule:
    """One pattern with the label of its matches.

    ``constant``: the label of every match; otherwise ``label`` is a SQL expression
    (see ``functions.labels``) and ``group`` the one that captures its ``value``.
    ``needs``: literals of which a text must hold one for the pattern to be able
    to match, ``needs_words`` the same in any case, ``needs_pattern`` a cheap pattern, ``needs_digits`` a number of digits,
    ``needs_runs`` a pattern that the runs of digits must match, parted by blanks (see ``functions.passes``);
    without them the costly search is skipped. ``around``: the label looks at the neighbourhood.
    """

    detector: str
    no: int
    pattern: str
    constant: str | None = None
    label: str = ""
    group: int = 0
    needs: tuple[str, ...] = ()
    needs_words: tuple[str, ...] = ()
    needs_pattern: str | None = None
    needs_digits: int = 0
    needs_runs: str | None = None
    around: bool = False


# ---------------------------------------------------------------------------
# The patterns of the twelve detectors, profile ``ref``.
# ---------------------------------------------------------------------------

_DOTTED = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\."


def _dotted_then(end: str) -> str:
    """One or more dotted labels up to the last dot that ``end`` follows, then ``end``."""
    return rf"(?:(?:{_DOTTED}(?!{end}))*+{_DOTTED}(?={end}))++{end}"


_LOCAL = r"[a-zA-Z0-9!#$%&'*+/=?^_`{|}~.-]"
EMAIL = rf"(?U)(?:\G|(?<!{_LOCAL})){_LOCAL}++@" + _dotted_then(r"[a-zA-Z]{2,6}")

DOMAIN = r"(?U)(?<![@\w\[])(?:https?://)?(?:www\.)?" + _dotted_then(r"[a-zA-Z]{2,63}(?!\w)")

API_KEYS = (
    r"""(?iU)\b(?:api_key|apikey|api-key|access_key|access-key|secret_key|secret-key|token)\s*[:=]\s*["']?([a-zA-Z0-9_/+.-]{16,128})["']?""",
    r"(?U)\bAKIA[0-9A-Z]{16}\b",
    r"(?U)\b(A3T[A-Z0-9]|AMZN|ASCA|AGPA)[A-Z0-9]{8,}\b",
    r"(?U)\bAIza[0-9A-Za-z\\-_]{35}\b",
    r"(?iU)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"(?U)\b(?:sk|pk)_(?:live|test)_[0-9a-zA-Z]{24,}\b",
    r"(?U)\bgh[pousr]_[a-zA-Z0-9]{36,255}\b",
    r"(?U)\bxox[baprs]-[0-9a-zA-Z-]{10,}\b",
    r"(?U)\b(EAACEdEose0cBA[0-9A-Za-z]+)\b",
    r"(?U)\b[A-Za-z0-9/+]{30,}={0,2}\b",
)

_CARD_END = r"(?!\d)(?!\s*\[(?:YEAR|DATE|ID_NUMBER|PHONE))(?!\s*\[CC_EXPIRY])"
CREDIT_CARDS = (
    r"(?U)(?<!\d)4\d{3}(?:[\s-]?\d{4}){2}[\s-]?\d{1,4}" + _CARD_END,
    r"(?U)(?<!\d)(?:5[1-5]\d{2}|222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)(?:[\s-]?\d{4}){3}" + _CARD_END,
    r"(?U)(?<!\d)3[47]\d{2}(?:(?:[\s-]?\d{6}[\s-]?\d{5})|(?:(?:[\s-]?\d{4}){2}[\s-]?\d{3}))" + _CARD_END,
    r"(?U)(?<!\d)(?:6011|622(?:1(?:2[6-9]|[3-9]\d)|[2-8]\d{2}|9(?:[01]\d|2[0-5]))|64[4-9]\d|65\d{2})(?:[\s-]?\d{4}){3}" + _CARD_END,
    r"(?iU)(?:credit|debit|card|cc|visa|mastercard|amex|discover)\s*(?:number|num|#)?\s*[:=-]?\s*((?:\d[\s-]*){12,19}\d)" + _CARD_END,
)

_AMOUNT = r"[0-9]{1,3}(?:,\d{3})*(?:\.\d{1,2})?"
MONEY = (
    rf"(?U)(?<!\w)\$\s*{_AMOUNT}(?!\d)",
    rf"(?iU)(?<!\w){_AMOUNT}\s*(?:dollars|USD|US\$)(?!\w)",
    rf"(?U)(?<!\w)₪\s*{_AMOUNT}(?!\d)",
    rf"(?iU)(?<!\w){_AMOUNT}\s*(?:shekels?|ILS|NIS)(?!\w)",
    rf"(?iU)(?<!\w)(?:NIS|ILS)\s*{_AMOUNT}(?!\d)",
    rf"(?iU)(?<!\w)(?:EUR|GBP|JPY|CHF|AUD|CAD|CNY)\s*{_AMOUNT}(?!\d)",
    rf"(?U)(?<!\w)€\s*{_AMOUNT}(?!\d)",
    rf"(?U)(?<!\w)£\s*{_AMOUNT}(?!\d)",
    rf"(?iU)(?:costs?|worth|value|amount|payment|fee|price|charge|rate|income|revenue|profit|loss|salary|wage|fine|total)\s+(?:is|of|:)?\s*(?:\$|₪|€|£)?\s*{_AMOUNT}\s*(?:dollars|USD|shekels?|ILS|NIS|euros?|EUR|GBP|pounds?)?",
)

PHONES = (
    r"(?U)(?<!\d)(?:\+\d{1,4}[\s.-]?)?(?:\(?\d{1,4}\)?[\s.-]?)?\d{2,4}[\s.-]?\d{2,4}[\s.-]?\d{2,4}(?!\d)",
    r"(?U)(?<!\d)0(?:5\d|7[234678])(?:[\s.-]?\d{3}[\s.-]?\d{4}|[\s.-]?\d{7})(?!\d)",
    r"(?U)(?<!\d)0[23489](?:[\s.-]?\d{3}[\s.-]?\d{4}|[\s.-]?\d{7})(?!\d)",
    r"(?U)(?<!\d)(?:\(\d{3}\)[\s.-]?|\d{3}[\s.-]?)\d{3}[\s.-]?\d{4}(?!\d)",
    r"(?iU)(?:phone|tel|cell|mobile|fax)\s*(?:number|num|#)?\s*[:=-]?\s*((?:\+\d{1,3}[\s.-]?)?(?:\(\d+\)[\s.-]?)?[\d\s.-]{7,17}\d)(?!\d)",
)

IDS = (
    r"(?iU)(?:\b(?:TZ|T\.Z\.|ID|id number|ת\.ז\.|תעודת זהות)\s*[:=-]?\s*)?(\b\d{9}\b)(?!\d)",
    r"(?iU)(?:\bSSN\s*[:=-]?\s*)?(\b\d{3}[\s.-]?\d{2}[\s.-]?\d{4}\b)(?!\d)",
    r"(?iU)\b(?:passport\s*(?:number|no)?\.?\s*[:=-]?\s*)([A-Z0-9]{6,15})\b",
    r"(?U)\b(?!AKIA)[A-Z]{1,2}\d{6,9}\b",
    r"(?iU)\b(?:employee|emp|staff)\s*(?:id|number|#)\s*[:=-]?\s*([A-Za-z0-9\-_]{4,15})\b",
)

IPV4 = r"(?U)\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
IPV6 = (r"(?U)\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
        r"|\b(?:[0-9a-fA-F]{1,4}:){1,7}:(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}\b"
        r"|::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b")

_STREET = (r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Circle|Cir|Place|Pl"
           r"|Square|Sq|Terrace|Ter|Way|Highway|Hwy|Parkway|Pkwy|Route|Rte|Trail|Trl)")
_NAME = r"[A-Z][a-z]+\s+"
_TO_STREET = rf"(?:(?!{_STREET}\b){_NAME})*+{_STREET}\b"
ADDRESSES = (
    # number, one name, then names up to the last street type they lead to
    rf"(?iU)\b\d+\s+{_NAME}{_TO_STREET}(?:\s+{_TO_STREET})*+",
    r"(?iU)\b\d+\s+(?:[A-Z][a-z]+\s+){1,3}[A-Z][a-z]+\b",
    r"(?iU)\bP\.?O\.?\s*Box\s+\d+\b",
    rf"(?idU)(?:address|location|office|hq|headquarters|residence|property)\s*[:=-]?\s*(\d+\s+(?>.*?{_STREET}).*?\b\d{{5}}(?:-\d{{4}})?\b)",
    r"""(?iU)\b(?:רחוב|רח\.?|שדרות|שד\.?|דרך|סמטה|כיכר)\s+[א-ת\s."'-]+\s+\d+(?:[/\-]\d+)?[א-ת]?\b""",
)

_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
DATES = (
    rf"(?U)\b(?<!\d){_DAY}([/.-])(?:0?[1-9]|1[0-2])\1(?:\d{{4}}|\d{{2}})\b(?!\d)",
    rf"(?U)\b(?<!\d)\d{{4}}([/.-])(?:0?[1-9]|1[0-2])\1{_DAY}\b(?!\d)",
    rf"(?iU)\b{_DAY}\s+{_MONTH}[a-z]*\.?\s+(?:\d{{4}}|\d{{2}})\b",
    rf"(?iU)\b{_MONTH}[a-z]*\.?\s+{_DAY},?\s+(?:\d{{4}}|\d{{2}})\b",
    rf"(?iU)(?:date\s*(?:of|of birth|issued|valid|expires|expiry|from|until|through)|dob)\s*[:=-]?\s*(\b(?:[0-9]+(?:st|nd|rd|th)?\s)?{_MONTH}[a-z]*\.?\s\d+[\s,]*\d{{2,4}}\b|\b\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}\b|\b\d{{4}}[/.-]\d{{1,2}}[/.-]\d{{1,2}}\b)",
)

_SECRET_WORD = r"(?:password|passwd|pwd|passphrase|pass[\s_]?code|secret|credential|token|auth_key|private_key)"
_SECRET_CHAR = r"""[A-Za-z0-9!@#$%^&*()_+\-=\[\]{};:'",.<>\/?~`]"""
PASSWORDS = (
    # as it stands: one character followed by the literal text "6, 64"
    rf"""(?iU)\b{_SECRET_WORD}\s*[:=]\s*["']?({_SECRET_CHAR}(6, 64))["']?""",
    rf"(?iU)<{_SECRET_WORD}>([^<]+)</{_SECRET_WORD}>",
    rf"""(?iU)["']{_SECRET_WORD}["']\s*:\s*["']([^"']{{6,64}})["']""",
    r"(?U)eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{10,})?",
)

# ---------------------------------------------------------------------------
# Profile ``fixed``: the patterns that differ.
# ---------------------------------------------------------------------------

_FULL_AMOUNT = r"[0-9]+(?:,\d{3})*(?:\.\d{1,2})?"
FIXED_PATTERNS = {
    ("api_keys", 4): r"(?U)\bAIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])",
    # any capitalised words after a number, but not a month
    ("addresses", 2): rf"(?U)\b\d+\s+(?!{_MONTH}[a-z]*\b)(?:[A-Z][a-z]+\s+){{1,3}}[A-Z][a-z]+\b",
    # between dots only a four-digit year makes a date of three numbers
    ("dates", 1): rf"(?U)\b(?<!\d){_DAY}(?:([/-])(?:0?[1-9]|1[0-2])\1(?:\d{{4}}|\d{{2}})|\.(?:0?[1-9]|1[0-2])\.\d{{4}})\b(?!\d)",
    ("passwords", 1): rf"""(?iU)\b{_SECRET_WORD}\s*[:=]\s*["']?({_SECRET_CHAR}{{6,64}})["']?""",
}
for _no in range(1, 10):
    FIXED_PATTERNS["money", _no] = MONEY[_no - 1].replace(_AMOUNT, _FULL_AMOUNT)
# the number must not be cut short, whether a currency word follows or not
FIXED_PATTERNS["money", 9] = FIXED_PATTERNS["money", 9].replace(_FULL_AMOUNT, _FULL_AMOUNT + r"(?!\d)")

# Literals without which a pattern cannot match.
_NEEDS: dict[tuple[str, int], tuple[str, ...]] = {
    ("emails", 1): ("@",),
    ("domains", 1): (".",),
    ("api_keys", 1): (":", "="),
    ("api_keys", 2): ("AKIA",),
    ("api_keys", 3): ("A3T", "AMZN", "ASCA", "AGPA"),
    ("api_keys", 4): ("AIza",),
    ("api_keys", 5): ("-",),
    ("api_keys", 6): ("_",),
    ("api_keys", 7): ("_",),
    ("api_keys", 8): ("xox",),
    ("api_keys", 9): ("EAACEdEose0cBA",),
    ("money", 1): ("$",),
    ("money", 3): ("₪",),
    ("money", 7): ("€",),
    ("money", 8): ("£",),
    ("ips", 2): (":",),
    ("addresses", 5): ("רח", "שד", "דרך", "סמטה", "כיכר"),
    ("passwords", 1): (":", "="),
    ("passwords", 2): ("</",),
    ("passwords", 3): (":",),
    ("passwords", 4): (".eyJ",),
}
_NEEDS_PATTERN = {("ips", 1): r"[0-9]\.[0-9]", ("ips", 2): "::|[0-9a-fA-F]:[0-9a-fA-F]", ("domains", 1): r"\.[a-zA-Z]"}
# Words, in lower case, without which a pattern that ignores case cannot match.
_NEEDS_WORDS = {
    ("ids", 3): ("passport",),
    ("ids", 5): ("emp", "staff"),
    ("credit_cards", 5): ("credit", "debit", "card", "cc", "visa", "amex", "discover"),
    ("money", 2): ("dollars", "usd", "us$"),
    ("money", 4): ("shekel", "ils", "nis"),
    ("money", 5): ("nis", "ils"),
    ("money", 6): ("eur", "gbp", "jpy", "chf", "aud", "cad", "cny"),
    ("money", 9): ("cost", "worth", "value", "amount", "payment", "fee", "price", "charge", "rate", "income", "revenue", "profit", "loss",
                   "salary", "wage", "fine", "total"),
    ("phones", 5): ("phone", "tel", "cell", "mobile", "fax"),
    ("dates", 3): ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"),
    ("dates", 4): ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"),
    ("dates", 5): ("date", "dob"),
    ("addresses", 3): ("box",),
    ("addresses", 4): ("address", "location", "office", "hq", "headquarters", "residence", "property"),
}
# The fewest digits a match can have, pattern by pattern.
_NEEDS_DIGITS = {
    "credit_cards": (13, 16, 15, 16, 13), "money": (1,) * 9, "phones": (6, 10, 9, 10, 1), "ids": (9, 9, 0, 6, 0),
    "ips": (4, 0), "addresses": (1, 1, 1, 6, 1), "dates": (4, 6, 3, 3, 3),
}

# What the runs of digits of a match look like, or of a part of it, one blank for whatever stands between two of them: profile
# ``fixed``. In ``ref`` later passes may match what labels have brought.
_NEEDS_RUNS = {key: runs.replace("N", r"\p{Nd}") for key, runs in {
    ("credit_cards", 1): "4N{3}(?: ?N{4}){2} ?N",
    ("credit_cards", 2): "N{4}(?: ?N{4}){3}",
    ("credit_cards", 3): "N{4}(?: ?N{6} ?N{5}|(?: ?N{4}){2} ?N{3})",
    ("credit_cards", 4): "N{4}(?: ?N{4}){3}",
    ("credit_cards", 5): "N(?: ?N){12}",
    ("phones", 1): "N{2,4} ?N{2,4} ?N{2}",
    ("phones", 2): "0N{2} ?N{3} ?N{4}",
    ("phones", 3): "0N ?N{3} ?N{4}",
    ("phones", 4): "N{3} ?N{3} ?N{4}",
    ("ids", 1): "N{9}",
    ("ids", 2): "N{3} ?N{2} ?N{4}",
    ("ids", 4): "N{6}",
    ("ips", 1): "N N{1,3} N{1,3} N",
    ("dates", 1): "N N{1,2} N{2}",
    ("dates", 2): "N{4} N{1,2} N",
    ("dates", 3): "N N{2}",
    ("dates", 4): "N N{2}",
}.items()}

_LABELS = {
    "emails": labels.email,
    "domains": labels.domain,
    "api_keys": labels.api_key,
    "credit_cards": labels.credit_card,
    "phones": labels.phone,
    "ids": labels.identity_number,
    "ips": labels.ipv4,
    "dates": labels.date,
    "passwords": labels.password,
}
_CONSTANTS = {
    "company_names": "[COMPANY_NAME]",
    "money": "[MONEY]",
    "addresses": "[ADDRESS]",
    ("ips", 2): "[IPV6_ADDRESS]",
}
# Rules whose first group holds the value that decides the label.
_GROUP_ONE = frozenset({("api_keys", 1), ("api_keys", 3), ("api_keys", 9), ("credit_cards", 5), ("phones", 5),
                        ("ids", 1), ("ids", 2), ("ids", 3), ("ids", 5), ("addresses", 4), ("dates", 5),
                        ("passwords", 1), ("passwords", 2), ("passwords", 3)})


_PATTERNS: dict[str, Sequence[str]] = {
    "emails": (EMAIL,), "domains": (DOMAIN,), "api_keys": API_KEYS, "credit_cards": CREDIT_CARDS,
    "money": MONEY, "phones": PHONES, "ids": IDS, "ips": (IPV4, IPV6), "addresses": ADDRESSES,
    "dates": DATES, "passwords": PASSWORDS,
}


def _either(rests: Sequence[tuple[str, str]]) -> str:
    """A pattern for the first of the strings (with what must follow each) that matches, common beginnings taken out.

    Strings that go on with different characters exclude each other, so only one that
    ends here has a place in the order: after those before it, before those after it.
    """
    if len(rests) == 1:
        rest, after = rests[0]
        return "".join(rf"\Q{c}\E" if c != "\\" else r"\\" for c in rest) + after
    ended = next((i for i, (rest, _) in enumerate(rests) if not rest), None)
    if ended is not None:
        parts = [_either(own) for own in (rests[:ended], rests[ended + 1:]) if own]
        return "(?:" + "|".join([*(parts[:1] if ended else []), rests[ended][1], *parts[1 if ended else 0:]]) + ")"
    groups: dict[str, list[tuple[str, str]]] = {}
    for rest, after in rests:
        groups.setdefault(rest[0].lower(), []).append((rest[1:], after))
    branches = [(rf"\Q{c}\E" if c != "\\" else r"\\") + _either(own) for c, own in groups.items()]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def keyword_rule(keywords: Sequence[str], profile: str = "fixed") -> Rule | None:
    """Case-insensitive search for the keywords of a list of any length, the first in the list first.

    Common beginnings are taken out, so that a long list is not tried one by one. In
    profile ``ref`` a keyword ends at word boundaries on both sides; in ``fixed`` a side
    that is no word character (``C++``) needs none.
    """
    words = list(dict.fromkeys(k for k in keywords if k))
    if not words:
        return None
    sides: dict[str, list[tuple[str, str]]] = {}
    for word in words:
        left, right = (r"\b", r"\b") if profile == "ref" else (
            r"(?<!\w)" if _is_word(word[0]) else "", r"(?!\w)" if _is_word(word[-1]) else "")
        sides.setdefault(left, []).append((word, right))
    pattern = "|".join(left + _either(own) for left, own in sides.items())
    return Rule("company_names", 1, "(?iU)" + pattern, _CONSTANTS["company_names"])


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def rules(profile: str = "fixed", keywords: Sequence[str] = (), detectors: Iterable[str] | None = None,
          extra: Sequence[Rule] = ()) -> list[Rule]:
    """The rules of ``profile`` in the order in which they are applied.

    ``detectors`` limits the choice, ``extra`` adds a user's own rules at the end
    of their detector (or, for a detector of their own, of the list).
    """
    if profile not in ORDER:
        raise ValueError(f"unknown profile {profile!r}, expected one of {PROFILES}")
    chosen = set(ORDER[profile]) | {r.detector for r in extra}
    if detectors is not None:
        unknown = set(detectors) - chosen
        if unknown:
            raise ValueError(f"unknown detectors {sorted(unknown)}")
        chosen = set(detectors)
    own = list(dict.fromkeys(r.detector for r in extra if r.detector not in DETECTORS))
    table: list[Rule] = []
    for detector in (*ORDER[profile], *own):
        if detector not in chosen:
            continue
        if detector == "company_names":
            rule = keyword_rule(keywords, profile)
            table.extend([rule] if rule else [])
        for no, pattern in enumerate(_PATTERNS.get(detector, ()), start=1):
            key = (detector, no)
            group = 1 if key in _GROUP_ONE else 0
            constant = _CONSTANTS.get(key, _CONSTANTS.get(detector))
            table.append(Rule(
                detector, no,
                FIXED_PATTERNS.get(key, pattern) if profile == "fixed" else pattern,
                constant,
                "" if constant else _LABELS[detector]("value" if group else "hit"),
                group,
                needs=_NEEDS.get(key, ()),
                needs_words=_NEEDS_WORDS.get(key, ()),
                needs_pattern=_NEEDS_PATTERN.get(key),
                needs_digits=_NEEDS_DIGITS[detector][no - 1] if detector in _NEEDS_DIGITS else 0,
                needs_runs=_NEEDS_RUNS.get(key) if profile == "fixed" and not extra else None,
                around=detector == "dates"))
        table.extend(r for r in extra if r.detector == detector)
    return table


def user_rule(detector: str, pattern: str, constant: str | None = None, label: str = "", group: int = 0,
              no: int = 100) -> Rule:
    """A rule of the user's own: a Java regular expression and a constant label or a SQL expression for it."""
    if (constant is None) == (label == ""):
        raise ValueError("give either a constant label or a SQL expression")
    return Rule(detector, no, pattern, constant, label, group)
