"""What the key of a value tells about it: the name of a field, a map entry, a column.

A rule that looks for ``password: hunter22x`` finds nothing in a value that stands by
itself. So a value under a key that says what it holds is read with a phrase in front
that the rules know (``password: ``, ``date of birth: ``), which is taken off again if it is
still there; and a value under a key that names a secret is a secret as a whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from scrubline.functions.labels import ANY_LABEL
from scrubline.functions.text import let, quote


@dataclass(frozen=True)
class Context:
    """Keys whose normal form ends with ``words``; the ``phrase`` their values are read with. ``secret``: the label of the
    whole value, if it has six characters or more. None of it applies unless ``detector`` is chosen."""

    detector: str
    words: str
    phrase: str
    secret: str | None = None


# Patterns of normal forms (small letters, digits, single blanks), the first that matches counts.
CONTEXTS = (
    Context("passwords", "(password|passwd|pwd|passphrase|pass ?code)s?", "password: ", "[PASSWORD]"),
    Context("passwords", "(secret|secret ?key|client ?secret|credential|auth ?key|private ?key)s?", "secret_key: ", "[SECRET_OR_KEY]"),
    Context("passwords", "jwt", "", "[JWT_TOKEN]"),
    Context("passwords", "tokens?", "token: ", "[AUTH_TOKEN]"),
    Context("api_keys", "(api|access) ?keys?( id)?", "api_key: "),
    Context("credit_cards", "((credit|debit) ?)?(card|cc|visa|mastercard|amex|discover)( ?(number|num|no))?", "card number: "),
    Context("phones", "(phone|telephone|tel|cell|mobile|fax)( ?(number|num|no))?s?", "phone: "),
    Context("ids", "ssn|social security( number)?", "SSN: "),
    Context("ids", "passport( ?(number|num|no))?", "passport number: "),
    Context("ids", "(employee|emp|staff) ?(id|number|num|no)", "employee id: "),
    Context("ids", "tz|national ?id|id number|identity( number)?", "id number: "),
    Context("addresses", "address|residence|headquarters|hq", "address: "),
    Context("dates", "date ?of ?birth|birth ?date|birthday|dob|born", "date of birth: "),
    Context("dates", "(expiry|expires|expiration|valid until)( ?date)?", "date expires: "),
    Context("dates", "issued?( ?(date|on))?|date of issue|created on", "date issued: "),
    Context("money", "(cost|worth|amount|payment|fee|price|charge|income|revenue|profit|loss|salary|wage|fine|total)s?", "amount : "),
)
# Keys that tell nothing, so that the one around them counts.
PLAIN_KEYS = ("value", "values", "text", "string", "item", "items", "element", "entry", "data", "content", "raw", "plain")


def normal(key: str) -> str:
    """A key in small letters with single blanks between its words: ``dbPassword`` and ``DB-password`` are ``db password``."""
    return re.sub("[^a-z0-9]+", " ", re.sub("([a-z0-9])([A-Z])", r"\1 \2", key).lower()).strip()


def normal_sql(key: str) -> str:
    """SQL: the same. Letters beyond ASCII separate, in both."""
    spaced = f"lower(regexp_replace({key}, '([a-z0-9])([A-Z])', '$1 $2'))"
    return f"trim(regexp_replace({spaced}, '[^a-z0-9]+', ' '))"


def _applying(detectors: list[str]) -> list[tuple[int, Context]]:
    return [(i, c) for i, c in enumerate(CONTEXTS) if c.detector in detectors]


def _ending(words: str) -> str:
    return f"(^| )({words})$"


def of_key(key: str, around: int | None, detectors: list[str]) -> int | None:
    """Number of the context that a key gives its values; ``around``: that of the key it stands under."""
    name = normal(key)
    if name in PLAIN_KEYS:
        return around
    return next((i for i, c in _applying(detectors) if re.search(_ending(c.words), name)), None)


def of_key_sql(key: str, around: str, detectors: list[str]) -> str:
    """SQL: the same for a key that is known only when the job runs, as an INT or NULL."""
    applying = _applying(detectors)
    if not applying:
        return "CAST(NULL AS INT)"
    cases = " ".join(f"WHEN name RLIKE {quote(_ending(c.words))} THEN {i}" for i, c in applying)
    plain = ", ".join(quote(k) for k in PLAIN_KEYS)
    any_word = "|".join(f"({c.words})" for _, c in applying)
    # most keys are none of all: one pattern tells
    return let("name", normal_sql(key), f"CASE WHEN name IN ({plain}) THEN {around} WHEN NOT name RLIKE {quote(_ending(any_word))} THEN NULL {cases} END")


def with_phrase(value: str, context: str) -> str:
    """SQL: the value as the rules read it."""
    phrases = ", ".join(quote(c.phrase) for c in CONTEXTS)
    return f"IF({context} IS NULL OR {value} IS NULL, {value}, concat(array({phrases})[{context}], {value}))"


def without_phrase(value: str, done: str, context: str) -> str:
    """SQL: the redacted value from what the rules have made of it with its phrase, and of the ``value`` as it was."""
    phrases = ", ".join(quote(c.phrase) for c in CONTEXTS)
    secrets = ", ".join("CAST(NULL AS STRING)" if c.secret is None else quote(c.secret) for c in CONTEXTS)
    bare = let("phrase", f"array({phrases})[{context}]", f"IF(startswith({done}, phrase), substring({done}, length(phrase) + 1), {done})")
    # what the rules know more about keeps their label
    told = let("bare", bare, (
        f"CASE WHEN array({secrets})[{context}] IS NULL OR bare RLIKE {quote(f'^{ANY_LABEL}$')} THEN bare "
        f"WHEN startswith({value}, 'eyJ') THEN '[JWT_TOKEN]' WHEN length({value}) < 6 THEN bare ELSE array({secrets})[{context}] END"))
    return f"IF({context} IS NULL, {done}, {told})"
