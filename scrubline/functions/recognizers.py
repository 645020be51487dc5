"""Recognizers with a score: a pattern, a checksum where there is one, and the words around.

A match starts with the score of its pattern, where there is a checksum with that of
values for which it holds; one that fails drops the match. Words that go with such a value
raise the score, words that speak against it lower it, both together do neither. The checksums are arithmetic over columns, run in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from scrubline.functions.text import chunks, hits, let, offsets, piece, quote

AROUND = 40  # characters before a match, and behind it, in which words are looked for
RAISED = 0.35  # what a word adds or takes
LEAST_RAISED = 0.4  # the least score of a match that a word speaks for


@dataclass(frozen=True)
class Recognizer:
    """``score``: that of a match, for which the checksum holds if there is one. ``check``: SQL over ``value``, the match without blanks and hyphens, true where the checksum holds; ``None``: there
    is none. ``raising``, ``lowering``: words, in small letters. ``needs``: a cheap pattern without which nothing matches."""

    entity_type: str
    no: int
    pattern: str
    score: float
    check: str | None = None
    raising: tuple[str, ...] = ()
    lowering: tuple[str, ...] = ()
    needs: str | None = None


def _digit(value: str, at: str) -> str:
    return f"(ascii(substring({value}, {at}, 1)) - 48)"


def iban(value: str) -> str:
    """The country and check digits go to the end, letters count from 10: the number is 1 modulo 97."""
    letter = "ascii(substring(v, i, 1))"
    step = f"IF({letter} < 58, (acc * 10 + {letter} - 48) % 97, (acc * 100 + {letter} - 55) % 97)"
    turned = f"concat(substring({value}, 5), upper(substring({value}, 1, 4)))"
    return let("v", f"upper({turned})", f"aggregate(sequence(1, length(v)), 0, (acc, i) -> {step}) = 1")


def routing_number(value: str) -> str:
    """Nine digits weighed 3, 7, 1 add up to a multiple of ten; the first two name a district."""
    total = " + ".join(f"{w} * {_digit(value, str(i))}" for i, w in enumerate((3, 7, 1) * 3, 1))
    district = f"CAST(substring({value}, 1, 2) AS INT)"
    return (f"({total}) % 10 = 0 AND ({district} BETWEEN 1 AND 12 OR {district} BETWEEN 21 AND 32 "
            f"OR {district} BETWEEN 61 AND 72 OR {district} = 80)")


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"  # fixed value
_LIMB = 40  # bits of a limb; five of them hold the 25 bytes of an address


def base58check(value: str) -> str:
    """An address as a number of base 58 has 25 bytes, the last four of which begin the twice taken SHA-256 of the others."""
    mask, limbs = (1 << _LIMB) - 1, [f"l{i}" for i in range(5)]
    # limb by limb, the lowest first; what is over goes to the next
    body = "named_struct(" + ", ".join(f"'{name}', c{i} & {mask}L" for i, name in enumerate(limbs)) + ")"
    for i in reversed(range(5)):
        carry = f"locate(substring(v, i, 1), {quote(BASE58)}) - 1L" if i == 0 else f"shiftright(c{i - 1}, {_LIMB})"
        body = let(f"c{i}", f"n.l{i} * 58L + {carry}", body)
    zero = "named_struct(" + ", ".join(f"'{name}', 0L" for name in limbs) + ")"
    number = f"aggregate(sequence(1, length(v)), {zero}, (n, i) -> {body})"
    digits = "concat(" + ", ".join(f"lpad(hex(n.l{i}), {_LIMB // 4}, '0')" for i in reversed(range(5))) + ")"
    holds = "startswith(sha2(unhex(sha2(unhex(left(h, 42)), 256)), 256), lower(right(h, 8)))"
    return let("v", value, let("n", number, let("h", digits, holds)))


BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"  # fixed value
_GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)  # fixed values
_BECH32, _BECH32M = 1, 0x2BC830A3  # fixed values: what is left of an address of either kind


def bech32(value: str) -> str:
    """The remainder of the prefix and the digits of base 32 by the checksum's polynomial is one of two constants."""
    turned = " ^ ".join(["(shiftleft(c & 33554431L, 5))", "d", *(f"IF(shiftright(c, {25 + i}) & 1 = 1, {g}L, 0L)" for i, g in enumerate(_GENERATORS))])
    prefix = ", ".join(f"{n}L" for n in (3, 3, 0, 2, 3))  # of "bc"
    digits = f"concat(array({prefix}), transform(sequence(4, length(v)), i -> locate(substring(v, i, 1), {quote(BECH32)}) - 1L))"
    return let("v", f"lower({value})", f"aggregate({digits}, 1L, (c, d) -> {turned}) IN ({_BECH32}L, {_BECH32M}L)")


# Entity types as in functions.labels.ENTITY_LABELS.
RECOGNIZERS = (
    Recognizer("IBAN_CODE", 1, r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 1.0, iban("value"),
               ("iban", "bank", "account", "transfer"), needs=r"[A-Z]{2}\d{2}"),
    Recognizer("CRYPTO", 1, rf"(?<![A-Za-z0-9])[13][{BASE58}]{{25,34}}(?![A-Za-z0-9])", 1.0, base58check("value"), ("wallet", "btc", "bitcoin", "crypto"),
               needs="[13][A-Za-z0-9]{25}"),
    Recognizer("CRYPTO", 2, rf"(?<![A-Za-z0-9])(?:bc1[{BECH32}]{{11,71}}|BC1[{BECH32.upper()}]{{11,71}})(?![A-Za-z0-9])", 1.0, bech32("value"),
               ("wallet", "btc", "bitcoin", "crypto"), needs="bc1|BC1"),
    Recognizer("US_BANK_NUMBER", 1, r"(?<![\w.-])\d{4}-?\d{4}-?\d(?![\w-])", 0.5, routing_number("value"), ("routing", "aba", "bank", "transit", "rtn"),
               ("order", "invoice", "ticket", "version"), r"\d{4}-?\d{4}"),
    Recognizer("US_BANK_NUMBER", 2, r"(?<![\w.-])\d{8,17}(?![\w-])", 0.05, None, ("account", "acct", "bank", "checking", "saving", "deposit"),
               ("order", "invoice", "ticket", "version"), r"\d{8}"),
    Recognizer("US_DRIVER_LICENSE", 1, r"(?<![\w-])[A-Z]{1,2}-?\d{3}-?\d{3,4}-?\d{0,6}(?![\w-])", 0.3, None,
               ("driver", "licence", "license", "lic", "permit", "dl", "driving"), ("order", "invoice", "part", "model"), r"[A-Z]-?\d{3}"),
    Recognizer("US_DRIVER_LICENSE", 2, r"(?<![\w.-])\d{7,9}(?![\w-])", 0.05, None, ("driver", "licence", "license", "lic", "permit", "dl", "driving"),
               ("order", "invoice", "part", "model"), r"\d{7}"),
)


def _said(words: tuple[str, ...]) -> str:
    """Whether one of the words stands in ``near``, which is in small letters."""
    return f"near RLIKE {quote(r'(?<![a-z0-9])(?:' + '|'.join(words) + r')s?(?![a-z0-9])')}"


def scored(text: str, r: Recognizer) -> str:
    """SQL: the matches of a recognizer as an array of structs with their scores; NULL where there are none."""
    near = f"lower({piece('found.cut', f'greatest(start - {AROUND}, 0)', f'(start + length(hit) + {AROUND})')})"
    said, against = (f"({_said(words)})" if words else "false" for words in (r.raising, r.lowering))
    cases = [f"WHEN {said} AND NOT {against} THEN greatest(least({r.score}D + {RAISED}D, 1.0D), {LEAST_RAISED}D)",
             f"WHEN {against} AND NOT {said} THEN greatest({r.score}D - {RAISED}D, 0.0D)"]
    told = let("near", near, f"CASE {' '.join(cases)} ELSE {r.score}D END")
    checked = let("value", "regexp_replace(hit, '[ -]', '')", f"IF({r.check}, {told}, NULL)") if r.check else told
    one = (f"named_struct('entity_type', {quote(r.entity_type)}, 'recognizer_no', {r.no}, 'start', start, 'end', start + length(hit), "
           f"'match', hit, 'score', round({checked}, 4))")
    found = let("found", f"named_struct('gaps', split({text}, {quote(r.pattern)}, -1), 'hits', {hits(text, r.pattern)}, 'cut', {chunks(text)})",
                f"filter(zip_with({offsets('found.gaps', 'found.hits')}, found.hits, (start, hit) -> {one}), m -> m.score IS NOT NULL)")
    needs = f"{text} RLIKE {quote(r.needs)} AND " if r.needs else ""
    return f"CASE WHEN {needs}{text} RLIKE {quote(r.pattern)} THEN {found} END"
