"""Rules as SQL expressions: one pass over a text, and all matches of a rule."""

from __future__ import annotations

from collections.abc import Sequence

from scrubline.functions.labels import ANY_LABEL, DATE_PURPOSES
from scrubline.functions.rules import Rule
from scrubline.functions.text import any_contains, chunks, hits, interleave, let, offsets, piece, quote

AROUND = 30  # fixed value: characters on either side of a date that tell its purpose


def digits(runs: str) -> str:
    """How many digits a text has, from its runs of digits."""
    return f"length(replace({runs}, ' ', ''))"


def digit_runs(text: str) -> str:
    """The runs of digits of a text, with a blank for what stands between."""
    return f"CASE WHEN {text} RLIKE {quote(r'\p{Nd}')} THEN regexp_replace({text}, {quote(r'\P{Nd}+')}, ' ') ELSE '' END"


# Letters that a pattern that ignores case takes for an ASCII letter, though in lower case they are none.
_FOLDED = {"s": "ſ", "i": "İı"}


def _any_word(text: str, words: Sequence[str]) -> str:
    """Whether one of the words, in lower case, stands in the text in any case."""
    odd = "".join(more for letter, more in _FOLDED.items() if any(letter in w for w in words))
    return "(" + " OR ".join([let("low", f"lower({text})", any_contains("low", words)), *(f"contains({text}, '{c}')" for c in odd)]) + ")"


def may_match(text: str, rule: Rule, n_digits: str, runs: str) -> str:
    """Whether the rule matches anywhere, the cheap tests first."""
    tests = [f"{n_digits} >= {rule.needs_digits}"] if rule.needs_digits else []
    if rule.needs_runs:
        tests.append(f"{runs} RLIKE {quote(rule.needs_runs)}")
    if rule.needs:
        tests.append(any_contains(text, rule.needs))
    if rule.needs_words:
        tests.append(_any_word(text, rule.needs_words))
    tests += [f"{text} RLIKE {quote(p)}" for p in (rule.needs_pattern, rule.pattern) if p]
    return " AND ".join(tests)


# A character that hardly any text holds, to take a text apart at.
_MARK = "\x00"


def _split(text: str, pattern: str) -> str:
    """The text between the matches. ``split`` compiles its pattern for every text, ``regexp_replace`` once; at a single
    character it compiles none."""
    marked = f"split(regexp_replace({text}, {quote(pattern)}, {quote(_MARK)}), {quote(_MARK)}, -1)"
    return f"IF(contains({text}, {quote(_MARK)}), split({text}, {quote(pattern)}, -1), {marked})"


def _decide(text: str, rule: Rule, result: str, context: str, pattern: str, kept: str = "", found: str = "") -> str:
    """``result``, an expression over ``label`` and ``hit``, for every match of ``pattern`` in a text.

    The neighbourhood of a match is read from ``context`` at its offset in ``text``.
    ``kept`` is a pattern of matches that are to stay, ``found`` all matches, where they are known already.
    """
    found = found or hits(text, pattern)
    label = quote(rule.constant) if rule.constant is not None else f"({rule.label})"
    decided = let("label", f"CASE WHEN NOT hit RLIKE {quote(kept)} THEN {label} END" if kept else label, result)
    if rule.around:
        # where no such word stands anywhere in the text, what stands around a match need not be known
        plain = f"transform({found}, hit -> {let('around', 'CAST(NULL AS STRING)', decided)})"
        near = piece("found.context", f"greatest(start - {AROUND}, 0)", f"(start + length(hit) + {AROUND})")
        placed = let("found", f"named_struct('gaps', {_split(text, pattern)}, 'hits', {found}, "
                              f"'context', {chunks(context)})",
                     f"zip_with({offsets('found.gaps', 'found.hits')}, found.hits, "
                     f"(start, hit) -> {let('around', near, decided)})")
        return f"CASE WHEN lower({context}) RLIKE '{'|'.join(DATE_PURPOSES.values())}' THEN {placed} ELSE {plain} END"
    if rule.group:
        return f"zip_with({found}, {hits(text, pattern, rule.group)}, (hit, value) -> {decided})"
    return f"transform({found}, hit -> {decided})"


def start(text: str, profile: str, marks: str | None = None) -> str:
    """State of one text: ``t`` as redacted so far, ``c`` the number of the detector
    of every replacement, ``d`` how many digits there are, ``r`` their runs, ``p`` the places of ``marks``
    (offsets in ascending order), if there are any to be kept.

    Profile ``ref`` reads the purpose of a date from the original, kept in ``o``.
    NULL becomes the empty text. No rule matches the digits labels bring into a
    text, so they are counted only once; nor does any join what stood around a match,
    so the runs of digits are those of the original.
    """
    original = (f", 'o', coalesce({text}, '')" if profile == "ref" else "") + (f", 'p', {marks}" if marks else "")
    return let("runs", digit_runs(f"coalesce({text}, '')"), (
            f"named_struct('t', coalesce({text}, ''), 'c', CAST(array() AS ARRAY<INT>), "
            f"'d', {digits('runs')}, 'r', runs{original})"))


def _moved(marks: str, text: str, pattern: str) -> str:
    """The places of marks after the matches of ``pattern`` in a text have become what ``new`` says; what stood within a
    replaced match stands behind its label."""
    spans = let("found", f"named_struct('gaps', {_split(text, pattern)}, 'hits', {hits(text, pattern)})",
                let("starts", offsets("found.gaps", "found.hits"), (
                    "filter(transform(found.hits, (h, i) -> named_struct('start', starts[i], 'end', starts[i] + length(h), "
                    "'more', length(new[i].w) - length(h), 'y', new[i].y)), m -> m.y)")))
    after = let("before", "filter(spans, m -> m.start < o)", (
        "IF(size(before) = 0, o, greatest(o, element_at(before, -1).end) + aggregate(before, 0, (n, m) -> n + m.more))"))
    return f"IF(size({marks}) = 0, {marks}, {let('spans', spans, f'transform({marks}, o -> {after})')})"


def apply_rule(state: str, rule: Rule, detector_no: int, profile: str, marks: bool = False) -> str:
    """The state after one more pass; untouched where the rule finds nothing.

    In profile ``fixed`` the labels of earlier passes are matched along with the
    rule and stay as they are, so no rule ever starts inside a label.
    """
    text = f"{state}.t"
    rest = f"'d', {state}.d, 'r', {state}.r" + (f", 'o', {state}.o" if profile == "ref" else "")
    if profile == "ref":
        pattern, kept, context = rule.pattern, "", f"{state}.o"
    else:
        pattern, kept, context = f"{ANY_LABEL}|{rule.pattern}", f"^{ANY_LABEL}$", text
    written = _decide(text, rule, "named_struct('w', coalesce(label, hit), 'y', label IS NOT NULL)",
                      context, pattern, kept)
    new = let("new", written, (
        f"named_struct('t', {interleave(_split(text, pattern), 'new.w')}, 'c', concat({state}.c, "
        f"array_repeat({detector_no}, size(array_remove(new.y, false)))), {rest}"
        f"{f", 'p', {_moved(f'{state}.p', text, pattern)}" if marks else ''})"))
    if rule.constant is not None and not marks:
        # one plain replacement where there is no label to be kept
        label = rule.constant.replace("\\", "\\\\").replace("$", "\\$")
        plain = (f"named_struct('t', regexp_replace({text}, {quote(rule.pattern)}, {quote(label)}), 'c', "
                 f"concat({state}.c, array_repeat({detector_no}, regexp_count({text}, {quote(rule.pattern)}))), {rest})")
        new = f"CASE WHEN contains({text}, '[') AND {text} RLIKE {quote(ANY_LABEL)} THEN {new} ELSE {plain} END" if kept else plain
    return f"CASE WHEN {may_match(text, rule, f'{state}.d', f'{state}.r')} THEN {new} ELSE {state} END"


def counts(state: str, n_detectors: int) -> str:
    """Replacements per detector, from the state."""
    return (f"transform(sequence(0, {max(n_detectors - 1, 0)}), "
            f"no -> size(filter({state}.c, c -> c = no)))")


def matches(parts: str, rule: Rule) -> str:
    """All matches of one rule, as an array of finding structs, in the parts ``t`` of a text, which begin at ``at`` and have
    ``d`` digits in runs ``r``."""
    value = hits("part.t", rule.pattern, rule.group) if rule.group else "found.hits"
    of_all = (f"named_struct('starts', {offsets('found.gaps', 'found.hits')}, 'values', {value}, "
              f"'labels', {_decide('part.t', rule, 'label', 'part.t', rule.pattern, found='found.hits')})")
    # the matches are searched for once
    found = let("found", f"named_struct('gaps', {_split('part.t', rule.pattern)}, 'hits', {hits('part.t', rule.pattern)})", let("known", of_all, (
        "filter(transform(found.hits, (hit, i) -> named_struct('start', part.at + known.starts[i], 'match', hit, "
        "'value', known.values[i], 'label', known.labels[i])), m -> m.label IS NOT NULL)")))
    meets = f"filter({parts}, part -> {may_match('part.t', rule, 'part.d', 'part.r')})"
    return (f"transform(flatten(transform({meets}, part -> {found})), (m, i) -> named_struct("
            f"'detector', {quote(rule.detector)}, 'rule_no', {rule.no}, 'ord', i, 'start', m.start, "
            f"'end', m.start + length(m.match), 'match', m.match, 'value', m.value, 'label', m.label))")
