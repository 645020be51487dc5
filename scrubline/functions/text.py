"""SQL fragments the rules are compiled with. Everything here stays in the JVM.

A rule is a few dozen nested functions. They are written as SQL text, which the
JVM parses in one go; built from ``Column`` objects, all rules together would
take some 5,000 calls from Python and half a minute before the job starts.
"""

from __future__ import annotations

from collections.abc import Sequence

_CHUNK_SHIFT = 9
_CHUNK = 1 << _CHUNK_SHIFT


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, however often it is used there."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def total(numbers: str) -> str:
    """Sum of an array of INT."""
    return f"aggregate({numbers}, 0, (acc, n) -> acc + n)"


def running_total(numbers: str, block: int = 7, levels: int = 1) -> str:
    """Exclusive prefix sums of an array of INT.

    An ``aggregate`` that appends to an array copies it at every step, which is
    quadratic. Instead: the sums of blocks of 2^``block``, their own prefix sums
    (in the same way, ``levels`` deep), and the sum of what precedes within the
    block. Small blocks and more levels suit long arrays, one level a short plan.
    """
    if levels == 0:
        return let("xs", numbers, f"transform(xs, (_, i) -> {total('slice(xs, 1, i)')})")
    block_sums = (f"transform(sequence(0, shiftright(size(xs), {block})), "
                  f"b -> {total(f'slice(xs, b * {1 << block} + 1, {1 << block})')})")
    within = total(f"slice(xs, shiftright(i, {block}) * {1 << block} + 1, i % {1 << block})")
    return let("xs", numbers, let("before", running_total(block_sums, block, levels - 1), (
        f"transform(xs, (_, i) -> get(before, shiftright(i, {block})) + {within})")))


def running_max(numbers: str, block: int = 4, levels: int = 2) -> str:
    """The greatest of the numbers before each of an array of INT, NULL for the first; taken as the sums are."""
    if levels == 0:
        return let("xs", numbers, "transform(xs, (_, i) -> array_max(slice(xs, 1, i)))")
    of_blocks = f"transform(sequence(0, shiftright(size(xs), {block})), b -> array_max(slice(xs, b * {1 << block} + 1, {1 << block})))"
    within = f"array_max(slice(xs, shiftright(i, {block}) * {1 << block} + 1, i % {1 << block}))"
    return let("xs", numbers, let("before", running_max(of_blocks, block, levels - 1), (
        f"transform(xs, (_, i) -> greatest(get(before, shiftright(i, {block})), {within}))")))


def chunks(text: str) -> str:
    """The text cut into equal pieces, for ``piece``."""
    return f"regexp_extract_all({text}, '(?s).{{1,{_CHUNK}}}', 0)"


def piece(cut: str, start: str, end: str) -> str:
    """The text between two offsets. ``substring`` counts from the start of the text
    at every call; on ``chunks`` the cost is that of the piece, wherever it lies."""
    first = f"shiftright({start}, {_CHUNK_SHIFT})"
    return (f"substring(array_join(slice({cut}, {first} + 1, shiftright({end}, {_CHUNK_SHIFT}) - {first} + 1), ''), "
            f"{start} % {_CHUNK} + 1, {end} - {start})")


def interleave(gaps: str, between: str) -> str:
    """``gaps`` and ``between`` (one shorter) in turn, as one string."""
    # the last gap is paired with NULL, which concat_ws leaves out
    return f"concat_ws('', flatten(zip_with({gaps}, {between}, (gap, mid) -> array(gap, mid))))"


def hits(text: str, pattern: str, group: int = 0) -> str:
    """All matches of ``pattern``, or what its ``group`` captured in each."""
    return f"regexp_extract_all({text}, {quote(pattern)}, {group})"


def offsets(gaps: str, matches: str, block: int = 7, levels: int = 1) -> str:
    """0-based code point offset of every match, from the text between them.

    A match starts after all earlier gaps and matches and its own gap.
    """
    own = f"slice({gaps}, 1, size({matches}))"
    steps = f"zip_with({own}, {matches}, (gap, match) -> length(gap) + length(match))"
    return f"zip_with({running_total(steps, block, levels)}, {own}, (start, gap) -> start + length(gap))"


def any_contains(text: str, needles: Sequence[str]) -> str:
    """True where the text holds at least one of the literal ``needles``."""
    return "(" + " OR ".join(f"contains({text}, {quote(needle)})" for needle in needles) + ")"
