"""Passages of lines that recur, whatever stands around them, against a plain version."""

from hypothesis import given, settings
from hypothesis import strategies as st

from scrubline.llm import line_chunks


def plain(rows: list[tuple[int, str]]) -> dict[int, str]:
    """Every two neighbouring lines (none is blank here) that stood before, without overlap, lose both."""
    first, out = {}, {}
    for i, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for p, pair in enumerate(zip(lines, lines[1:])):
            seen = first.setdefault(pair, (i, p))
            if seen[0] != i or p >= seen[1] + 2:
                gone |= {p, p + 1}
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def left(spark, rows: list[tuple[int, str]]) -> dict[int, str]:
    return {r.doc_id: r.text for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_passages_go_whatever_their_neighbours(spark):
    """Passages of 2 to 6 lines between lines that stand nowhere else: all of them go, nothing else does."""
    rows = []
    for n in range(2, 7):
        for k in range(8):
            passage = [f"passage {n} {k} line {j}" for j in range(n)]
            for copy in range(3):
                i = len(rows)
                rows.append((i, "\n".join([f"before {i}", *(passage if copy < 2 else ["  ".join(passage)]), f"after {i}", *passage[:copy]])))
    got = left(spark, rows)
    assert got == plain(rows)
    assert all(got[i] == f"before {i}\nafter {i}\n{rows[i][1].rsplit(chr(10), 1)[1]}" for i in range(1, len(rows), 3))


def test_random_lines(spark):
    import random
    draw = random.Random(7)
    rows = [(i, "\n".join(f"l{draw.randrange(40)}" for _ in range(draw.randrange(1, 30)))) for i in range(60)]
    rows = list({text: (i, text) for i, text in reversed(rows)}.values())
    assert left(spark, rows) == plain(rows)


def test_the_same_line_over_and_over(spark):
    """Two of the run stay, for any line: also one after which no chunk ends."""
    rows = [(i, "\n".join([f"line of text {i}"] * 9) + f"\nend {i}") for i in range(20)]
    assert left(spark, rows) == {i: f"line of text {i}\nline of text {i}\nend {i}" for i in range(20)}


def test_blank_lines_lie_within_passages(spark):
    rows = [(1, "a\nx\n\ny\nb"), (2, "c\nx\n\ny\nd\n"), (3, "x\ny\nx"), (4, "lone\n"), (5, "e\nlone")]
    assert left(spark, rows) == {1: "a\nx\n\ny\nb", 2: "c\nd\n", 3: "x\ny\nx", 4: "lone\n", 5: "e\nlone"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"", b"a", b"b", b" "]), min_size=1, max_size=12))
def test_spans_are_whole_lines(lines):
    text = b"\n".join(lines)
    for begin, end in line_chunks.spans(text):
        assert (begin == 0 or text[begin - 1:begin] == b"\n") and text[end:end + 1] in (b"", b"\n") and text[begin:end].strip()
