"""Repeated passages and repeated chunks of lines against plain versions."""

import hashlib
from collections import Counter
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubline.llm import line_chunks, repeats
from tests.conftest import DATA

SMALL = repeats.Settings(length=20, gram=8, most=1000, block=64)


def plain(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Removed runs of each text: all windows that start anywhere else too."""
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    return [repeats.merged([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i:i + length]] > 1]) for t in texts]


def expected(text: bytes, gone: list[tuple[int, int]]) -> tuple:
    edges = [0, *(e for span in gone for e in span), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest()


def got(df) -> dict:
    return {bytes(r.key): (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()}


def cut(spark, texts, s):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    keys = docs.select(F.col("text").cast("binary").alias("key"), *repeats.text_key("text")).distinct()
    return got(repeats.cut_repeats(docs, s=s).join(keys, ["a", "b"]))


def made_texts() -> list[str]:
    passage, other = "the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs"
    return [passage, passage + " once", "and then " + passage, other + passage[:25], passage[5:30] + other[3:], "aaaa" * 30, "ab" * 40 + "aaaa" * 9,
            "short", "", "für Zürich: " + passage + " ß", "für Zürich: " + other, other, other, "nothing of this stands anywhere else, at all"]


@pytest.mark.parametrize("most", [1000, 3, 1])
def test_made_texts(spark, most):
    texts = made_texts()
    raw = [t.encode() for t in texts]
    found = cut(spark, texts, replace(SMALL, most=most))
    for text, gone in zip(raw, plain(raw, 20)):
        assert found[text] == expected(text, gone), text


def test_documents(spark):
    rows = repeats.op5_repeats(spark, DATA).collect()
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for (doc, text), gone in zip(docs.items(), plain(list(docs.values()), 200)):
        assert next((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows if r.doc_id == doc) == expected(text, gone)


def test_repeat_edges(spark, edges, nothing):
    rows = repeats.without_repeats(edges).collect()
    assert len(rows) == edges.count() and rows[0].__fields__ == edges.columns
    by_id = {(r.doc_id, r.text) for r in rows}
    assert {(1, None), (2, ""), (3, "a")} <= by_id and all(r["a.b"] == "dot" for r in rows)
    # a period repeats within its own text
    assert (7, "") in by_id and (8, "") in by_id
    assert repeats.without_repeats(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=30).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=2, max_size=8))
def test_prefix_intervals(strings):
    """Each interval holds exactly the strings that share its depth, and every pair meets in the one of its own prefix."""
    found = list(repeats.prefix_intervals(strings))
    for depth, members in found:
        assert len({strings[i][:depth] for i in members}) == 1
    for i in range(len(strings)):
        for j in range(i):
            n = repeats._common(strings[i], strings[j])
            assert any(depth == n and i in members and j in members for depth, members in found)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=0, max_size=300).map(lambda b: bytes(x % 2 + 97 for x in b)))
def test_every_window_has_an_anchor(text):
    at, hashes = repeats.anchors(text, SMALL)
    grams = [repeats.anchors(text[i:i + 20], SMALL) for i in range(len(text) - 19)]
    assert sorted({i + int(g[0][0]) for i, g in enumerate(grams)}) == at.tolist()
    assert dict(zip(at.tolist(), hashes.tolist())) == {i + int(g[0][0]): int(g[1][0]) for i, g in enumerate(grams)}


# --- lines ---


def plain_spans(raw: bytes) -> set[tuple[int, int]]:
    """Each two lines in a row that are not blank, with the blank ones between; and chunks of lines with a blank edge."""
    begins, at = [], 0
    for line in raw.split(b"\n"):
        begins.append((at, at + len(line)))
        at += len(line) + 1
    filled = [x for x in begins if raw[x[0]:x[1]].strip()]
    out = {(a[0], b[1]) for a, b in zip(filled, filled[1:])}
    for c in line_chunks.chunks(raw):
        body = line_chunks.body_of(raw, c)
        if c[2] >= 2 and body.strip() and not (body.split(b"\n")[0].strip() and body.split(b"\n")[-1].strip() and b"\n" in body):
            out.add((c[0], c[0] + len(body)))
    return out


def plain_lines(rows: list[tuple]) -> list[tuple]:
    """id, text left, lines, lines removed. The first place of a span is that of the smallest id, then place, and stays,
    as do those in the same text that begin no later than it ends; ids are unique."""
    places = {}
    for i, text in set(rows):
        raw = (text or "").encode()
        for a, b in plain_spans(raw):
            places.setdefault(raw[a:b], []).append((i, a))
    first = {body: min(at) for body, at in places.items()}
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = [(a, b) for a, b in plain_spans(raw) if first[raw[a:b]][0] != i or a > first[raw[a:b]][1] + b - a]
        lines, kept, at = raw.split(b"\n") if raw else [], [], 0
        for line in lines:
            if not any(a <= at and at + len(line) <= b for a, b in gone):
                kept.append(line)
            at += len(line) + 1
        out.append((i, None if text is None else b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_chunks_cover_and_resist_shifts():
    lines = [f"line {i} says {i * i}".encode() for i in range(200)]
    text = b"\n".join(lines)
    own = line_chunks.chunks(text)
    assert b"".join(text[a:b] for a, b, _ in own) == text and sum(c[2] for c in own) == 200
    assert line_chunks.chunks(b"") == []
    shifted = b"new first line\nand another\nand one more\n" + text
    bodies = {line_chunks.body_of(text, c) for c in own}
    same = bodies & {line_chunks.body_of(shifted, c) for c in line_chunks.chunks(shifted)}
    assert len(same) >= len(bodies) - 3


def test_lines_of_documents(spark, texts):
    rows = [(r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in line_chunks.op9_line_dedup(spark, DATA).collect()]
    want = [(i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, gone in plain_lines(list(texts.items()))]
    assert sorted(rows) == sorted(want) and sum(r[2] for r in rows) > 0


def test_line_edges(spark, edges, nothing):
    rows = line_chunks.dedup_lines(edges, counts=("lines", "lost")).collect()
    assert rows[0].__fields__ == [*edges.columns, "lines", "lost"] and all(r.fp == "fp" and r["a.b"] == "dot" for r in rows)
    by = {(r.doc_id, r.text): (r.lines, r.lost) for r in rows}
    assert len(rows) == edges.count() and by[(1, None)] == (0, 0) and by[(2, "")] == (0, 0)
    # the first of two equal texts keeps its lines
    assert by[(9, "one\ntwo\nthree\nfour\nfive\nsix")] == (6, 0)
    assert next(r.lost for r in rows if r.doc_id == 10) >= 2
    assert line_chunks.dedup_lines(nothing).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = "alpha\nbeta\ngamma\ndelta"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.text == text) for r in line_chunks.dedup_lines(docs).collect())
    assert rows == [(1, True), (1, True), (2, False)]
