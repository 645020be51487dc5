"""Words one edit apart, their forms and roots, against a plain version."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubline.llm import spelling
from scrubline.llm.oracles import SPELLING
from tests.conftest import DATA


def plain_words(rows, least=5):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words: dict[str, int]) -> set[tuple]:
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_documents(spark, texts):
    """Against the SQL, and its words against a plain count."""
    found = rows_of(spelling.op12_spelling_variants(spark, DATA))
    assert {r[0]: r[3] for r in found} == plain_words(texts.items())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    con.execute(SPELLING)
    names = [c[0] for c in con.description]
    want = [tuple(dict(zip(names, r))[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in con.fetchall()]
    assert len(found) == len(set(found)) and set(found) == set(want)


def vocabulary(rng, size):
    """Words of few letters, edited again and again, with counts that differ by more than five times."""
    letters, words = "abcé", {}
    while len(words) < size:
        if words and rng.random() < 0.8:
            word = rng.choice(list(words))
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            word = word[:at] + (rng.choice(letters) if kind else "") + word[at + (kind < 2):]
        else:
            word = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
        if len(word) >= 6:
            words[word] = rng.choice((5, 6, 30, 150, 800))
    return words


@pytest.mark.parametrize("s", [spelling.Settings(), spelling.Settings(often=1, most=3), spelling.Settings(often=4, entries=3), spelling.Settings(shortest=3, longest=3)])
def test_edited_words(spark, s):
    """Dictionaries that split every gram, few or none; lists in parts or not."""
    words = vocabulary(random.Random(11), 150)
    docs = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())], "doc_id long, text string").repartition(5)
    found = rows_of(spelling.spelling_variants(docs, s=spelling.Settings(**{**vars(s), "drop": 0})))
    assert len(found) == len(set(found)) and set(found) == plain_variants(words)
    assert any(r[2] not in (r[0], r[1]) for r in found)


@given(st.text("abé", min_size=6, max_size=12), st.sets(st.text("abé", min_size=2, max_size=4)), st.integers(0, 11), st.sampled_from("abéz"), st.integers(0, 2))
@settings(max_examples=500, deadline=None)
def test_an_edit_touches_no_more_grams_than_the_bound(word, split, at, letter, kind):
    split = {g for g in split if all(g[:n] in split for n in range(2, len(g)))}
    at %= len(word)
    edited = (word[:at] + word[at + 1:], word[:at] + letter + word[at + 1:], word[:at] + letter + word[at:])[kind]
    s = spelling.Settings()
    (grams, bound), (others, _) = spelling.decompose(word, split, s), spelling.decompose(edited, split, s)
    assert len(grams) == len(word) + 1
    assert sum((Counter(grams) & Counter(others)).values()) >= len(grams) - bound > 0


def test_dictionary_is_bounded(spark):
    words = sorted(vocabulary(random.Random(2), 300))
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    split = spelling.gram_dictionary(frame, spelling.Settings(often=1, entries=40))
    assert split and all(sum(len(g) == n for g in split) <= 40 for n in range(2, 5))
    counts = Counter(("\x01" + w + "\x00" * 4)[i:i + n] for w in words for n in range(2, 5) for i in range(len(w) + 1))
    assert split == {g for g, n in counts.items() if n > max(1, sum(len(w) + 1 for w in words) // 40)}


def test_edge_rows(spark, edges):
    found = rows_of(spelling.spelling_variants(edges))
    assert found == []
    again = edges
    for _ in range(4):
        again = again.union(edges)
    rows = [(r.doc_id, r.text) for r in again.select("doc_id", "text").collect()]
    assert set(rows_of(spelling.spelling_variants(again))) == plain_variants(plain_words(rows))
    assert max(map(len, plain_words(rows))) == 70_000


def test_no_rows(nothing):
    assert spelling.spelling_variants(nothing).collect() == []
