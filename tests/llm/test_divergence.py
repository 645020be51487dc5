"""Distances of sources and their terms against a plain version in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubline.llm import divergence
from tests.conftest import DATA

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def plain(rows, least=10, top=10):
    counts, langs, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
        counts[lang, source].update(terms)
        langs[lang].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(own):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10 ** 9 * (own[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        p, whole = shares(counts[lang, source]), shares(langs[lang])
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                q = shares(counts[lang, other])
                pairs.append((-sum(apart(p[t], q[t]) for t in kept), other))
        terms = [(-apart(p[t], whole[t]), t) for t in kept if counts[lang, source][t] and p[t] > whole[t]]
        for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out |= {(lang, source, part, item, -value, rank) for rank, (value, item) in enumerate(items, 1)}
    return out


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("lang", "source", "text").collect()
    found, want = rows_of(divergence.op13_source_divergence(spark, DATA)), plain(map(tuple, rows))
    assert len(found) == len(want) and set(found) == want


@pytest.mark.parametrize("s", [divergence.Settings(least=2), divergence.Settings(least=2, tile=1, block=3, top=2), divergence.Settings(least=3, tile=2, block=1),
                               divergence.Settings(least=10 ** 6)])
def test_tiles_and_blocks(spark, s):
    """Sources with very different words, some with none that are kept, over tiles of hashed sizes and blocks of few terms."""
    rng = random.Random(4)
    words = ["É" + "abcdefghij"[i % 10] * (1 + i // 10) + "é東"[i % 2] for i in range(40)] + ["Same", "same", "x1y"]
    rows = []
    for i in range(160):
        source = rng.choice(["a", "b", "c", "d", "é", "Z", None, ""])
        rows.append((rng.choice(["en", "en", None]), source, " ".join(rng.choices(words[(ord(source[0]) if source else 0) % 20:], k=rng.randrange(12)))))
    rows += [("en", "empty", ""), ("en", "none", None), ("xx", "alone", "one two"), ("en", "numbers", "1 2 3 [ ]")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    found, want = rows_of(divergence.source_divergence(docs, s=s)), plain(rows, s.least, s.top)
    assert len(found) == len(want) and set(found) == want


@given(st.lists(st.integers(0, 10 ** 12), min_size=1, max_size=5), st.integers(0, 10 ** 14), st.integers(1, 10 ** 9))
@settings(max_examples=300, deadline=None)
def test_shares_are_exact(counts, more, kinds):
    total = sum(counts) + more
    got = divergence.share(np.array(counts, np.int64), total, kinds).tolist()
    assert got == [1 + 10 ** 9 * (c + 2) // (total + 2 * kinds) for c in counts]


@given(st.dictionaries(st.integers(0, 40), st.integers(1, 10 ** 9)), st.dictionaries(st.integers(0, 40), st.integers(1, 10 ** 9)), st.integers(1, 9), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_merge_prices_every_term_once(one, two, p0, q0):
    def arrays(own):
        return np.array(sorted(own), np.int64), np.array([own[i] for i in sorted(own)], np.int64)

    want = sum((one.get(i, p0) - two.get(i, q0)) ** 2 // (one.get(i, p0) + two.get(i, q0)) for i in one.keys() | two.keys())
    assert divergence.merge(*arrays(one), p0, *arrays(two), q0) == (want, len(one.keys() | two.keys()))


def test_edge_rows(spark, edges):
    """Clashing extra columns; one group, so no pairs, and its shares are those of its language, so no terms."""
    assert divergence.source_divergence(edges, s=divergence.Settings(least=1)).collect() == []
    two = edges.unionByName(edges.withColumn("source", divergence.F.lit("other")).limit(5))
    rows = [tuple(r) for r in two.select("lang", "source", "text").collect()]
    assert set(rows_of(divergence.source_divergence(two, s=divergence.Settings(least=1)))) == plain(rows, 1)


def test_no_rows(nothing):
    assert divergence.source_divergence(nothing).collect() == []
