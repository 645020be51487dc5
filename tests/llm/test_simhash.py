"""SimHash groups against all pairs."""

import random
import re
from dataclasses import replace

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubline.llm import simhash
from scrubline.llm.components import components
from tests.conftest import DATA


def plain_fingerprint(text: str | None) -> int:
    low = re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps: dict) -> dict:
    """Smallest id reachable over links of at most four bits."""
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_documents(spark, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    groups = plain_groups(fps)
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash_dedup(spark, DATA).collect()}
    assert rows == {i: (f"{fps[i]:016x}", groups[i]) for i in texts}
    assert len(set(groups.values())) < len(groups)


@pytest.mark.parametrize("s", [simhash.Settings(), simhash.Settings(most=8), simhash.Settings(blocks=5), simhash.Settings(blocks=7, most=3)])
def test_links_join_what_is_near(spark, s):
    """Fingerprints in clouds around a few centres: large shards, split in parts or not."""
    rng = random.Random(7)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            fps.add(centre)
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 4, 5))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), s)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in links.collect())
    root = {r.node: r.root for r in components(links).collect()}
    want = plain_groups({f: f & (1 << 64) - 1 for f in signed})
    for f in signed:
        for g in signed:
            assert (want[f] == want[g]) == (root.get(f, f) == root.get(g, g))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2 ** 12 - 1), unique=True, max_size=60), st.integers(0, 2 ** 12 - 1), st.integers(0, 5))
def test_tree_finds_all_within(values, query, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for node, children in enumerate(tree.children):
        assert all((tree.values[node] ^ tree.values[c]).bit_count() == edge for edge, c in children.items())
    assert sorted(tree.values[i] for i in tree.within(query, radius)) == sorted(v for v in values if (v ^ query).bit_count() <= radius)


def test_edges(spark, edges, nothing):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    by = {(r.doc_id, r.fp): r.component_id for r in rows}
    assert by[(1, 0)] == 1 and by[(2, 0)] == 1 and by[(5, 0)] == 1  # without words: zero, linked like any other
    assert next(r.component_id for r in rows if r.doc_id is None) is None
    assert {r.component_id for r in rows if r.doc_id == 4} == {4}
    assert next(r.component_id for r in rows if r.doc_id == 10) == 9
    assert simhash.near_duplicates(nothing).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(7, 7), (-3, 9), (9, -3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[x] == 5 for x in range(200, 260))
    assert got[9] == got[-3] == -3 and 7 not in got


def test_fewer_words_than_a_shingle():
    s = replace(simhash.Settings(), shingle=4)
    assert simhash.simhash(b"One TWO", s.shingle) == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.simhash(b" \n", 4) == 0
