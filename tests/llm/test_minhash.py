"""Groups of similar shingle sets against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubline.llm import minhash
from tests.conftest import DATA


def plain_set(text: str | None) -> set:
    low = re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    return {b" ".join(words[i:i + 3]) for i in range(len(words) - 2)} or ({b" ".join(words)} if words else set())


def plain_groups(sets: list[set], linked) -> list[int]:
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        shared = Counter(j for x in own for j in holders[x])
        for j, n in shared.items():
            if linked(n, len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in own:
            holders[x].append(i)
    return [find(i) for i in range(len(sets))]


def similar(common, union):
    return 100 * common >= 85 * union


def test_documents(spark, texts):
    ids = sorted(texts)
    sets = [plain_set(texts[i]) for i in ids]
    groups = plain_groups(sets, similar)
    want = {i: (len(s), ids[g], i == ids[g]) for i, s, g in zip(ids, sets, groups)}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op11_minhash_dedup(spark, DATA).collect()} == want
    assert len(set(groups)) < len(groups)


def clouds(rng, centres, members):
    """Texts around a few centres, with 0 to 40 of 120 words changed."""
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(centres):
        words = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(members):
            own = list(words)
            for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9, 40))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("s", [minhash.Settings(), minhash.Settings(most=4, weight=500), minhash.Settings(weight=1)])
def test_near_copies_in_parts_or_not(spark, s):
    rows = clouds(random.Random(3), 4, 25)
    sets = [plain_set(t) for t in rows]
    groups = plain_groups(sets, similar)
    assert 4 < len(set(groups)) < len(rows)
    found = minhash.shingle_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4), s=s).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(groups))


def test_signatures_within_the_radius_share_a_key(spark):
    """Whatever places differ, as long as they are ``radius`` at most."""
    s, rng = minhash.Settings(), random.Random(5)
    rows, width = [], s.chunks * s.size
    for pair in range(300):
        sig = np.array([rng.randrange(1 << 16) for _ in range(width)], np.uint16)
        other = sig.copy()
        other[rng.sample(range(width), s.radius if pair % 2 else rng.randrange(s.radius + 1))] ^= 1
        rows += [(2 * pair, bytearray(sig.tobytes())), (2 * pair + 1, bytearray(other.tobytes()))]
    keys = defaultdict(set)
    for r in minhash.keys(spark.createDataFrame(rows, "node long, sig binary"), s).collect():
        keys[r.node].add(r.key)
    assert all(keys[2 * p] & keys[2 * p + 1] for p in range(300))
    assert not keys[0] & keys[2]


@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=2, max_size=12), st.sampled_from([20, 50, 85, 100]))
@settings(max_examples=200, deadline=None)
def test_set_links_join_all_that_is_linked(sets, percent):
    links = list(minhash.set_links([np.array(sorted(s), np.uint64) for s in sets], percent))
    groups = plain_groups(sets, lambda common, union: 100 * common >= percent * union)
    root = list(range(len(sets)))
    for i, j in links:
        assert 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
        a, b = root[i], root[j]
        assert a != b
        root = [min(a, b) if x in (a, b) else x for x in root]
    # sets without a common element are never linked, so that a plain search by common elements is complete
    assert root == groups


def test_edge_rows(spark, edges):
    found = minhash.shingle_groups(edges).collect()
    assert len(found) == edges.count()
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by_id[None] == [(7, None, True)]
    assert by_id[1] == [(0, 1, True)] and by_id[2] == [(0, 2, True)] and by_id[5] == [(0, 5, True)]
    assert by_id[3] == [(1, 3, True)]
    assert by_id[4] == [(6, 4, True)] * 2
    assert by_id[7] == [(1, 7, True)] and by_id[8] == [(1, 8, True)]
    assert sorted(by_id[9]) == [(4, 9, True), (4, 9, True)]
    assert by_id[10] == [(4, 9, False)]


def test_no_rows(nothing):
    assert minhash.shingle_groups(nothing).collect() == []
