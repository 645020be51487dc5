"""Nearest neighbours, winnowing, pages, the pipeline, and that the folder can be left out."""

import hashlib
import math
import re
import subprocess
import sys
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from scrubline.llm import html_templates, neighbours, winnowing
from tests.conftest import DATA


# --- neighbours ---


def plain_nearest(vectors: list[tuple], k: int) -> list[tuple]:
    own = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for i, v in own:
        if i % 20 == 0:
            near = sorted((-float((v * w).sum()), j) for j, w in own if j != i and len(w) == len(v))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("s", [neighbours.Settings(), neighbours.Settings(queries=7, candidates=64), neighbours.Settings(k=1, candidates=100)])
def test_embeddings(spark, s):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    vectors = neighbours.usable(table, "vec_id", "embedding")
    rows = sorted(tuple(r) for r in neighbours.nearest(vectors.where("id % 20 = 0"), vectors, s).collect())
    want = plain_nearest([(r.vec_id, r.embedding) for r in table.collect()], s.k)
    assert [r[:2] for r in rows] == [w[:2] for w in want]
    assert all(abs(r[3] - w[3]) < 1e-12 for r, w in zip(rows, want)) and sum(r[2] != w[2] for r, w in zip(rows, want)) == 0


def test_odd_vectors(spark):
    """Ties, copies, other lengths, and all that takes no part."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [-1.0, 0.5]), (5, [0.0, 0.0]), (40, [0.0, 0.0]), (6, None), (7, []),
            (60, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (80, [1.0, 2.0, 3.0]), (10, [1.0, 1.0, 1.0]), (None, [9.0, 9.0]), (100, [5.0]), (3, [4.0, 4.0])]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = sorted(tuple(r) for r in neighbours.nearest(vectors.where("id % 20 = 0"), vectors, neighbours.Settings(k=3)).collect())
    assert got == plain_nearest(rows, 3) and {r[0] for r in got} == {0, 20, 80}
    assert neighbours.nearest(vectors.where("false"), vectors).count() == neighbours.nearest(vectors, vectors.where("false")).count() == 0


def test_huge_vectors_and_other_columns(spark):
    """Products that leave the range of doubles are infinite, and tie; columns of names used within do not matter."""
    rows = [(0, [1e160, 1.0]), (1, [1e160, 2.0]), (2, [-1e160, 1.0]), (3, [1e-160, 5.0]), (4, [2e150, 0.0]), (5, [1e200, 1e200]), (20, [1.0, 1e-170])]
    frame = spark.createDataFrame([(i, v, 1, 2.0, b"x") for i, v in rows], "vec_id long, embedding array<double>, dim int, x double, q_ids binary")
    vectors = neighbours.usable(frame, "vec_id", "embedding")
    for k in (1, 3, 20):
        got = sorted(tuple(r) for r in neighbours.nearest(vectors.where("id % 20 = 0"), vectors, neighbours.Settings(k=k)).collect())
        with np.errstate(over="ignore", invalid="ignore"):
            assert got == plain_nearest(rows, k)


def test_one_vector_over_and_over():
    """All pairs of a tile tie: they are taken in slices, and the smallest ids win."""
    x = np.ones((400, 8))
    found = dict(neighbours.tile(np.arange(400), x, np.arange(1000, 1400), x, 5))
    assert all(found[i] == [(8.0, 1000 + j) for j in range(5)] for i in range(400))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2 ** 32 - 1), st.integers(1, 6), st.sampled_from([1e-30, 1.0, 1e6]))
def test_error_bound_holds(seed, k, scale):
    rng = np.random.default_rng(seed)
    q, c = rng.normal(size=(4, 5)) * scale, rng.normal(size=(30, 5)) * scale
    q[0] = c[3]
    for place, best in neighbours.tile(np.arange(4) + 100, q, np.arange(30), c, k):
        want = sorted((-s, i) for i, s in enumerate(neighbours.exact(np.broadcast_to(q[place], c.shape), c)))[:k]
        assert best == [(-s, i) for s, i in want]


# --- winnowing ---


def plain_winnow(text: str, s: winnowing.Settings) -> list[int]:
    low = (1 << winnowing.POSITION_BITS) - 1
    tokens = re.findall(r"[^ \t\n\x0b\f\r]{1,4}", text)
    grams = ([tokens] if tokens else []) if len(tokens) < s.gram else [tokens[i:i + s.gram] for i in range(len(tokens) - s.gram + 1)]
    packed = []
    for i, g in enumerate(grams):
        h = chained(g) & ~low | (low - i)
        packed.append(h - (1 << 64) if h >> 63 else h)
    out: list[int] = []
    for j in range(max(1, len(packed) - s.window + 1) if packed else 0):
        least = min(packed[j:j + s.window])
        if not out or out[-1] != least:
            out.append(least)
    return out


def chained(gram: list[str]) -> int:
    """The hash of an array: each element's hash is the seed of the next."""
    seed = 42
    for token in gram:
        seed = xxhash.xxh64_intdigest(token.encode(), seed)
    return seed


def like(a, b):
    a, b = ({x >> winnowing.POSITION_BITS for x in f} for f in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def check_winnow(rows, ordered, s):
    """``ordered``: (id, text) in the order of the documents."""
    want = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        n = len(text)
        edited = text[:n - n // 4] + after[:n // 4]
        own, other = plain_winnow(text, s), plain_winnow(edited, s)
        digest = [hashlib.md5(",".join(map(str, f)).encode()).hexdigest() for f in (own, other)]
        want.append((str(i), n, hashlib.sha256(edited.encode()).hexdigest(), *digest, round(like(own, other), 12), round(like(own, plain_winnow(after, s)), 12)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in rows]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("s", [winnowing.Settings(), winnowing.Settings(gram=3, window=5, segment=7)])
def test_fingerprints_of_documents(spark, texts, s):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 3000")
    ordered = sorted((i, t) for i, t in texts.items() if len(t) < 3000)
    check_winnow(winnowing.edited_fingerprints(docs, s=s).collect(), ordered, s)


def test_winnow_edges(spark, edges, nothing):
    s = winnowing.Settings(segment=100)
    rows = [(r.doc_id, r.text or "") for r in edges.collect()]

    def place(row):
        h = xxhash.xxh64_intdigest(row[1].encode(), 42)
        return (-(1 << 63) if row[0] is None else row[0], h - (1 << 64) if h >> 63 else h)

    check_winnow(winnowing.edited_fingerprints(edges, s=s).collect(), sorted(rows, key=place), s)
    assert winnowing.edited_fingerprints(nothing).count() == 0
    only = spark.createDataFrame([(5, "the only document is its own next")], "doc_id long, text string")
    check_winnow(winnowing.edited_fingerprints(only).collect(), [(5, "the only document is its own next")], winnowing.Settings())


def test_shared_stretch_is_found(spark):
    """Any gram + window - 1 tokens in common give a common hash; positions tell where it stands."""
    s = winnowing.Settings()
    stretch = " ".join(f"tok{i}" for i in range(s.gram + s.window - 1))
    docs = spark.createDataFrame([(1, "12 34 56 78 " + stretch + " 90"), (2, "zz " + stretch)], "doc_id long, text string")
    rows = docs.withColumn("tokens", winnowing.tokens("text")).withColumn("f", winnowing.fingerprint(winnowing.chosen("tokens", s))).select(
        "tokens", "f", winnowing.positions(F.col("f")).alias("at"), winnowing.hashes(F.col("f")).alias("h")).collect()
    assert set(rows[0].h) & set(rows[1].h)
    for r in rows:
        for x, at in zip(r.f, r.at):
            assert chained(r.tokens[at:at + s.gram]) >> winnowing.POSITION_BITS == (x & (1 << 64) - 1) >> winnowing.POSITION_BITS


def test_winnowing_is_native(spark):
    plan = winnowing.op8_winnowing(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- pages ---


@pytest.mark.parametrize("html, want", [
    ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<p>b</p>c", ["a", "b", "c"]),
    ("<article><h1>T</h1><p><b>x<br>y</b> z<p>w</article><footer>f</footer>", ["T", "x y z", "w"]),
    ("<nav><ul><li>m</ul></nav><div><p>one</div><aside>s</aside><form><p>f</form><p>two", ["one", "two"]),
    ("<script>var a='</p><p>no';</script><style>p{}</style><p>&lt;yes&gt; &#x41;&eacute;&nbsp;!", ["<yes> Aé !"]),
    ("<div class='cookie-notice'>no</div><div id=comments><article>no</article></div><div class=\"post-body\">yes</div>", ["yes"]),
    ("<body class=has-sidebar><div class='wrap sidebar'><article class='post'>yes<div class=ad>no</div></article></div>", ["yes"]),
    ("<main><p>in</p><table><tr><td>c1<td>c2</table></main><p>out", ["in", "c1", "c2"]), ("a <!-- b --> c < d <a <b>e", ["a c < d <a e"]),
    ("<ul><li>one<ul><li>sub</ul><li>two</ul>", ["one", "sub", "two"]), ("</p></div>x</article>", ["x"]), ("<p>no end <b", ["no end <b"]),
    ("<p>foo <span class='advert'>buy <span>it</span> now</span> bar", ["foo", "bar"]),
    ("<div class='content no-sidebar'><article><p>yes</article></div>", ["yes"]), ("<div class='content no-sidebar'>yes</div>", ["yes"]),
    ("<div class='post search-engine-review'>yes</div><div class='site-footer'>no</div><div id='left_sidebar_2'>no</div>", ["yes"])])
def test_main_blocks(html, want):
    assert [b.text for b in html_templates.main_blocks(html_templates.parse(html)[0])] == want


def test_pages_are_their_articles(spark):
    """On the given pages the text is that of the article, cut at its blocks."""
    import html as entities
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in html_templates.op10_html_main_text(spark, DATA).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_templates_of_a_host_go(spark):
    """What recurs on many different pages of a host goes, however it is named; elsewhere, or on copies alone, it stays."""
    def page(i):
        return f"<div><p>Welcome to our site</p></div><div><p>Story number {i} of many</p><p>Said so</p></div><div><b>Follow us</b></div>"
    rows = [(i, f"http://www.a.example/{i}", page(i)) for i in range(8)] + [(20, "http://b.example/1", page(99)), (21, "not a url", page(98))]
    rows += [(30 + i, f"http://c.example/{i}", "<div><p>Copied page</p></div>") for i in range(9)] + [(50, None, None), (51, None, "")]
    got = {r.page_id: r.text for r in html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story number {i} of many" for i in range(8))  # outside an article a paragraph may be template too
    assert got[20].startswith("Welcome") and got[21].endswith("Follow us") and got[30] == "Copied page" and got[50] == got[51] == ""
    assert html_templates.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def pages_of(spark, pages):
    rows = [(i, f"http://a.example/{i}", page) for i, page in enumerate(pages)]
    found = html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    return [r.text for r in found]


def test_an_article_on_several_addresses_stays(spark):
    """Syndicated, print and tracking copies: the same article between different menus."""
    for n in (4, 40):
        pages = [f"<nav>menu {i}</nav><div><p>Today {i}</p></div><article><div>story</div></article>" for i in range(n)]
        assert pages_of(spark, pages) == ["story"] * n


def test_tables_and_lists_of_few_articles_stay(spark):
    pages = [f"<article><p>About item {i}, at length</p><table><tr><td>Size XL</table><ul><li>Free delivery</ul></article>" for i in range(4)]
    assert pages_of(spark, pages) == [f"About item {i}, at length\n\nSize XL\n\nFree delivery" for i in range(4)]


def test_templates_equal_a_plain_count(spark):
    """Pages of random parts on hosts of several sizes, some repeated: what goes is told by counting pages one by one."""
    import random
    rng = random.Random(5)
    parts = [f"<div><p>part {k}</p></div>" for k in range(12)] + [f"<p>line {k}</p>" for k in range(12)] + [f"<ul><li>item {k}</ul>" for k in range(6)]
    rows = []
    for i in range(260):
        inside = "".join(rng.choice(parts[:rng.choice((3, 30))]) for _ in range(rng.randrange(6)))
        story = f"<p>story {rng.randrange(400)} told at length for all</p>"
        page = f"<div>{inside}</div><article>{story}{''.join(rng.choice(parts) for _ in range(3))}<p>Subscribe to it</p></article>" if i % 3 else f"{inside}<p>own {i}</p>"
        rows.append((i, f"http://{'abc'[rng.randrange(3)] if i % 5 else 'd'}.example/{i}", page))
    rows += rows[:20]
    s = html_templates.Settings(strong=20)
    seen = {}
    for _, url, page in set(rows):
        blocks, own = html_templates.parse(page)
        seen.setdefault(html_templates.host(url), {})[own] = {m for b in html_templates.main_blocks(blocks) for m in b.marks}
    def bar(pages, mark):
        return s.strong if mark & 1 else max(s.least, min(s.share * len(pages), s.enough))
    templates = {h: {m for marks in pages.values() for m in marks if sum(m in x for x in pages.values()) >= bar(pages, m)} for h, pages in seen.items()}
    want = []
    for i, url, page in rows:
        blocks = html_templates.main_blocks(html_templates.parse(page)[0])
        left = [b for b in blocks if not templates[html_templates.host(url)] & set(b.marks)]
        chars = [sum(len(b.text) for b in x) for x in (left, blocks)]
        if not left or blocks[0].article and 2 * chars[0] < chars[1]:
            left = blocks
        want.append((i, "\n\n".join(b.text for b in left)))
    got = [(r.page_id, r.text) for r in html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), s).collect()]
    assert sorted(got) == sorted(want) and sum(len(t) for _, t in got) < sum(len(b.text) for _, _, p in rows for b in html_templates.main_blocks(html_templates.parse(p)[0]))


def test_page_edges(spark):
    """Repeated rows, extra columns of names used within, a very long page, nulls."""
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(30_000)) + "</article>"
    rows = [(1, "http://a.example", "<p>x</p>", "k", 1, "t"), (1, "http://a.example", "<p>x</p>", "k", 1, "t"), (None, None, None, None, None, None),
            (2, "http://a.example/2", long, "k", 2, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, gone int, texts string")
    got = sorted(((r.page_id, r.n_chars) for r in html_templates.extract(pages).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 0), (2, sum(len(f"word {i}") for i in range(30_000)) + 2 * 29_999)], key=str)


def test_sentences_of_articles_stay(spark):
    rows = [(i, f"http://a.example/{i}", f"<article><p>Text {i}</p><p>Published under the usual terms.</p></article>") for i in range(20)]
    got = html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Text {r.page_id}\n\nPublished under the usual terms." for r in got)


def test_page_of_many_tags_is_linear():
    import time
    begin = time.time()
    html_templates.parse("<a <b " * 50_000 + "<p>x" * 20_000 + "<!" * 20_000)
    assert time.time() - begin < 20


# --- pipeline ---


def test_stages_keep_the_columns(spark, edges, tmp_path):
    docs = edges
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == edges.columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = docs.collect()
    assert {r.doc_id for r in rows} >= {3, 6} and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_pipeline_equals_its_parts(spark):
    """Each stage by a plain version, over what the one before kept."""
    import zlib

    from scrubline.llm import line_chunks, repeats, toxicity
    from tests.llm.test_repeats_and_lines import plain, plain_lines
    from tests.llm.test_simhash import plain_fingerprint, plain_groups
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    model = toxicity.fit(table, spark.read.parquet(f"{DATA}/labels.parquet"))
    place = model.place()

    def score(text):
        found = place[toxicity.hashed_grams(text, model.settings)]
        return 1 / (1 + math.exp(-(model.intercept + model.weights[np.unique(found[found >= 0])].sum())))

    docs = {i: t for i, t in docs.items() if score(t) < corpus_pipeline.TOXIC}
    docs = {i: t for i, t, _, _ in plain_lines(list(docs.items()))}
    groups = plain_groups({i: plain_fingerprint(t) for i, t in docs.items()})
    docs = {i: t for i, t in docs.items() if groups[i] == i}
    raw = {i: t.encode() for i, t in docs.items()}
    cut = {}
    for (i, text), gone in zip(raw.items(), plain(list(raw.values()), 200)):
        edges = [0, *(e for span in gone for e in span), len(text)]
        cut[i] = "".join(text[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2]))
    from tokenizers import Tokenizer

    from scrubline.llm import packing
    from tests.llm.test_tokens import checked
    tokenizer = Tokenizer.from_file(packing.settings().tokenizer)
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in cut.items()}
    checked(corpus_pipeline.run(spark, DATA).collect(), ids, 4096)


def test_entry_without_this_folder(tmp_path):
    """The library and its entry points work where this folder and the pipeline are gone."""
    import shutil
    from pathlib import Path
    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "scrubline", tmp_path / "scrubline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'redact_document' in q "
                           "and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_all_queries_are_registered():
    import __spark_entry__ as entry
    names = Counter(n.split("_")[0] for n in entry.queries() if n.startswith("op"))
    assert names == {f"op{n}": 1 for n in range(1, 14)} and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "suffix-array dedup", "packing"]


def test_settings_are_values():
    assert replace(winnowing.Settings(), gram=3) != winnowing.Settings()
