"""Texts in pieces, second runs, agreement, sketches, metrics and the map of a dictionary."""

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from scrubline.functions import segments as segments_of
from scrubline.functions.passes import _split, digit_runs, digits, matches, may_match
from scrubline.functions.rules import rules
from scrubline.functions.segments import segments
from scrubline.functions.text import hits, let, quote
from scrubline.operators import audit
from scrubline.operators.dictionary import MOST_BITS, map_bits, recognize_dictionary
from scrubline.operators.findings import findings
from scrubline.operators.incremental import changes, first_run, merged, rule_version
from scrubline.operators.redact import Redactor, redact, redact_column, redact_long_texts
from scrubline.sources.files import run_metrics, write_observed
from tests.cases import CASES, EDGE, KEYWORDS, REPORT

PROSE = ["Plain words of a sentence that goes on for quite a while, without any number.", "They said nothing of it; nobody asked them to do so in all that time.",
         "Ask for the passport.", "It was the staff id.", "One more line with a stop at its end and nothing else to be found there!", "short.", "no stop at the end of this line of words"]
PLANTED = [text for cases in CASES.values() for text, _, _ in cases] + [REPORT, "EVERYTHING was there", "abcd efgh", '"password": "abc', 'def ghi jkl"', "12 Some Names", "And More Street",
                                                                        "<password>", "</password>", "office: 12 x", "Street y 12345", "born", "1990-01-31", "card", "4111 1111", "1111 1111"]


def whole(redactor):
    """The same rules over whole texts."""
    r = Redactor(KEYWORDS, redactor.detectors, redactor.profile)
    r.cuts = False
    return r


def made(rng, n):
    return "\n".join(rng.choice(PROSE) if rng.random() < 0.7 else rng.choice(PLANTED) for _ in range(n))


def test_cutting_changes_nothing(spark, docs):
    rng = random.Random(9)
    texts = [made(rng, rng.randrange(1, 30)) for _ in range(400)] + EDGE + [REPORT] + [r.text for r in docs.limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i LONG, text STRING").repartition(8)
    r = Redactor(KEYWORDS)
    cut, plain = (redact(df, redactor=x).orderBy("i").collect() for x in (r, whole(r)))
    for a, b in zip(cut, plain):
        assert a == b, texts[a.i]
    parts = df.where("text IS NOT NULL").select("text", F.expr(segments("text")).alias("p")).collect()
    assert all("\n".join(x.p) == x.text for x in parts) and sum(len(x.p) for x in parts) > 800


def test_cutting_changes_no_finding(spark, docs):
    rng = random.Random(10)
    texts = [made(rng, rng.randrange(1, 30)) for _ in range(300)] + EDGE + [REPORT, None] + [r.text for r in docs.limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(8)
    r = Redactor(KEYWORDS)
    cut, plain = (sorted(findings(df, redactor=x).collect()) for x in (r, whole(r)))
    assert cut == plain and max(x.ord for x in cut) > 5
    for x in cut:
        assert texts[x.doc_id][x.start:x.end] == x.match


def test_matches_are_searched_for_once():
    for rule in rules(keywords=KEYWORDS):
        assert matches("_parts", rule).count(hits("part.t", rule.pattern)) == 1


def test_cheap_tests_let_every_match_through(spark):
    """Also matches with letters that a pattern that ignores case takes for others, in either profile."""
    texts = PLANTED + EDGE + [x + " 12" for x in ("phone 1234567", "9 dollars", "NIS 5", "5 ILS", "5 shekels", "price is 10", "Visa 4111111111111111", "P.O. Box 9", "3 Sep 2020")]
    texts = [t for t in texts if t]
    texts += [t.upper() for t in texts] + [t.replace(a, b) for t in texts for a, b in (("s", "ſ"), ("S", "ſ"), ("i", "İ"), ("I", "ı"), ("i", "ı"), ("k", "\u212a"))]
    df = spark.createDataFrame(list(enumerate(dict.fromkeys(texts))), "i INT, t STRING")
    for profile in ("fixed", "ref"):
        table = rules(profile, KEYWORDS)
        each = ", ".join(f"({may_match('t', r, digits('runs'), 'runs')}) = (t RLIKE {quote(r.pattern)})" for r in table)
        for row in df.select("t", F.expr(let("runs", digit_runs("t"), f"array({each})")).alias("same")).collect():
            assert all(row.same), (row.t, [table[i] for i, same in enumerate(row.same) if not same])


def test_digits_that_no_run_of_which_fits_cost_no_search(spark):
    """Sixteen digits in pairs, and none of the words that costly patterns ask for."""
    text, asked = quote("of 12 and 34 and 56 and 78 and 90, of 12 and 34 and 56"), [r for r in rules() if r.needs_runs or r.needs_words]
    each = ", ".join(may_match(text, replace(r, pattern="", needs_pattern=None), digits("runs"), "runs") for r in asked)
    passed = spark.range(1).select(F.expr(let("runs", digit_runs(text), f"array({each})")).alias("x")).first().x
    assert {(r.detector, r.no) for r, x in zip(asked, passed) if x} == {("phones", 1), ("ips", 1), ("dates", 1)}


def test_profile_ref_and_own_rules_are_not_cut():
    assert not Redactor(profile="ref").cuts and not Redactor(("a\nb",)).cuts and Redactor().cuts


def test_long_texts_in_pieces(spark):
    rng = random.Random(4)
    rows = [(i, "x", made(rng, n)) for i, n in enumerate((0, 5, 400, 3000, 3))] + [(7, "y", None), (8, "y", "a@example.com " * 9000)]
    df = spark.createDataFrame(rows, "id LONG, other STRING, text STRING")
    got = redact_long_texts(df, ["id"], redactor=Redactor(KEYWORDS), size=2000).orderBy("id").collect()
    want = redact_column(df, "text", whole(Redactor(KEYWORDS))).orderBy("id").collect()
    assert got == want
    assert redact_long_texts(df, ["id"], redactor=Redactor(profile="ref"), size=2000).count() == len(rows)


def test_second_run(spark, tmp_path):
    """A result that equals a run from scratch; only what is new passes through the rules."""
    r = Redactor(detectors=("emails", "ips"))
    first = spark.createDataFrame([(i, f"u{i}@example.com") for i in range(50)] + [(60, None), (61, "")], "doc_id LONG, text STRING")
    first_run(first, redactor=r).write.parquet(str(tmp_path / "one"))
    last = spark.read.parquet(str(tmp_path / "one"))
    second = first.where("doc_id <> 3").withColumn("text", F.when(F.col("doc_id") == 5, "10.0.0.1").otherwise(F.col("text"))).union(
        spark.createDataFrame([(100, "10.0.0.1"), (101, "u1@example.com")], "doc_id LONG, text STRING"))
    new = changes(second, last, redactor=r)
    assert sorted(x.doc_id for x in new.collect()) == [5, 100, 101]
    assert "ReadSchema: struct<doc_id:bigint,hash:string,version:string>" in new._jdf.queryExecution().executedPlan().toString()
    assert sorted(merged(second, last, new, redactor=r).collect()) == sorted(first_run(second, redactor=r).collect())
    other = Redactor(detectors=("emails",))
    assert rule_version(other) != rule_version(r) and changes(second, last, redactor=other).count() == second.count()
    assert sorted(merged(second, last, changes(second, last, redactor=other), redactor=other).collect()) == sorted(first_run(second, redactor=other).collect())


def test_agreement_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6) if i % 2 else 0, s := rng.randrange(3000), s + rng.choice((1, 5, 200, 700)), rng.choice(("[A]", "[B:x]", "[B:y]")), rng.choice("pqr")) for i in range(900)]
    found = spark.createDataFrame(rows + rows[:30], "doc_id INT, start INT, end INT, label STRING, recognizer STRING").repartition(4)
    got = {(r.one, r.two): tuple(r)[2:] for r in audit.agreement(found).collect()}
    distinct = {(d, s, e, label[1], who) for d, s, e, label, who in rows}
    for one, two in (("p", "q"), ("p", "r"), ("q", "r")):
        a, b = ([x for x in distinct if x[4] == who] for who in (one, two))
        met = [(x, y) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]
        assert got[one, two] == (len(met), sum(x[1:3] == y[1:3] for x, y in met), sum(x[3] != y[3] for x, y in met),
                                 len(a) - len({x for x, _ in met}), len(b) - len({y for _, y in met}))


def test_a_text_with_very_many_findings(spark):
    """Ten thousand findings of each of two recognizers in one text meet in stretches of it."""
    found = spark.range(10_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 7).cast("int").alias("start"), (F.col("id") * 7 + 5).cast("int").alias("end"),
                                       F.lit("[A]").alias("label"), F.explode(F.array(F.lit("p"), F.lit("q"))).alias("recognizer"))
    assert tuple(audit.agreement(found).first()) == ("p", "q", 10_000, 10_000, 0, 0, 0)


def test_sketches_of_parts_make_that_of_all(spark):
    found = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "emails").otherwise("ips").alias("detector"),
                                       F.when(F.col("id") % 5 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 20_000)).alias("match"), (F.col("id") % 4).alias("part"))
    exact = {r.detector: r for r in found.groupBy("detector").agg(F.count("*").alias("n"), F.countDistinct("match").alias("d"),
                                                                  F.count_if(F.col("match") == "hot").alias("hot")).collect()}
    parts = audit.value_sketches(found, ("part",))
    assert parts.count() == 8
    for sketches in (audit.merge_sketches(parts), audit.value_sketches(found)):
        for r in audit.read_sketches(sketches, 1).collect():
            own = exact[r.detector]
            assert r.n == own.n and abs(r["values"] - own.d) < 0.05 * own.d
            assert (r.top[0]["item"], r.top[0]["count"]) == ("hot", own.hot)


def test_metrics_of_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@example.com 10.0.0.1"), (2, "b@example.com c@example.com"), (3, None)], "doc_id INT, text STRING")
    r = Redactor(detectors=("emails", "ips"))
    got = write_observed(redact(df, redactor=r), str(tmp_path / "out"), "run", "job")
    want = run_metrics(spark.read.parquet(str(tmp_path / "out")), "run", "job")
    assert sorted(got.drop("seconds").collect()) == sorted(want.drop("seconds").collect()) and got.where("seconds > 0").count() == 12


@pytest.mark.parametrize("n", [1, 40, 30_000])
def test_the_map_lets_little_through(spark, n):
    """The same findings for a dictionary of any size; few runs of words that are no entries become rows."""
    entries = spark.range(n).select(F.concat(F.lit("name"), F.col("id").cast("string")).alias("keyword"), F.lit("PERSON").alias("entity_type"))
    texts = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" other"), F.col("id").cast("string")).alias("text"))
    texts = texts.union(spark.createDataFrame([(-1, "Name0 and name5"), (-2, f"NAME{n - 1}x name{n - 1}!")], "doc_id LONG, text STRING"))
    found = recognize_dictionary(texts, entries)
    assert {(r.doc_id, r.match) for r in found.collect()} == {(-1, "Name0"), (-2, f"name{n - 1}")} | ({(-1, "name5")} if n > 5 else set())
    assert map_bits(n) <= MOST_BITS and map_bits(10_000_000) <= 28 and 2 ** map_bits(10_000_000) >= 24 * 10_000_000


def test_cuts_are_looked_for_at_line_ends_alone(spark):
    """The plain definition, which looks back before every character, gives the same segments."""
    plain = (rf"(?<={segments_of._PLAIN}{{{segments_of.ZONE}}})(?<=\p{{L}}[.,;!?])(?<!\b(?i:{segments_of._OPEN_WORDS})[.,;!?])"
             rf"\n(?={segments_of._PLAIN}{{{segments_of.ZONE}}})")
    assert segments_of.CUT.startswith(r"\n")
    rng = random.Random(5)
    df = spark.createDataFrame([(made(rng, rng.randrange(12)),) for _ in range(200)], "text STRING")
    both = df.select(F.expr(f"split(text, {quote(plain)}, -1)"), F.expr(f"split(text, {quote(segments_of.CUT)}, -1)")).collect()
    assert all(a == b for a, b in both) and any(len(a) > 1 for a, _ in both)


def test_texts_are_taken_apart_without_compiling_for_each(spark):
    """The text between matches as ``split`` gives it, for texts with the mark itself as well."""
    taken = _split("t", "[0-9]+")
    assert "regexp_replace" in taken
    df = spark.createDataFrame([(t,) for t in ("a1b22c", "", "1", "12", "x\x00y2", "é1😀2", None)], "t STRING")
    both = df.select(F.expr("split(t, '[0-9]+', -1)"), F.expr(taken)).collect()
    assert all(a == b for a, b in both)


def test_offsets_of_runs_far_into_a_text(spark):
    text = "".join(("émile " if i % 7 else "Acme  Corp, ") for i in range(300))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id INT, text STRING")
    names = spark.createDataFrame([("acme", "A"), ("corp", "B"), ("acme  corp", "C")], "keyword STRING, entity_type STRING")
    found = {(r.start, r.end, r.match) for r in recognize_dictionary(df, names).collect()}
    assert found == {(m.start(), m.end(), m.group()) for p in ("Acme", "Corp", "Acme  Corp") for m in re.finditer(p, text)}
