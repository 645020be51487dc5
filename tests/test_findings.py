import random
import re
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from scrubline.functions.labels import COUNTED_ENTITIES, ENTITY_LABELS
from scrubline.functions.text import chunks, offsets, piece, running_total
from scrubline.operators.chain import method_chain, redact_blocks_with
from scrubline.operators.dictionary import recognize_dictionary, redact_dictionary
from scrubline.operators.findings import (
    apply_findings, entity_stats, findings, recognize, redact_entities, resolve_overlaps, with_luhn, without_allowed)
from scrubline.operators.redact import Redactor, redact, redact_column
from scrubline.sources.files import write_bucketed
from tests.cases import CASES, EDGE, KEYWORDS, REPORT
from tests.plain import mails_and_ips

FOUND = "doc_id BIGINT, start INT, end INT, entity_type STRING, score DOUBLE"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").coalesce(2)


@pytest.mark.parametrize("profile", ["fixed", "ref"])
def test_findings_stand_where_they_say(spark, docs, profile):
    """Offsets, numbers and order; and the addresses of documents, told by the standard library."""
    texts = [REPORT, *EDGE, *(text for cases in CASES.values() for text, _, _ in cases)]
    texts += [r.text for r in docs.collect()]
    got = findings(frame(spark, texts), redactor=Redactor(KEYWORDS, profile=profile)).collect()
    by_rule = {}
    for r in got:
        assert texts[r.doc_id][r.start:r.end] == r.match and r.value in r.match and re.fullmatch(r"\[[A-Z0-9_]+(:.+)?\]", r.label)
        by_rule.setdefault((r.doc_id, r.detector, r.rule_no), []).append(r)
    for rows in by_rule.values():
        rows.sort(key=lambda r: r.ord)
        assert [r.ord for r in rows] == list(range(len(rows))) and all(a.end <= b.start for a, b in zip(rows, rows[1:]))
    assert {(d, n) for _, d, n in by_rule} >= {(d, 1) for d in CASES if (d, profile) != ("passwords", "ref")}
    for i, r in enumerate(docs.collect(), len(texts) - docs.count()):
        mine = [(f.match, f.label) for f in by_rule.get((i, "ips", 1), [])]
        assert mine == [f[1:] for f in mails_and_ips(re.sub(r"[^0-9.]+|\.+(?![0-9])", " ", r.text)) if f[0] == "ips"]


def test_counts_tie_out_for_a_single_rule(spark, docs):
    r = Redactor(detectors=("emails",))
    per_doc = findings(docs, redactor=r).groupBy("doc_id").count()
    counts = redact(docs, redactor=r).where("n_total > 0").select("doc_id", "n_total")
    assert sorted(per_doc.collect()) == sorted((x.doc_id, x.n_total) for x in counts.collect())


def test_length_is_accounted_for(spark, docs):
    """Length after = length before - matches + labels."""
    r = Redactor(detectors=("emails",))
    change = findings(docs, redactor=r).groupBy("doc_id").agg(
        F.sum(F.length("label") - F.length("match")).alias("change"))
    done = redact(docs, redactor=r).join(change, "doc_id", "left").na.fill(0, ["change"])
    assert done.where("len_after <> len_before + change").count() == 0


def test_running_total_and_offsets(spark):
    rng = random.Random(1)
    arrays = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 2, 127, 128, 129, 1000, 20_000)]
    df = spark.createDataFrame([(a,) for a in arrays], "a ARRAY<INT>")
    for block, levels in ((7, 1), (5, 2), (3, 3)):
        for row in df.select("a", F.expr(running_total("a", block, levels)).alias("b")).collect():
            assert row.b == list(accumulate(row.a, initial=0))[:len(row.a)]
    text = "é" * 600 + " ab 🦆 ab" * 300
    got = spark.createDataFrame([(text,)], "t STRING").select(
        F.expr(offsets("split(t, 'ab', -1)", "regexp_extract_all(t, 'ab', 0)")).alias("at"),
        F.expr(chunks("t")).alias("cut")).withColumn("p", F.expr(piece("cut", "510", "1030"))).first()
    assert got.at == [m.start() for m in re.finditer("ab", text)] and got.p == text[510:1030]


def greedy(spans):
    """Reference for the overlap rule: higher score, longer, earlier."""
    taken = []
    for s in sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[0], ENTITY_LABELS[s[2]])):
        if all(s[1] <= t[0] or t[1] <= s[0] for t in taken):
            taken.append(s)
    return sorted(taken)


def test_overlaps_and_application_equal_brute_force(spark):
    rng, rows, texts = random.Random(2), [], []
    for doc in range(40):
        texts.append("".join(rng.choice("abc é🦆\n") for _ in range(rng.choice((0, 5, 60, 1500)))))
        for _ in range(rng.randrange(30) if texts[-1] else 0):
            start = rng.randrange(len(texts[-1]))
            end = min(len(texts[-1]), start + rng.randrange(1, 12))
            rows.append((doc, start, end, rng.choice(("PERSON", "LOCATION", "URL")), rng.randrange(3) / 2))
    rows += rows[:50]  # copies
    found, df = spark.createDataFrame(rows, FOUND), frame(spark, texts)
    expected = []
    for doc, text in enumerate(texts):
        best = greedy([r[1:] for r in rows if r[0] == doc])
        out, last = "", 0
        for start, end, kind, _ in best:
            out, last = out + text[last:start] + ENTITY_LABELS[kind], end
        expected.append((doc, out + text[last:], len(best)))
    assert sorted(map(tuple, apply_findings(df, found).collect())) == expected

    by_text = {t: [r[1:] for r in rows if texts[r[0]] == t] for t in texts}
    # the labels break ties in one place and the order of arrival in the other: leave out equal spans
    distinct = {t: list({(s, e): (s, e, k, sc) for s, e, k, sc in sorted(v, key=lambda x: x[3])}.values())
                for t, v in by_text.items()}
    in_row = redact_entities(df, lambda: lambda text: distinct[text]).collect()
    joined = apply_findings(df, spark.createDataFrame(
        [(i, *s) for i, t in enumerate(texts) for s in distinct[t]], FOUND)).collect()
    assert sorted(map(tuple, in_row)) == sorted(map(tuple, joined))


def test_a_hot_document_and_copies(spark):
    text = "ab " * 5000
    found = spark.range(5000).select(
        F.lit(0).cast("bigint").alias("doc_id"), (F.col("id") * 3).cast("int").alias("start"),
        (F.col("id") * 3 + 2).cast("int").alias("end"), F.lit("PERSON").alias("entity_type"), F.lit(1.0).alias("score"))
    done = apply_findings(frame(spark, [text, "x"]), found.union(found).union(found)).orderBy("doc_id").collect()
    assert done[0].text == "[PERSON_NAME] " * 5000 and done[0].n == 5000 and done[1].text == "x"


def test_equals_the_rules_when_fed_with_their_findings(spark, docs):
    r = Redactor(detectors=("emails",))
    assert (sorted(apply_findings(docs, findings(docs, redactor=r)).collect())
            == sorted(redact_column(docs, "text", r).collect()))


def test_label_map_is_data(spark):
    df = frame(spark, ["Bob in Rome"])
    found = spark.createDataFrame([(0, 0, 3, "PERSON", 1.0), (0, 7, 11, "CITY", 1.0)], FOUND)
    assert apply_findings(df, found).first().text == "[PERSON_NAME] in <CITY>"
    assert apply_findings(df, found, label_map={"CITY": "*"}).first().text == "<PERSON> in *"
    assert apply_findings(df, found, label_map={}).first().text == "<PERSON> in <CITY>"


def test_resolve_shuffles_by_document_only(spark):
    found = spark.createDataFrame([(0, 0, 3, "[A]", 1.0)], "doc_id BIGINT, start INT, end INT, label STRING, score DOUBLE")
    plan = resolve_overlaps(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # copies merged, then documents


def test_a_bucketed_corpus_is_not_shuffled(spark, docs, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}'")
    try:
        write_bucketed(docs, "bucketed.docs", 4)
        table, r = spark.table("bucketed.docs"), Redactor(detectors=("emails", "ips"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        done = apply_findings(table, findings(table, redactor=r))
        assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
        assert sorted(done.collect()) == sorted(redact_column(docs, "text", r).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE IF EXISTS bucketed CASCADE")


DICTIONARY = [("Acme", "COMPANY"), ("Acme Corp", "COMPANY"), ("new york", "LOCATION"), ("été", "PERSON"), ("it is", "URL")]


@pytest.fixture
def dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "keyword STRING, entity_type STRING")


def brute_dictionary(text):
    rows = []
    for keyword, kind in DICTIONARY:
        for m in re.finditer(rf"(?=\b({re.escape(keyword)})\b)", text or "", re.I):
            rows.append((kind, m.start(1), m.end(1), m.group(1)))
    return sorted(rows)


def test_dictionary_equals_brute_force(spark, docs, dictionary):
    texts = ["ACME corp in New York, new  york", "acmes acme", "Été été étés", "", None] + [r.text for r in docs.collect()]
    df = frame(spark, texts)
    for threshold in (str(10 ** 7), "-1"):  # broadcast or not is Spark's choice and changes nothing
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = {}
            for r in recognize_dictionary(df, dictionary).collect():
                got.setdefault(r.doc_id, []).append((r.entity_type, r.start, r.end, r.match))
            for i, text in enumerate(texts):
                assert sorted(got.get(i, [])) == brute_dictionary(text)
            assert redact_dictionary(df, dictionary).orderBy("doc_id").first().text == "[COMPANY_NAME] in [ADDRESS], new  york"
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def redacted(spark, entries, texts):
    table = spark.createDataFrame(entries, "keyword STRING, entity_type STRING")
    return [r.text for r in redact_dictionary(frame(spark, texts), table).orderBy("doc_id").collect()]


def test_dictionary_of_any_script_and_symbols(spark):
    cafe = "cafe\u0301"  # with a combining accent
    assert redacted(spark, [("नमस्ते", "PERSON"), (cafe, "PERSON")], ["say नमस्ते now", f"Un {cafe}, s'il", "cafe"]) == [
        "say [PERSON_NAME] now", "Un [PERSON_NAME], s'il", "cafe"]
    assert redacted(spark, [("Acme", "COMPANY")], ["acme½ Acme", "acme_ acme"]) == ["[COMPANY_NAME]½ [COMPANY_NAME]", "acme_ [COMPANY_NAME]"]
    assert redacted(spark, [("Acme", "LOCATION"), ("acme", "COMPANY")], ["Acme"]) == ["[ADDRESS]"]
    assert redacted(spark, [("C++", "COMPANY"), (".NET", "COMPANY"), ("C", "URL")], ["c++, .Net, c+ x.net nets"]) == [
        "[COMPANY_NAME], [COMPANY_NAME], [URL]+ x[COMPANY_NAME] nets"]


def test_dictionary_of_many_overlapping_names(spark):
    entries = [(f"n{i}", "PERSON") for i in range(5000)] + [(f"n{i} n{i + 1}", "COMPANY") for i in range(0, 5000, 2)] + [("n1 n2 n3", "LOCATION")]
    assert redacted(spark, entries, ["n0 n1 n2 n3", "n4 n5, n6", "n4999 n5000 n5001"]) == [
        "[PERSON_NAME] [ADDRESS]", "[COMPANY_NAME], [PERSON_NAME]", "[PERSON_NAME] n5000 n5001"]


def test_rows_that_share_an_id(spark):
    """Turns have two keys; rows that share even those are told apart by their text."""
    rows = [(1, 1, "acme is one"), (1, 2, "one is acme"), (2, 1, "acme"), (2, 1, "no acme"), (2, 1, "no acme"), (None, None, "acme")]
    df = spark.createDataFrame(rows, "conv_id INT, turn INT, text STRING")
    table = spark.createDataFrame([("Acme", "COMPANY")], "keyword STRING, entity_type STRING")
    got = redact_dictionary(df, table, ("conv_id", "turn")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [
        type(got[0])(conv_id=a, turn=b, text=t.replace("acme", "[COMPANY_NAME]"), n=1) for a, b, t in rows]))
    by_conv = redact_dictionary(df, table, "conv_id").where("conv_id = 1").collect()
    assert sorted(r.text for r in by_conv) == ["[COMPANY_NAME] is one", "one is [COMPANY_NAME]"]


def test_dictionary_shuffles_little(spark, docs, dictionary):
    """Only runs of words whose bit is set become rows."""
    plan = recognize_dictionary(docs, dictionary)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_the_map_of_a_dictionary_is_no_column(spark, docs, dictionary):
    """As a column it would be copied into the row of every text: texts times entries."""
    plan = recognize_dictionary(docs, dictionary)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan and "_map#" not in plan


def test_dictionary_refuses_what_has_no_word_and_takes_none(spark, docs):
    with pytest.raises(Exception, match="without any word character"):
        recognize_dictionary(docs, spark.createDataFrame([("++", "COMPANY")], "keyword STRING, entity_type STRING")).collect()
    empty = spark.createDataFrame([], "keyword STRING, entity_type STRING")
    assert recognize_dictionary(docs, empty).count() == 0
    assert redact_dictionary(docs, empty).where("n > 0").count() == 0


@pytest.fixture
def load_names():
    def load():  # a function within a function travels to the workers by itself
        name = re.compile(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")
        return lambda text: [(m.start(), m.end(), "PERSON", 0.8) for m in name.finditer(text)]
    return load


def test_recognizer_hook(spark, load_names):
    df = frame(spark, ["Jane Doe met John Roe", None, "nobody", "🦆 Jane Doe"])
    got = recognize(df, load_names).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.match, r.start) for r in got] == [(0, "Jane Doe", 0), (0, "John Roe", 13), (3, "Jane Doe", 2)]
    done = redact_entities(df, load_names).orderBy("doc_id").collect()
    assert [tuple(r) for r in done] == [(0, "[PERSON_NAME] met [PERSON_NAME]", 2), (1, "", 0), (2, "nobody", 0),
                                        (3, "🦆 [PERSON_NAME]", 1)]
    plan = redact_entities(df, load_names)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_entity_stats_lists_all_types(spark):
    found = spark.createDataFrame([(0, 0, 1, "PERSON", 1.0), (1, 0, 1, "PERSON", 1.0), (1, 2, 3, "API_KEY", 1.0)], FOUND)
    got = {r.entity_type: r.n for r in entity_stats(found).collect()}
    assert set(got) == set(COUNTED_ENTITIES) and len(got) == 18 and got.pop("PERSON") == 2 and not any(got.values())


def test_luhn(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111",), ("4111-1111-1111-1112",), ("x",), ("",)], "value STRING")
    assert [r.luhn_valid for r in with_luhn(df).collect()] == [True, False, False, False]


def test_allow_list(spark):
    found = spark.createDataFrame([("a", "Example.org"), ("b", "x")], "k STRING, match STRING")
    allowed = spark.createDataFrame([("example.ORG",), ("example.org",)], "value STRING")
    assert [r.k for r in without_allowed(found, allowed).collect()] == ["b"]


def test_method_chain(spark, dictionary, load_names):
    df = frame(spark, ["Acme a@example.com", None])
    rules = Redactor(detectors=("emails",))
    done = method_chain(df, ["Regex", "OFFLINE_MODEL"], redactor=rules, dictionary=dictionary).orderBy("doc_id").collect()
    assert [r.text for r in done] == ["[COMPANY_NAME] [EMAIL:example.com]", ""]
    assert method_chain(df, "regex", redactor=rules).orderBy("doc_id").first().text == "Acme [EMAIL:example.com]"
    model = method_chain(df, "offline_model", recognizer=load_names)
    assert model.orderBy("doc_id").first().text == "Acme a@example.com"
    with pytest.warns(UserWarning):
        assert method_chain(df, "magic").orderBy("doc_id").first().text == "Acme a@example.com"
    with pytest.warns(UserWarning):
        assert method_chain(df, "offline_model").orderBy("doc_id").first().text == "Acme a@example.com"


def test_blocks_through_rules_and_recognizer(spark, load_names):
    blocks = spark.createDataFrame([(1, 0, "Jane Doe a@example.com"), (1, 1, " "), (1, 2, "plain")],
                                   "doc_id INT, block_no INT, text STRING")
    done = redact_blocks_with(blocks, load_names, Redactor(detectors=("emails",))).orderBy("block_no").collect()
    assert [(r.redacted, r.changed) for r in done] == [("[PERSON_NAME] [EMAIL:example.com]", True), (" ", False),
                                                       ("plain", False)]
