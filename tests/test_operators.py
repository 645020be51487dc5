import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.operators import audit
from scrubline.operators.findings import findings
from scrubline.operators.redact import (
    Redactor, assemble_blocks, redact, redact_blocks, redact_column, redact_json_text, redact_lines, redact_markup,
    redact_nested, redact_table)
from tests.plain import mails_and_ips

PLAIN = Redactor(detectors=("emails", "ips"))


def test_lines(spark):
    text = "a@example.com\n\n  \nplain\n10.0.0.1 and\n10.0.0.2"
    df = spark.createDataFrame([(1, text, "en"), (2, None, "en"), (3, "", "en")], "doc_id INT, text STRING, lang STRING")
    rows = redact_lines(df, redactor=PLAIN).orderBy("doc_id").collect()
    assert rows[0].text == "[EMAIL:example.com]\n\n  \nplain\n[PRIVATE_IPV4] and\n[PRIVATE_IPV4]"
    assert (rows[0].n_blocks, rows[0].n_changed, rows[0].lang) == (4, 3, "en")
    assert (rows[1].text, rows[1].n_blocks, rows[2].n_changed) == ("", 0, 0)
    plan = redact_lines(df, redactor=PLAIN)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_line_is_a_unit_of_its_own(spark):
    """Blanks in patterns cross line ends, so by line and by document are two different jobs."""
    df = spark.createDataFrame([(1, "call 555\n123\n4567")], "doc_id INT, text STRING")
    r = Redactor(detectors=("phones",))
    assert redact_column(df, "text", r).first().text == "call [PHONE:US]"
    assert redact_lines(df, redactor=r).first().text == "call 555\n123\n4567"


def test_blocks_and_assembly(spark):
    blocks = spark.createDataFrame(
        [(1, 1, "body", "x 10.0.0.1"), (1, 0, "header", "a@example.com"), (1, 2, "table", " "), (1, 10, "footer", "z"),
         (2, 0, "body", None)], "doc_id INT, block_no INT, kind STRING, text STRING")
    done = redact_blocks(blocks, PLAIN)
    assert [(r.kind, r.changed) for r in done.orderBy("doc_id", "block_no").collect()] == [
        ("header", True), ("body", True), ("table", False), ("footer", False), ("body", False)]
    whole = assemble_blocks(done).orderBy("doc_id").collect()
    assert tuple(whole[0]) == (1, "[EMAIL:example.com]\nx [PRIVATE_IPV4]\n \nz", 3, 2)
    assert tuple(whole[1]) == (2, "", 0, 0)


def test_table(spark):
    schema = "`e mail` STRING, n INT, `a.b` STRING, d DECIMAL(5,2), b BINARY, `back``tick` STRING"
    df = spark.createDataFrame([("a@example.com", 10, "10.0.0.1", None, b"a@example.com", "x"),
                                (None, None, None, None, None, None)], schema)
    done = redact_table(df, PLAIN)
    assert done.schema == df.schema
    assert tuple(done.collect()[0]) == ("[EMAIL:example.com]", 10, "[PRIVATE_IPV4]", None, b"a@example.com", "x")
    assert set(done.collect()[1]) == {None}
    some = redact_table(df, PLAIN, ["e mail"]).first()
    assert some["a.b"] == "10.0.0.1" and some["e mail"] == "[EMAIL:example.com]"
    with pytest.raises(ValueError):
        redact_table(df, PLAIN, ["n"])
    numbers = spark.range(3)
    assert redact_table(numbers, PLAIN) is numbers


NESTED = T.StructType([
    T.StructField("company", T.StructType([T.StructField("name", T.StringType()), T.StructField("established", T.IntegerType()),
                                           T.StructField("ip", T.StringType())])),
    T.StructField("people", T.ArrayType(T.StructType([
        T.StructField("mail", T.StringType()), T.StructField("mfa", T.BooleanType()),
        T.StructField("keys", T.MapType(T.StringType(), T.ArrayType(T.StringType())))]))),
    T.StructField("amounts", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("grid", T.ArrayType(T.ArrayType(T.StringType())))])


def test_nested(spark):
    value = {"company": {"name": "Acme 10.0.0.1", "established": 1999, "ip": "203.0.113.9"},
             "people": [{"mail": "a@example.com", "mfa": True, "keys": {"a@example.com": ["10.1.2.3", None, "x"]}},
                        {"mail": None, "mfa": None, "keys": None}, None],
             "amounts": {"a@example.com": 250000}, "grid": [["a@example.com"], None, []]}
    df = spark.createDataFrame([(value["company"], value["people"], value["amounts"], value["grid"]),
                                (None, None, None, None), ({"name": "x"}, [], {}, [["y"]])], NESTED)
    done = redact_nested(df, PLAIN)
    assert [f.dataType.simpleString() for f in done.schema] == [f.dataType.simpleString() for f in df.schema]
    first, second, third = done.collect()
    assert first.company.asDict() == {"name": "Acme [PRIVATE_IPV4]", "established": 1999, "ip": "[PUBLIC_IPV4]"}
    assert first.people[0].mail == "[EMAIL:example.com]" and first.people[0].mfa is True
    assert first.people[0]["keys"] == {"a@example.com": ["[PRIVATE_IPV4]", None, "x"]}  # keys are kept
    assert first.people[1].mail is None and first.people[2] is None
    assert first.amounts == {"a@example.com": 250000} and first.grid == [["[EMAIL:example.com]"], None, []]
    assert tuple(second) == (None,) * 4
    assert third == df.collect()[2]
    only = redact_nested(df, PLAIN, ["grid"]).first()
    assert only.grid[0] == ["[EMAIL:example.com]"] and only.company.ip == "203.0.113.9"


def test_many_leaves_and_deep_ones(spark):
    """Written back by place: linear in the leaves, and right where NULLs and empty arrays stand between."""
    row = [{"b": [{"x": f"u{i}@example.com", "y": None}, {}], "c": f"10.0.0.{i}"} if i % 3 else {"b": None, "c": None} for i in range(9)] + [None]
    df = spark.createDataFrame([(row, None)], "a ARRAY<STRUCT<b: ARRAY<MAP<STRING, STRING>>, c: STRING>>, s STRING")
    df = df.select("a", F.expr("""parse_json('{"k@example.com": "k@example.com", "n": [1, "10.0.0.1", "say \\\\"hi\\\\" 10.0.0.2"]}')""").alias("v"))
    done = redact_nested(df, PLAIN).select("a", F.to_json("v").alias("v")).first()
    for i, r in enumerate(done.a[:9]):
        assert (r.b, r.c) == ([{"x": "[EMAIL:example.com]", "y": None}, {}], "[PRIVATE_IPV4]") if i % 3 else (None, None)
    assert done.a[9] is None
    assert json.loads(done.v) == {"k@example.com": "[EMAIL:example.com]", "n": [1, "[PRIVATE_IPV4]", 'say "hi" [PRIVATE_IPV4]']}
    with pytest.raises(ValueError):
        redact_nested(spark.sql("SELECT array(parse_json('1')) AS v"), PLAIN)
    times = []
    for n in (5_000, 40_000):
        many = spark.range(1).select(F.expr(f"transform(sequence(1, {n}), i -> concat('u', i, '@example.com'))").alias("a"))
        begin = time.time()
        assert set(redact_nested(many, PLAIN).first().a) == {"[EMAIL:example.com]"}
        times.append(time.time() - begin)
    assert times[1] < 4 + 8 * times[0]


def test_json_text(spark):
    rows = ['{"amount": 250000, "mail": "a@example.com"}', '{"mail": "a@example.com"}', "no json"]
    df = spark.createDataFrame([(r,) for r in rows], "json STRING")
    done = redact_json_text(df, "json", Redactor(detectors=("emails", "phones"))).collect()
    assert [(r.json, r.is_json) for r in done] == [
        ('{"amount": [PHONE], "mail": "[EMAIL:example.com]"}', False), ('{"mail": "[EMAIL:example.com]"}', True),
        ("no json", False)]


def test_markup(spark):
    html = '<a href="mailto:a@example.com">b@example.com</a> <b>10.0.0.1'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id INT, html STRING")
    whole = redact_markup(df, "html", PLAIN).orderBy("page_id").collect()
    # the scheme is made of characters an address may hold before its @ except for the colon
    assert whole[0].html == '<a href="mailto:[EMAIL:example.com]">[EMAIL:example.com]</a> <b>[PRIVATE_IPV4]'
    assert whole[0].n == 3 and whole[1].html == ""
    nodes = redact_markup(df, "html", PLAIN, text_nodes_only=True).orderBy("page_id").collect()
    assert nodes[0].html == '<a href="mailto:a@example.com">[EMAIL:example.com]</a> <b>[PRIVATE_IPV4]'
    assert nodes[0].n == 2 and nodes[1].html == ""


@pytest.fixture
def corpus(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", f"{'a@example.com ' * (i % 4)}10.0.0.{i}" if i % 2 else "nothing")
            for i in range(90)]
    return spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING").repartition(6), rows


def test_stats_equal_a_count_by_hand(spark, corpus):
    df, rows = corpus
    expected = {}
    for _, source, text in rows:
        for d in ("emails", "ips"):
            own = sum(f[0] == d for f in mails_and_ips(text))
            n, docs = expected.get((source, d), (0, 0))
            expected[source, d] = (n + own, docs + (own > 0))
    stats = audit.redaction_stats(df, ("source",), redactor=PLAIN)
    assert {(r.source, r.detector): (r.n, r.docs) for r in stats.collect()} == expected
    cube = audit.rollup_stats(stats, ("source",))
    total = cube.where("source IS NULL AND detector IS NULL").first()
    assert total.n == sum(n for n, _ in expected.values())
    once = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING")
    plan = audit.redaction_stats(once, ("source",), redactor=PLAIN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    detectors = {r.detector: r for r in audit.audit_detectors(df, redactor=PLAIN).collect()}
    assert detectors["ips"].docs_total == 90 and detectors["ips"].share == detectors["ips"].docs / 90


def test_riskiest(corpus):
    df, rows = corpus
    totals = {}
    for i, source, text in rows:
        n = len(mails_and_ips(text))
        if n:
            totals.setdefault(source, []).append((-n, i))
    expected = {(s, i): (-n, k + 1) for s, v in totals.items() for k, (n, i) in enumerate(sorted(v)[:2])}
    got = audit.riskiest(df, 2, redactor=PLAIN)
    assert {(r.source, r.doc_id): (r.n_total, r["rank"]) for r in got.collect()} == expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_values(corpus):
    df, rows = corpus
    found = [f for _, _, text in rows for f in mails_and_ips(text)]
    exact = {r.detector: (r.n, r["values"]) for r in audit.distinct_values(df, redactor=PLAIN).collect()}
    assert exact == {d: (sum(f[0] == d for f in found), len({f[1] for f in found if f[0] == d})) for d in ("emails", "ips")}
    rough = {r.detector: r["values"] for r in audit.distinct_values(df, redactor=PLAIN, approximate=True).collect()}
    assert abs(rough["ips"] - exact["ips"][1]) <= 5
    top = audit.top_values(df, 2, redactor=PLAIN).collect()
    assert (top[0].match, top[0].n) == ("a@example.com", exact["emails"][0]) and len(top) == 2


def test_columns_and_residue(corpus):
    df, _ = corpus
    by = {(r["column"], r.detector): (r.rows, r.rows_hit) for r in audit.audit_columns(df, ["source", "text"], PLAIN).collect()}
    assert by["source", "ips"] == (90, 0) and by["text", "ips"] == (90, 45)
    assert audit.residual_scan(df, redactor=PLAIN).count() == 45
    assert audit.residual_scan(redact(df, redactor=PLAIN), redactor=PLAIN).count() == 0
    change = audit.length_change(df, redactor=PLAIN).orderBy("doc_id").first()
    assert (change.before, change.after, change["diff"]) == (7, 7, 0)


def test_profile(spark):
    df = spark.createDataFrame([(1, "a\nb", "http://x.example.com/a/b.HTML?q=1.txt#z"), (2, "é", "/tmp/.hidden"),
                                (3, None, "https://example.com"), (4, "", "x.tar.gz")], "doc_id INT, text STRING, p STRING")
    got = [tuple(r) for r in audit.profile_documents(df, path=F.col("p")).orderBy("doc_id").collect()]
    assert got == [(1, 2, 3, 3, "ascii", ".html"), (2, 1, 1, 2, "utf-8", ""), (3, 1, 0, 0, "ascii", ""),
                   (4, 1, 0, 0, "ascii", ".gz")]


def test_columns_are_pruned_and_filters_pushed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = audit.length_change(docs.where("lang = 'en'"), redactor=PLAIN)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "source" not in plan
    plan = findings(docs, redactor=PLAIN)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "n_chars" not in plan


def test_map_of_counts_serializes(spark):
    df = spark.createDataFrame([(1, "a@example.com")], "doc_id INT, text STRING")
    counts = json.loads(redact(df, redactor=PLAIN).select(F.to_json("counts")).first()[0])
    assert counts["emails"] == 1 and len(counts) == 12
