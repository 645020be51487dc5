import pytest
from pyspark.sql import functions as F

from scrubline.operators.redact import Redactor, redact, redact_nested, redact_table
from scrubline.plans.corpus import redact_files
from scrubline.plans.jobs import JOBS
from scrubline.sources.files import (
    RUN_METRICS, append_run_metrics, dealt_out, read_documents, read_lines, read_table, run_metrics, write_table)

from tests.conftest import DATA

PLAIN = Redactor(detectors=("emails", "ips"))


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.txt": "a@example.com\nline".encode(), "b.MD": b"# 10.0.0.1", "latin.log": "café".encode("latin-1"),
        "t.csv": b'name,mail\r\n"x\r\n,y",a@example.com\r\nz,\r\n', "t.tsv": b"a\tb\tc\n1\t2\t3",
        "empty.csv": b"", "d.json": b'{"mail": "a@example.com", "n": 250000}', "p.html": b"<p>10.0.0.1</p>",
        "doc.pdf": b"%PDF-1.4", "w.docx": b"PK", "s.xlsx": b"PK", "z.zip": b"PK a@example.com", "noext": b"b@example.com",
        "bad.xyz": b"\xff\xfe\x00", "sub/deep.rst": b"deep",
    }
    for name, content in files.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return tmp_path


def test_documents(spark, folder):
    rows = {r.path.rsplit("/in/", 1)[1]: r for r in read_documents(spark, str(folder / "in")).collect()}
    # Spark leaves out files of length 0
    assert {k: r.format for k, r in rows.items()} == {
        "a.txt": "text", "b.MD": "text", "latin.log": "text", "t.csv": "csv", "t.tsv": "tsv",
        "d.json": "json", "p.html": "xml", "doc.pdf": "pdf", "w.docx": "word", "s.xlsx": "excel", "z.zip": "binary",
        "noext": "text", "bad.xyz": "unsupported", "sub/deep.rst": "text"}
    assert rows["a.txt"].text == "a@example.com\nline" and rows["a.txt"].lines == 2 and rows["a.txt"].size == 18
    assert (rows["latin.log"].text, rows["latin.log"].encoding) == ("café", "ISO-8859-1")
    assert (rows["a.txt"].encoding, rows["a.txt"].mime_type, rows["b.MD"].extension) == ("UTF-8", "text/plain", ".md")
    for name in ("doc.pdf", "w.docx", "s.xlsx", "z.zip", "bad.xyz"):
        assert rows[name].text == "" and rows[name].encoding is None and rows[name].lines is None
    assert (rows["t.csv"].rows, rows["t.csv"].columns) == (3, 2)
    assert (rows["t.tsv"].rows, rows["t.tsv"].columns) == (2, 3)
    assert rows["a.txt"].rows is None and rows["a.txt"].columns is None
    assert read_documents(spark, str(folder / "in"), "*.txt").count() == 1


def test_lines(spark, folder):
    assert [r.text for r in read_lines(spark, str(folder / "in" / "a.txt")).collect()] == ["a@example.com", "line"]


@pytest.mark.parametrize("fmt", ["csv", "tsv", "json", "parquet", "orc", "xml"])
def test_table_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([("x, \"y\"\nz", "a@example.com", 5), (None, "10.0.0.1", None)], "name STRING, v STRING, n INT")
    write_table(redact_table(df, PLAIN), str(tmp_path / "t"), fmt)
    back = read_table(spark, str(tmp_path / "t"), "jsonl" if fmt == "json" else fmt, "name STRING, v STRING, n INT", "row")
    assert sorted((r.v, r.n, r.name) for r in back.collect()) == sorted(
        [("[EMAIL:example.com]", 5, "x, \"y\"\nz"), ("[PRIVATE_IPV4]", None, None)])


def test_partitioned_and_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("en", "a"), ("de", "b")], "lang STRING, text STRING")
    write_table(df, str(tmp_path / "p"), "parquet", ["lang"])
    assert (tmp_path / "p" / "lang=en").is_dir()
    write_table(df.select("text"), str(tmp_path / "t"), "text")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a", "b"]
    for bad in ("pdf", "docx"):
        with pytest.raises(ValueError):
            write_table(df, str(tmp_path / "x"), bad)
        with pytest.raises(ValueError):
            read_table(spark, str(tmp_path / "t"), bad)
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "t"), "xml")


def test_json5_leaves(spark, tmp_path):
    path = tmp_path / "c.json5"
    path.write_text("// a comment\n{mails: ['a@example.com', \"x\"], nested: {ip: '10.0.0.1', amount: 250000, ok: true}}")
    done = redact_nested(read_table(spark, str(path), "json5"), PLAIN).first()
    assert done.mails == ["[EMAIL:example.com]", "x"]
    assert done.nested.asDict() == {"ip": "[PRIVATE_IPV4]", "amount": 250000, "ok": True}


def test_files_to_files_with_metrics(spark, folder):
    target, metrics = str(folder / "out"), str(folder / "metrics")
    written = redact_files(spark, str(folder / "in"), target, redactor=PLAIN, metrics=metrics, run_id="r1")
    texts = {r.path.rsplit("/in/", 1)[1]: r.text for r in written.collect()}
    assert texts["d.json"] == '{"mail": "[EMAIL:example.com]", "n": 250000}' and texts["p.html"] == "<p>[PRIVATE_IPV4]</p>"
    assert texts["z.zip"] == "" and texts["noext"] == "[EMAIL:example.com]"
    rows = {r.detector: r for r in spark.read.parquet(metrics).collect()}
    assert rows["emails"].n == 4 and rows["emails"].docs == 4 and rows["ips"].n == 2 and rows["money"].n == 0
    assert rows["emails"].run_id == "r1" and rows["emails"].seconds > 0 and len(rows) == 12
    with pytest.raises(Exception):
        redact_files(spark, str(folder / "in"), target, redactor=PLAIN)


def test_run_metrics_schema(spark, tmp_path):
    done = redact(spark.createDataFrame([(1, "a@example.com")], "doc_id INT, text STRING"), redactor=PLAIN)
    m = run_metrics(done, "r", "j")
    expected = [part.split() for part in RUN_METRICS.split(", ")]
    assert [(f.name, f.dataType.simpleString().upper()) for f in m.schema] == [
        (name, kind) for name, kind in expected]
    append_run_metrics(m, str(tmp_path / "m"))
    append_run_metrics(run_metrics(done, "r2", "j", F.lit(1.5)), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("detector = 'emails'").count() == 2


def test_containers_are_listed_unread(spark, folder):
    """The names decide: the content of containers is not asked for."""
    plan = read_documents(spark, str(folder / "in")).select("path", "format", "text")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert len(scans) == 2 and sum("content" in line.split("ReadSchema")[1] for line in scans) == 1


def test_one_row_group_is_dealt_out(spark, tmp_path):
    spark.range(1000).selectExpr("id", "IF(id % 2 = 0, 'same', NULL) AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    dealt = dealt_out(one)
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 8 and min(sizes) > 60 and sorted(dealt.collect()) == sorted(one.collect())


@pytest.mark.parametrize("name", ["redact_nested_keys", "redact_table", "redact_nested", "redact_variant", "audit_columns", "redact_keywords", "redact_notes",
                                  "recognize_dictionary", "redact_many_keywords"])
def test_jobs_that_take_longer_than_reading_deal_out_rows(spark, name):
    plan = JOBS[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan
