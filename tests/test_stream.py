import datetime as dt
import random

from pyspark.sql import functions as F

from scrubline.operators.redact import Redactor, redact_column
from scrubline.streaming.redact_stream import (
    first_findings, join_events, join_texts, read_stream, redact_stream, windowed_counts, write_stream, write_with_late)

PLAIN = Redactor(detectors=("emails", "ips"))
SCHEMA = "ts TIMESTAMP, text STRING"


def rows(n):
    start = dt.datetime(2024, 1, 1)
    return [(start + dt.timedelta(minutes=7 * i), f"x{i}@example.com 10.0.0.{i}" if i % 2 else "nothing") for i in range(n)]


def write(spark, path, part):
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_redacted_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, rows(20))
    write(spark, source, rows(40)[20:])
    stream = redact_stream(read_stream(spark, source, SCHEMA, max_files_per_trigger=1), redactor=PLAIN)
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = redact_column(spark.read.parquet(source), "text", PLAIN)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())
    # a restart goes on where the last run ended
    write(spark, source, rows(45)[40:])
    stream = redact_stream(read_stream(spark, source, SCHEMA), redactor=PLAIN)
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 45


def test_windows_equal_batch_and_drop_late_events(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def run():
        counts = windowed_counts(read_stream(spark, source, SCHEMA), "ts", "text", "1 hour", "10 minutes", PLAIN)
        write_stream(counts, out, cp).awaitTermination()
        return spark.read.parquet(out)

    write(spark, source, rows(60))
    first = run()
    expected = windowed_counts(spark.createDataFrame(rows(60), SCHEMA), "ts", "text", "1 hour", redactor=PLAIN)
    closed = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * 59 - 10)
    done = expected.where(F.col("window_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(closed))
    assert sorted(first.collect()) == sorted(done.collect()) and first.count() == 12
    # an event of a closed window comes too late; a new one moves the watermark on
    write(spark, source, [(dt.datetime(2024, 1, 1), "late@example.com"), (dt.datetime(2024, 1, 2), "new@example.com")])
    second = run()
    assert sorted(second.where("window_start < '2024-01-01 06:00'").collect()) == sorted(done.collect())
    assert second.where("window_start = '2024-01-01 06:00'").count() == 2


def arrivals(spark, folder, rows, schema, seed, parts=4):
    """Rows in several files, in an order of arrival of their own; yields after each."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(folder)
        yield


def test_events_meet_their_texts_in_a_table(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"u{i}@example.com") for i in range(5)], "k LONG, text STRING")
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for _ in arrivals(spark, source, [(i % 7, i) for i in range(40)], "k LONG, e LONG", 1):
        stream = join_texts(read_stream(spark, source, "k LONG, e LONG"), texts, "k", redactor=PLAIN)
        write_stream(stream, out, cp).awaitTermination()
    batch = join_texts(spark.read.parquet(source), texts, "k", redactor=PLAIN)
    assert sorted(spark.read.parquet(out).select("k", "e", "text", "n").collect()) == sorted(batch.select("k", "e", "text", "n").collect())


def test_two_streams_in_any_order_equal_the_batch_join(spark, tmp_path):
    start, schema = dt.datetime(2024, 1, 1), "user LONG, ts TIMESTAMP, id LONG, kind STRING"
    rows = [(i % 5, start + dt.timedelta(minutes=9 * i % 600), i, "ab"[i % 2]) for i in range(120)]

    def joined(df):
        a = df.where("kind = 'a'").selectExpr("user", "ts AS seen", "id AS a")
        b = df.where("kind = 'b'").selectExpr("user", "ts AS bought", "id AS b")
        return join_events(a, b, ["user"], "seen", "bought", "1 HOUR", "12 hours").select("user", "a", "b")

    want = sorted(joined(spark.createDataFrame(rows, schema)).collect())
    assert want
    for seed in (1, 2):
        source, out, cp = (str(tmp_path / f"{x}{seed}") for x in ("in", "out", "cp"))
        for _ in arrivals(spark, source, rows, schema, seed):
            query = write_stream(joined(read_stream(spark, source, schema)), out, cp)
            query.awaitTermination()
        assert sorted(spark.read.parquet(out).collect()) == want


def test_a_value_is_found_once_and_the_state_expires(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=i), i, f"mail u{i % 6}@example.com") for i in range(60)]
    want = sorted(first_findings(spark.createDataFrame(rows, "ts TIMESTAMP, id LONG, text STRING"), "ts", ["id"], redactor=PLAIN).select("match").collect())
    for seed in (1, 2):
        source, out, cp = (str(tmp_path / f"{x}{seed}") for x in ("in", "out", "cp"))
        for _ in arrivals(spark, source, rows, "ts TIMESTAMP, id LONG, text STRING", seed):
            found = first_findings(read_stream(spark, source, "ts TIMESTAMP, id LONG, text STRING"), "ts", ["id"], watermark="2 hours", redactor=PLAIN)
            write_stream(found, out, cp).awaitTermination()
        assert sorted(spark.read.parquet(out).select("match").collect()) == want
    # two days later nothing of it is remembered but what is new
    later = [(start + dt.timedelta(days=2 + i // 2, minutes=i % 2), 100 + i, f"mail {'u1' if i % 2 else f'other{i}'}@example.com") for i in range(6)]
    for row in later:
        spark.createDataFrame([row], "ts TIMESTAMP, id LONG, text STRING").coalesce(1).write.mode("append").parquet(source)
        query = write_stream(first_findings(read_stream(spark, source, "ts TIMESTAMP, id LONG, text STRING"), "ts", ["id"], watermark="2 hours", redactor=PLAIN), out, cp)
        query.awaitTermination()
    assert spark.read.parquet(out).where("match = 'u1@example.com'").count() == 4
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_late_rows_have_a_table_of_their_own(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    source, on_time, late, marks, cp = (str(tmp_path / x) for x in ("in", "out", "late", "marks", "cp"))
    latest, want = None, set()
    for minutes in ((0, 5, 9), (200, 3), (100, 150, 141), (500,), (499, 440, 439)):
        spark.createDataFrame([(start + dt.timedelta(minutes=m), f"m{m}@example.com") for m in minutes], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        want |= {m for m in minutes if latest is not None and m < latest - 60}
        latest = max((latest or 0), *minutes)
        write_with_late(redact_stream(read_stream(spark, source, SCHEMA), redactor=PLAIN), "ts", "1 HOUR", on_time, late, marks, cp).awaitTermination()
    got = {int((r.ts - start).total_seconds() // 60) for r in spark.read.parquet(late).collect()}
    assert got == want == {100, 439} and spark.read.parquet(on_time).count() + len(got) == 12
