"""The rules on streams: redaction is stateless, the counts are windowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.operators.findings import findings
from scrubline.operators.redact import Redactor, redact_column


def read_stream(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def redact_stream(stream: DataFrame, text_col: str = "text", redactor: Redactor | None = None) -> DataFrame:
    """The stream with ``text_col`` redacted and ``n`` added: a projection, no state.

    Also takes a batch DataFrame and then gives the same rows.
    """
    return redact_column(stream, text_col, redactor or Redactor())


def utc(ts_col: str) -> Column:
    """A timestamp without time zone as the instant it means in UTC, whatever the session's zone."""
    return F.expr(f"CAST(convert_timezone('UTC', current_timezone(), {ts_col}) AS TIMESTAMP)")


def windowed_counts(stream: DataFrame, ts_col: str, text_col: str, window: str = "1 hour",
                    watermark: str = "10 minutes", redactor: Redactor | None = None) -> DataFrame:
    """Replacements per detector and tumbling window of event time.

    One row per window and detector is the state; a window closes when the
    watermark passes its end, and events later than that are dropped. Within a
    task the counts are added up before they are shuffled.
    """
    r = redactor or Redactor()
    if stream.isStreaming:
        stream = stream.withWatermark(ts_col, watermark)
    done = r.run_one(stream.select(ts_col, text_col), F.col(text_col))
    pairs = F.arrays_zip(F.array(*(F.lit(d) for d in r.detectors)).alias("detector"), F.col("_done.c").alias("n"))
    rows = done.select(ts_col, F.explode(F.filter(pairs, lambda p: p["n"] > 0)).alias("p"))
    return (rows.groupBy(F.window(ts_col, window), F.col("p.detector").alias("detector"))
            .agg(F.sum("p.n").alias("n"), F.count("*").alias("events"))
            .select(F.col("window.start").alias("window_start"), "detector", "n", "events"))


def join_texts(stream: DataFrame, texts: DataFrame, on: str | list[str], text_col: str = "text", redactor: Redactor | None = None) -> DataFrame:
    """Events joined with the texts they are about, which lie in a table, and these redacted: no state.

    The table is read anew for each batch of events, and joined by its measured size.
    """
    return redact_column(stream.join(texts, on), text_col, redactor or Redactor())


def join_events(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, within: str, watermark: str) -> DataFrame:
    """Events of two streams that share ``on``, the right one at most ``within`` after the left one.

    The two time columns must have different names. Either side keeps an event until the
    watermark tells that nothing that could meet it is still to come, so the state is
    bounded by ``within`` and ``watermark``; what comes in whatever order within the
    watermark gives what a batch join gives.
    """
    one, two = left.alias("one"), right.alias("two")
    if left.isStreaming:
        one, two = left.withWatermark(left_ts, watermark).alias("one"), right.withWatermark(right_ts, watermark).alias("two")
    same = [F.col(f"one.{c}") == F.col(f"two.{c}") for c in on]
    near = [F.col(f"two.{right_ts}") >= F.col(f"one.{left_ts}"), F.col(f"two.{right_ts}") <= F.col(f"one.{left_ts}") + F.expr(f"INTERVAL {within}")]
    condition = same[0]
    for more in (*same[1:], *near):
        condition = condition & more
    return one.join(two, condition).select("one.*", *(F.col(f"two.{c}") for c in right.columns if c not in on))


def first_findings(stream: DataFrame, ts_col: str, id_cols: list[str], text_col: str = "text", keys: tuple[str, ...] = ("detector", "match"),
                   watermark: str = "1 hour", redactor: Redactor | None = None) -> DataFrame:
    """Findings, each of a set of ``keys`` once for as long as the watermark remembers it.

    The state is one row per set of keys, and expires when the watermark has passed the
    time of its event plus the delay. A copy that arrives within the delay is dropped,
    in whatever order the two come; ids and time are those of the one that came first.
    """
    found = findings(stream, (ts_col, *id_cols), text_col, redactor)
    if not stream.isStreaming:
        return found.dropDuplicates(list(keys))
    return found.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark(list(keys))


def write_with_late(stream: DataFrame, ts_col: str, delay: str, path: str, late_path: str, marks_path: str, checkpoint: str):
    """Start a query that writes rows in time to one table and late ones to another.

    A row is late if its time lies more than ``delay`` before the latest time of all
    earlier batches. That time is written for each batch, one row, so a restart knows
    it; a batch that is run again replaces what it wrote. Nothing is dropped, and no
    state is kept but these rows.
    """
    def split(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        marks = spark.createDataFrame([], "batch LONG, mark TIMESTAMP") if batch == 0 else spark.read.schema("batch LONG, mark TIMESTAMP").parquet(marks_path)
        mark = marks.where(F.col("batch") < batch).agg(F.max("mark")).first()[0]
        in_time = F.lit(True) if mark is None else F.col(ts_col) >= F.lit(mark) - F.expr(f"INTERVAL {delay}")
        told = rows.withColumn("_in_time", F.coalesce(in_time, F.lit(True))).persist()
        for wanted, folder in ((True, path), (False, late_path)):
            told.where(F.col("_in_time") == wanted).drop("_in_time").write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        told.agg(F.lit(batch).cast("long").alias("batch"), F.max(ts_col).alias("mark")).coalesce(1).write.mode("overwrite").parquet(f"{marks_path}/part={batch}")
        told.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet",
                 available_now: bool = True):
    """Start the query. The checkpoint folder must be on storage all executors share."""
    writer = stream.writeStream.outputMode(mode).format(fmt).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
