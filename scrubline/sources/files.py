"""Corpora in files: whole documents of any text format, lines, tables; sinks and run metrics."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scrubline.functions.rules import DETECTORS
from scrubline.operators.audit import extension_of

# Which format an extension stands for.
FORMATS = {
    "text": (".txt", ".log", ".md", ".rst"),
    "csv": (".csv",),
    "tsv": (".tsv",),
    "excel": (".xls", ".xlsx", ".xlsm", ".xlsb", ".odf", ".ods", ".odt"),
    "word": (".doc", ".docx"),
    "pdf": (".pdf",),
    "json": (".json", ".json5"),
    "xml": (".xml", ".html", ".htm"),
    "binary": (".zip", ".rar", ".tar", ".gz", ".7z", ".exe", ".bin", ".dat"),
}
# Formats whose bytes are the text. The others are containers: listed, but without a text.
TEXT_FORMATS = ("text", "csv", "tsv", "json", "xml")
MIME_TYPES = {
    ".txt": "text/plain", ".log": "text/plain", ".md": "text/markdown", ".rst": "text/x-rst",
    ".csv": "text/csv", ".tsv": "text/tab-separated-values", ".json": "application/json",
    ".xml": "text/xml", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf",
    ".zip": "application/zip", ".gz": "application/gzip",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
DELIMITERS = {"csv": ",", "tsv": "\t"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def read_documents(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Whole files as documents: ``path, size, extension, mime_type, format, encoding, text, lines, rows, columns``.

    ``rows`` and ``columns`` (of the first row) are those of csv and tsv files.

    Bytes that are not valid UTF-8 are read as ISO-8859-1 and flagged; a file of
    unknown extension is text if it is valid UTF-8 and ``unsupported`` otherwise.
    Containers and archives have a row but no text; their bytes are not read. Files
    of length 0 have no row. A value holds 2 GB at most: a larger text file fails the
    job (raise its split with ``read_lines`` instead).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path if isinstance(path, str) else list(path))
    by_extension = {ext: name for name, extensions in FORMATS.items() for ext in extensions}
    # the name decides before anything is read: Spark skips the other files, and the content where it is not asked for
    containers = [ext for ext, name in by_extension.items() if name not in TEXT_FORMATS]
    is_container = extension_of(F.col("_metadata.file_name")).isin(*containers)
    columns = ("path", F.col("length").alias("size"), extension_of(F.col("path")).alias("extension"))
    read = files.where(~is_container).select(*columns, "content")
    listed = files.where(is_container).select(*columns).withColumn("content", F.lit(None).cast("binary"))
    known = read.withColumn("_utf8", F.is_valid_utf8(F.col("content").cast("string"))).unionByName(
        listed.withColumn("_utf8", F.lit(False))).withColumn("format", _lookup(F.col("extension"), by_extension))
    known = known.withColumn("format", F.coalesce("format", F.when(F.col("_utf8"), "text").otherwise("unsupported")))
    has_text = F.col("format").isin(*TEXT_FORMATS)
    encoding = F.when(F.col("_utf8"), "UTF-8").otherwise("ISO-8859-1")
    text = F.when(F.col("_utf8"), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    done = known.select(
        "path", "size", "extension", _lookup(F.col("extension"), MIME_TYPES).alias("mime_type"), "format",
        F.when(has_text, encoding).alias("encoding"), F.when(has_text, text).otherwise("").alias("text"))
    lines = F.when(F.col("format").isin(*TEXT_FORMATS), F.regexp_count("text", F.lit("\n")) + 1)
    # records end at line ends outside quotes; what stands in quotes is of no account here
    records = F.split(F.regexp_replace("text", '"[^"]*"', '""'), "\r\n|\r|\n", -1)
    delimited = F.col("format").isin(*DELIMITERS)
    done = done.withColumn("lines", lines).withColumn("_records", F.when(delimited, records))
    ends = F.when(F.element_at("_records", -1) == "", 1).otherwise(0)
    first = F.element_at("_records", 1)
    columns = F.when(first == "", 0).otherwise(
        F.length(first) - F.length(F.replace(first, _lookup(F.col("format"), DELIMITERS))) + 1)
    return (done.withColumn("rows", F.size("_records") - ends).withColumn("columns", F.when(delimited, columns))
            .withColumn("rows", F.when(delimited, F.col("rows"))).drop("_records"))


def dealt_out(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a table in as many tasks as a shuffle has, or eight for each split of its files, if these are more.

    A file written as one row group is read by one task, whatever its splits. For work that
    takes far longer than reading, the rows are dealt out first, by turns, so that neither the
    layout of the files nor the values in the rows decide which task has how many. With
    ``keys`` they are dealt out by these, so that what is made of a row stays with it: neither
    a grouping by the keys nor a join by them needs another shuffle.
    """
    return df.repartition(tasks(df), *keys)


def tasks(df: DataFrame) -> int:
    """In how many tasks the rows of a table are dealt out."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * df.rdd.getNumPartitions())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Large text files line by line: files are split, so no task holds a whole one."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_table(spark: SparkSession, path: str, fmt: str, schema: str | None = None, row_tag: str | None = None) -> DataFrame:
    """A table for column-wise or nested redaction: csv, tsv, json, json5, jsonl, xml, parquet or orc."""
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt in DELIMITERS:
        df = reader.csv(path, sep=DELIMITERS[fmt], header=True, multiLine=True, quote='"', escape='"')
    elif fmt in ("json", "json5"):
        df = reader.options(multiLine=True, allowComments=True, allowUnquotedFieldNames=True,
                            allowSingleQuotes=True).json(path)
    elif fmt == "jsonl":
        df = reader.json(path)
    elif fmt == "xml":
        if row_tag is None:
            raise ValueError("xml needs the row_tag of its records")
        df = reader.format("xml").option("rowTag", row_tag).load(path)
    elif fmt in ("parquet", "orc"):
        df = reader.format(fmt).load(path)
    else:
        raise ValueError(f"unknown table format {fmt!r}")
    return df


def write_table(df: DataFrame, path: str, fmt: str, partition_by: Sequence[str] = (), mode: str = "errorifexists",
                row_tag: str = "row", root_tag: str = "rows") -> None:
    """Redacted tables and texts: parquet, orc, csv, tsv, json, xml or text."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if fmt in DELIMITERS:
        writer.csv(path, sep=DELIMITERS[fmt], header=True, quote='"', escape='"')
    elif fmt in ("json", "jsonl"):
        writer.json(path)
    elif fmt == "xml":
        writer.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)
    elif fmt == "text":
        writer.text(path)
    elif fmt in ("parquet", "orc"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unknown table format {fmt!r}: a redacted pdf or binary cannot be written")


def write_bucketed(df: DataFrame, table: str, buckets: int, id_col: str = "doc_id") -> None:
    """A corpus laid out by document id.

    Findings made from such a table stay in their bucket, so resolving their
    overlaps and bringing them back to the texts needs no shuffle at all. Choose
    the number of buckets so that one is a few hundred megabytes.
    """
    df.write.bucketBy(buckets, id_col).sortBy(id_col).saveAsTable(table)


RUN_METRICS = "run_id STRING, job STRING, detector STRING, n BIGINT, docs BIGINT, chars BIGINT, seconds DOUBLE"


def run_metrics(redacted: DataFrame, run_id: str, job: str, seconds: Column | None = None) -> DataFrame:
    """Metrics of a run, one row per detector, from the output of ``redact``.

    ``n`` replacements, ``docs`` documents with at least one, ``chars`` characters
    read. Derive them from the written output rather than from the plan, so that
    the rules do not run twice.
    """
    per_doc = redacted.select(F.col("len_before").cast("bigint").alias("chars"), F.explode("counts").alias("detector", "n"))
    return per_doc.groupBy("detector").agg(
        F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("docs"), F.sum("chars").alias("chars")).select(
        F.lit(run_id).alias("run_id"), F.lit(job).alias("job"), "detector", "n", "docs", "chars",
        (seconds if seconds is not None else F.lit(None)).cast("double").alias("seconds"))


def write_observed(redacted: DataFrame, path: str, run_id: str, job: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write the output of ``redact`` and return its metrics, taken while it was written: one scan gives both.

    The rows are those of ``run_metrics``, with the seconds that the write took. The sums
    are made in the tasks that write; a dozen numbers come to the driver.
    """
    own, n = Observation(), [F.try_element_at("counts", F.lit(d)) for d in DETECTORS]
    observed = redacted.observe(own, F.sum(F.col("len_before").cast("bigint")).alias("chars"), *(F.sum(x).alias(f"n{i}") for i, x in enumerate(n)),
                                *(F.count_if(x > 0).alias(f"d{i}") for i, x in enumerate(n)))
    begin = time.time()
    writer = observed.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    seconds, got = time.time() - begin, own.get
    rows = [(run_id, job, d, got[f"n{i}"] or 0, got[f"d{i}"], got["chars"] or 0, seconds) for i, d in enumerate(DETECTORS)]
    return redacted.sparkSession.createDataFrame(rows, RUN_METRICS)


def append_run_metrics(metrics: DataFrame, path: str) -> None:
    """Append to the metrics table, one partition per job."""
    metrics.write.mode("append").partitionBy("job").parquet(path)
