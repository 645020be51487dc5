"""From files to redacted files: read, apply the methods, write, and record what was done."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.operators.chain import method_chain
from scrubline.operators.findings import Recognizer
from scrubline.operators.redact import Redactor, redact
from scrubline.sources.files import append_run_metrics, read_documents, run_metrics


def redact_files(spark: SparkSession, source: str, target: str, methods: str | Sequence[str] = "regex",
                 redactor: Redactor | None = None, dictionary: DataFrame | None = None,
                 recognizer: Callable[[], Recognizer] | None = None, metrics: str | None = None,
                 run_id: str = "run") -> DataFrame:
    """Redact all files under ``source`` into a table at ``target`` (parquet, by format).

    When ``regex`` is the only method the table also holds the counts of each
    file, and their sums are appended to the table at ``metrics``, computed from
    what was written. Returns the written table.
    """
    docs = read_documents(spark, source)
    names = [m.lower() for m in ([methods] if isinstance(methods, str) else methods)]
    begin = time.time()
    if names == ["regex"]:
        done = redact(docs, "text", redactor)
    else:
        done = method_chain(docs, names, "text", "path", redactor, dictionary, recognizer)
    done.write.mode("errorifexists").partitionBy("format").parquet(target)
    written = spark.read.parquet(target)
    if metrics and "counts" in written.columns:
        append_run_metrics(run_metrics(written, run_id, "redact_files", F.lit(time.time() - begin)), metrics)
    return written
