"""Times of the headline jobs, as one JSON line.

BENCH_SF_DIR: data folder (default sf0.1); BENCH_CPUS: cores (default all). The tables
there are one file with one row group each, which Spark cannot split; they are first
laid out as one file per core, as a corpus would be. The session is warmed up with one
job over the smallest table. Every job runs over the whole tables and its full result
is computed (and thrown away). ``queries`` are the times with building and planning,
``build`` the part before the job starts. ``chars_per_sec`` is the rate of the flagship
job over the documents.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scrubline.plans.jobs import JOBS

HEADLINE = ("redact_document", "redact_document_ref", "redact_emails", "redact_api_keys", "redact_phones", "redact_money",
            "redact_dates", "redaction_stats", "findings_all", "apply_findings", "recognize_dictionary",
            "redact_dictionary", "redact_lines", "redact_markup", "redact_nested", "riskiest_documents", "distinct_values")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "events", "documents", "pages", "benchmark", "conversations")


def laid_out(spark: SparkSession, sf_dir: str, cores: int) -> str:
    folder = tempfile.mkdtemp(prefix="scrubline-bench-")
    for name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (df.repartition(cores) if name not in ("region", "nation") else df).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("scrubline-bench")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else cpus)
             .config("spark.sql.files.openCostInBytes", "0")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    folder = laid_out(spark, sf_dir, spark.sparkContext.defaultParallelism)
    chars = spark.read.parquet(f"{folder}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    JOBS["redact_table"](spark, folder).limit(1000).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    build: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.time()
        df = JOBS[name](spark, folder)
        df._jdf.queryExecution().executedPlan()
        build[name] = round(time.time() - begin, 3)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    result = {"metric": "headline jobs, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
              "sf": os.path.basename(sf_dir).removeprefix("sf"), "build": build}
    if "redact_document" in times:
        result["chars_per_sec"] = round(chars / times["redact_document"])
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
