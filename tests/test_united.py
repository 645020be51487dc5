"""Findings of several recognizers are applied where the texts are: nothing made of a text leaves its task."""

from pyspark.sql import functions as F

from scrubline.operators.findings import recognize, resolve_overlaps
from scrubline.plans.jobs import JOBS, load_mail_recognizer
from tests.conftest import DATA


def test_united_findings_stay_where_their_texts_are(spark):
    """all findings went through three shuffles, and the texts through one for each recognizer."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = JOBS["united_findings"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above, _, below = plan.partition("Union")
    assert "Union" in plan and "Window" not in plan
    outer = above[above.index("ObjectHashAggregate"):]  # from the gathering of a text's findings down to their union
    assert "Exchange" not in outer and below.count("ArrowEvalPython") == 1


def test_a_recognizer_runs_once(spark, docs):
    """A filter on the findings was pushed below the shuffle of the texts, where the recognizer ran a second time."""
    plan = recognize(docs.repartition(3), load_mail_recognizer).where(F.col("match") > "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_overlaps_of_runs_and_copies(spark):
    rows = [(1, 0, 4, "a", 0.5), (1, 0, 4, "b", 0.9), (1, 3, 9, "c", 0.8), (1, 8, 12, "d", 0.7), (1, 12, 13, "e", 0.1), (1, 12, 13, "e", 0.1),
            (1, 0, 4, "A", 0.9), (None, 5, 6, "x", 1.0), (2, 0, 100, "long", 0.5), (2, 3, 5, "in", 0.5), (2, 90, 101, "end", 0.6), (2, 100, 102, "z", 0.5)]
    rows += [(3, k, k + 2, f"s{k}", 1.0) for k in range(0, 500)]
    found = spark.createDataFrame(rows, "doc_id BIGINT, start INT, end INT, label STRING, score DOUBLE")
    got = sorted((r.doc_id or 0, r.start, r.end, r.label) for r in resolve_overlaps(found).collect())
    assert got == sorted([(1, 0, 4, "A"), (1, 8, 12, "d"), (1, 12, 13, "e"), (0, 5, 6, "x"), (2, 3, 5, "in"), (2, 90, 101, "end")]
                         + [(3, k, k + 2, f"s{k}") for k in range(0, 500, 2)])
