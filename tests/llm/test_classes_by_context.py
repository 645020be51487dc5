from dataclasses import replace

from pyspark.sql import functions as F

from scrubline.llm import lm_scoring
from tests.conftest import DATA


def test_no_class_by_context_is_left_out(spark):
    """with 16 classes, as cut once, held-out texts are less likely than with the 24 the model began with."""
    docs = spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")

    def held_out(s):
        return lm_scoring.score_texts(docs, s=s).where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]

    whole = lm_scoring.Settings()
    assert whole.groups == 24 and held_out(whole) > held_out(replace(whole, groups=16)) + 0.003
