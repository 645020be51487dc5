"""From raw documents to packed sequences: the stages, in order, each over all that its predecessor kept.

``run`` writes what a stage returns to the shared folder and reads it again as the
documents of the next. All but the last return the columns of ``documents``.
SQL cannot express the stages (a trained classifier, byte pair encoding), so there is
no ``ORACLE_SQL``; ``tests/llm`` holds them against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubline.llm import packing
from scrubline.llm.common import fresh, own_columns, stored, table
from scrubline.llm.line_chunks import dedup_lines
from scrubline.llm.repeats import without_repeats
from scrubline.llm.simhash import near_duplicates
from scrubline.llm.toxicity import fit, score

#: Texts scored at or above this go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier, learnt from the labels, does not call toxic."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    (name,) = fresh(docs, "_toxic")
    return score(docs, model, score_col=name).where(F.col(name) < TOXIC).drop(name)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks of lines that stand elsewhere too; the first occurrence stays."""
    return _counted(dedup_lines(docs, counts=()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; rows without an id stay. Where rows share
    that id, the one whose text has the smallest hash."""
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    (n,) = fresh(docs, "_n")
    mine = docs.join(kept, "doc_id").withColumn(n, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")))
    return mine.where(F.col(n) == 1).select(*own_columns(docs)).unionByName(docs.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes or more that stand elsewhere too."""
    return _counted(without_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the documents fill."""
    return packing.pack(docs, packing.settings())


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("toxicity", drop_toxic), ("line dedup", cut_lines), ("simhash near-dedup", drop_near_duplicates),
          ("suffix-array dedup", cut_repeats), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs)
    return docs
