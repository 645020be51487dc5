"""Runs over a corpus that has changed little since the last one: only what is new is redacted."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.operators.findings import as_list
from scrubline.operators.redact import Redactor, redact_column


def rule_version(redactor: Redactor) -> str:
    """A name for the rules and their order: results of other rules are not taken over."""
    rules = "\n".join(f"{r.detector} {r.no} {r.pattern} {r.constant} {r.label} {r.group}" for r in redactor.rules)
    return hashlib.sha256(f"{redactor.profile}\n{rules}".encode()).hexdigest()[:16]


def _hash(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _named_version(redactor: Redactor) -> Column:
    return F.lit(rule_version(redactor)).alias("version")


def first_run(docs: DataFrame, id_col: str | Sequence[str] = "doc_id", text_col: str = "text", redactor: Redactor | None = None) -> DataFrame:
    """ids, ``text`` (redacted), ``n``, ``hash`` of the text as it was, ``version`` of the rules: what the next run starts from."""
    r, ids = redactor or Redactor(), as_list(id_col)
    hashed = docs.select(*ids, F.col(text_col).alias("text"), _hash(text_col).alias("hash"))
    return redact_column(hashed, "text", r).select(*ids, "text", "n", "hash", _named_version(r))


def changes(docs: DataFrame, last: DataFrame, id_col: str | Sequence[str] = "doc_id", text_col: str = "text",
            redactor: Redactor | None = None) -> DataFrame:
    """The rows of the new result that the last one lacks: documents that are new or changed, or all after a change of rules.

    Of the last result only ids, hashes and versions are read; the rules run over these
    documents alone. Of the texts that are new each is redacted once, however many
    documents have it.
    """
    r, ids = redactor or Redactor(), as_list(id_col)
    hashed = docs.select(*ids, F.col(text_col).alias("text"), _hash(text_col).alias("hash"))
    known = last.where(F.col("version") == rule_version(r)).select(*ids, "hash")
    new = hashed.join(known, [*ids, "hash"], "left_anti")
    texts = redact_column(new.groupBy("hash").agg(F.first("text").alias("text")), "text", r)
    return new.drop("text").join(texts, "hash").select(*ids, "text", "n", "hash", _named_version(r))


def merged(docs: DataFrame, last: DataFrame, changed: DataFrame, id_col: str | Sequence[str] = "doc_id", text_col: str = "text",
           redactor: Redactor | None = None) -> DataFrame:
    """The whole new result, as ``first_run`` over ``docs`` would give it: what has stayed the same from the last one, the
    rest from ``changes``. Documents that are gone are gone."""
    r, ids = redactor or Redactor(), as_list(id_col)
    still = docs.select(*ids, _hash(text_col).alias("hash"))
    kept = last.where(F.col("version") == rule_version(r)).join(still, [*ids, "hash"], "left_semi")
    return kept.select(*changed.columns).unionByName(changed)
