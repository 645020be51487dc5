"""Findings: where what was found, and texts redacted by such a table."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.functions.labels import COUNTED_ENTITIES, ENTITY_LABELS
from scrubline.functions.passes import digit_runs, digits, matches
from scrubline.functions.recognizers import RECOGNIZERS, Recognizer as Scored, scored
from scrubline.functions.segments import segments
from scrubline.functions.text import chunks, let, piece, running_max, running_total
from scrubline.operators.redact import Redactor

SPANS = "array<struct<start:int,end:int,entity_type:string,score:double>>"


def findings(df: DataFrame, id_cols: Sequence[str] = ("doc_id",), text_col: str = "text",
             redactor: Redactor | None = None) -> DataFrame:
    """One row per match, every rule searching the text as it is.

    Columns: the ids, ``detector``, ``rule_no``, ``ord`` (number of the match of
    this rule in the text), ``start`` and ``end`` (0-based code points, end
    exclusive), ``match``, ``value`` (what decides the label), ``label``, ``score``.
    No shuffle: the matches of a text are exploded where the text is read. Where it
    makes no difference the text is cut into segments first, as in ``Redactor.run_one``.
    """
    r = redactor or Redactor()
    if not r.rules:
        raise ValueError("no rules chosen")
    texts = df.select(*id_cols, F.col(text_col).alias("_text")).withColumn("_parts", F.expr(segments("_text") if r.cuts else "array(_text)"))
    begins = running_total("transform(_parts, p -> length(p) + 1)")
    part = let("runs", digit_runs("p"), f"named_struct('t', p, 'at', at, 'd', {digits('runs')}, 'r', runs)")
    texts = texts.select(*id_cols, F.expr(f"zip_with(_parts, {begins}, (p, at) -> {part})").alias("_parts"))
    per_rule = ", ".join(matches("_parts", rule) for rule in r.rules)
    return (texts.select(*id_cols, F.explode(F.expr(f"flatten(array_compact(array({per_rule})))")).alias("f"))
            .select(*id_cols, "f.*", F.lit(1.0).alias("score")))


def with_luhn(found: DataFrame, value_col: str = "value") -> DataFrame:
    """Add ``luhn_valid``: whether the digits of the value pass the Luhn checksum."""
    digits = F.expr(f"transform(split(reverse(regexp_replace({value_col}, '[^0-9]', '')), ''), d -> try_cast(d AS INT))")
    checksum = F.expr("aggregate(transform(_digits, (d, i) -> CASE WHEN i % 2 = 0 THEN d WHEN d > 4 THEN 2 * d - 9 "
                      "ELSE 2 * d END), 0, (acc, d) -> acc + coalesce(d, 0))")
    return (found.withColumn("_digits", digits)
            .withColumn("luhn_valid", (F.size("_digits") > 1) & (checksum % 10 == 0)).drop("_digits"))


def scored_findings(df: DataFrame, id_cols: Sequence[str] = ("doc_id",), text_col: str = "text",
                    recognizers: Sequence[Scored] = RECOGNIZERS, threshold: float = 0.4) -> DataFrame:
    """Findings of recognizers with checksums and context words, those with a score of ``threshold`` or more.

    Columns: the ids, ``entity_type``, ``recognizer_no``, ``start``, ``end``, ``match``,
    ``score``: what ``apply_findings`` and ``resolve_overlaps`` take, which give way to
    the higher score. No shuffle.
    """
    texts = df.select(*id_cols, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    each = ", ".join(scored("_text", r) for r in recognizers)
    return (texts.select(*id_cols, F.explode(F.expr(f"flatten(array_compact(array({each})))")).alias("f"))
            .select(*id_cols, "f.*").where(F.col("score") >= threshold))


def label_of(entity_type: Column, label_map: Mapping[str, str] | None = None) -> Column:
    """The label of an entity type; types the map does not know become ``<TYPE>``."""
    label_map = ENTITY_LABELS if label_map is None else label_map
    unknown = F.concat(F.lit("<"), entity_type, F.lit(">"))
    if not label_map:
        return unknown
    known = F.create_map(*(F.lit(x) for pair in label_map.items() for x in pair))
    return F.coalesce(F.try_element_at(known, entity_type), unknown)


# Greedy choice within a set of spans sorted by rank: take each unless it overlaps one taken before.
_TAKE = ("aggregate({spans}, slice({spans}, 1, 0), (taken, s) -> CASE WHEN "
         "exists(taken, t -> s.start < t.end AND t.start < s.end) THEN taken ELSE concat(taken, array(s)) END)")
_BEFORE = "coalesce(get(_spans, i - 1).end, 0)"
_LAST = "coalesce(get(_spans, size(_spans) - 1).end, 0)"
# The text with every span of a sorted array, none overlapping, replaced by its label.
_WRITE = (f"concat_ws('', concat(transform(_spans, (s, i) -> concat({piece('_chunks', _BEFORE, 's.start')}, s.label)), "
          f"array({piece('_chunks', _LAST, 'length(_text)')})))")


def resolved(spans: str) -> str:
    """SQL: the spans that are applied of an array of ``(start, end, rank, label)``, in the order of the text: of those that
    overlap, directly or through others, the lower rank, then the longer, then the earlier; of copies the label that sorts first.

    What begins at or behind the greatest ``end`` before it begins a new run; the choice is made within each run.
    """
    one = "named_struct('start', s.start, 'end', s.end, 'label', s.label)"
    ranked = "sort_array(transform(run, s -> named_struct('rank', s.rank, 'shortness', s.start - s.end, 'start', s.start, 'end', s.end, 'label', s.label)))"
    taken = f"sort_array(transform({let('run', ranked, _TAKE.format(spans='run'))}, s -> {one}))"
    runs = "transform(firsts, (at, k) -> slice(best, at + 1, coalesce(get(firsts, k + 1), size(best)) - at))"
    body = f"flatten(transform({runs}, run -> IF(size(run) = 1, transform(run, s -> {one}), {taken})))"
    for name, value in (("firsts", "filter(transform(best, (s, k) -> IF(s.start >= coalesce(ends[k], 0), k, -1)), k -> k >= 0)"),
                        ("ends", running_max("transform(best, s -> s.end)")),
                        ("best", "filter(spans, (s, k) -> k = 0 OR spans[k - 1].start <> s.start OR spans[k - 1].end <> s.end)"),
                        ("spans", f"sort_array({spans})")):
        body = let(name, value, body)
    return body


def written(df: DataFrame, columns: Sequence[str], text_col: str) -> DataFrame:
    """``columns`` of ``df`` with the spans of the column ``_spans`` replaced in the texts, and their number ``n``."""
    done = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    done = done.withColumn("_chunks", F.when(F.col("_spans").isNotNull(), F.expr(chunks("_text"))))
    return done.select(
        *(F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(F.expr(_WRITE)).alias(text_col)
          if c == text_col else F.col(c) for c in columns),
        F.coalesce(F.size("_spans"), F.lit(0)).alias("n"))


def as_list(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def resolve_overlaps(found: DataFrame, id_col: str | Sequence[str] = "doc_id") -> DataFrame:
    """The findings that are applied: of overlapping ones the higher score, then the longer, then the earlier.

    Only findings that overlap directly or through others compete. Copies are merged
    first, so what is then gathered, by ``id_col`` (one column or several), is what one
    text can have; its runs are found with a running maximum of ``end``. Findings that
    are dealt out by these columns already are not shuffled.
    """
    ids = as_list(id_col)
    return (_resolved(found, ids).select(*ids, F.explode("_spans").alias("s"))
            .select(*ids, "s.start", "s.end", "s.label"))


def _resolved(found: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Of each text the spans that are applied, ``_spans``, in the order of the text."""
    spans = (found.select(*ids, "start", "end", (-F.col("score")).alias("rank"), "label").distinct()
             .groupBy(*ids).agg(F.collect_list(F.struct("start", "end", "rank", "label")).alias("_found")))
    return spans.select(*ids, F.explode(F.array(F.expr(resolved("_found")))).alias("_spans"))


def apply_findings(docs: DataFrame, found: DataFrame, id_col: str | Sequence[str] = "doc_id", text_col: str = "text",
                   label_map: Mapping[str, str] | None = None) -> DataFrame:
    """Replace the findings in the texts they were made in, and add ``n``.

    ``found`` needs the id, ``start``, ``end``, ``score`` and a ``label`` or an
    ``entity_type``. The findings of a document are bounded by its own length and
    travel to it; whether they are broadcast is left to their measured size. ``id_col``,
    one column or several, must tell the texts apart.
    """
    ids = as_list(id_col)
    if "label" not in found.columns:
        found = found.withColumn("label", label_of(F.col("entity_type"), label_map))
    spans = _resolved(found, ids)
    return written(docs.join(spans, ids, "left"), docs.columns, text_col)


def unite(**found: DataFrame) -> DataFrame:
    """Entities of several recognizers in one table, each with the name of its ``recognizer``."""
    named = [df.withColumn("recognizer", F.lit(name)) for name, df in found.items()]
    out = named[0]
    for other in named[1:]:
        out = out.unionByName(other)
    return out


def without_allowed(found: DataFrame, allowed: DataFrame, value_col: str = "match") -> DataFrame:
    """Findings whose value is not on an allow list (a column ``value``, compared in lower case).

    The list is joined by its measured size; a value that makes up much of the
    findings is one row on its side, so that a skewed partition can be split.
    """
    listed = allowed.select(F.lower("value").alias("_allowed")).distinct()
    return found.join(listed, F.lower(value_col) == F.col("_allowed"), "left_anti")


def entity_stats(found: DataFrame) -> DataFrame:
    """Findings per entity type over the fixed list of types, zeros included."""
    n = found.where(F.col("entity_type").isin(*COUNTED_ENTITIES)).groupBy("entity_type").agg(F.count("*").alias("n"))
    types = found.sparkSession.range(1).select(
        F.explode(F.array(*(F.lit(t) for t in COUNTED_ENTITIES))).alias("entity_type"))
    # both sides hold at most one row per listed type
    return types.join(F.broadcast(n), "entity_type", "left").select(
        "entity_type", F.coalesce("n", F.lit(0)).alias("n"))


Recognizer = Callable[[str], Sequence[tuple[int, int, str, float]]]


def _vectorized(load: Callable[[], Recognizer], of: Callable[[str, list], object], returns: str):
    """A vectorized function of texts: ``of`` a text and what is found in it.

    The recognizer is loaded once per worker task, not per text.
    """
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        recognizer = load()
        for texts in batches:
            results = [of(text, list(recognizer(text)) if text else []) for text in texts]
            yield pd.DataFrame(results) if returns.startswith("text") else pd.Series(results, dtype=object)

    result = pd.DataFrame if returns.startswith("text") else pd.Series
    column.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[result]}
    return F.pandas_udf(column, returns)


def _spans(text: str, found: list) -> list[dict]:
    return [{"start": int(start), "end": int(end), "entity_type": kind, "score": float(score)}
            for start, end, kind, score in found]


def _written(label_map: Mapping[str, str]) -> Callable[[str, list], dict]:
    """The text with the findings replaced: higher score first, then longer, then earlier."""
    def write(text: str, found: list) -> dict:
        taken: list[tuple[int, int, str]] = []  # sorted by start, none overlapping
        for start, end, kind, _ in sorted(found, key=lambda s: (-s[3], s[0] - s[1], s[0])):
            at = bisect_left(taken, (start,))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (start, end, label_map.get(kind, f"<{kind}>")))
        parts, last = [], 0
        for start, end, label in taken:
            parts += (text[last:start], label)
            last = end
        return {"text": "".join((*parts, text[last:])), "n": len(taken)}

    return write


def recognize(df: DataFrame, load: Callable[[], Recognizer], id_cols: Sequence[str] = ("doc_id",),
              text_col: str = "text") -> DataFrame:
    """Findings of a user's own recognizer, for instance a language model.

    ``load`` returns a function from a text to ``(start, end, entity_type, score)``
    tuples. Only ids and texts travel to Python, in Arrow batches.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the generator keeps a filter on the findings from being pushed below, where the recognizer would run twice
    return (df.select(*id_cols, text.alias("_text"))
            .withColumn("_spans", F.explode(F.array(_vectorized(load, _spans, SPANS)(F.col("_text")))))
            .select(*id_cols, "_text", F.explode("_spans").alias("s"))
            .select(*id_cols, "s.entity_type", "s.start", "s.end",
                    F.col("_text").substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("match"),
                    "s.score"))


def redact_entities(df: DataFrame, load: Callable[[], Recognizer], text_col: str = "text",
                    label_map: Mapping[str, str] | None = None) -> DataFrame:
    """Redact what a recognizer finds, within the row: no shuffle and no join. Adds ``n``."""
    write = _vectorized(load, _written(ENTITY_LABELS if label_map is None else dict(label_map)), "text string, n int")
    done = df.withColumn("_done", write(F.coalesce(F.col(text_col), F.lit(""))))
    return done.select(*(F.col("_done.text").alias(c) if c == text_col else F.col(c) for c in df.columns),
                       F.col("_done.n").alias("n"))
