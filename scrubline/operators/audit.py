"""Statistics, audits and profiles of corpora. Every aggregate is partial before it is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.operators.findings import as_list, findings
from scrubline.operators.redact import Redactor, redact


def redaction_stats(df: DataFrame, group_cols: Sequence[str] = ("lang", "source"), text_col: str = "text",
                    redactor: Redactor | None = None) -> DataFrame:
    """Replacements ``n`` and documents concerned ``docs`` per group and detector, zeros included.

    One row per group leaves each task, however large the group: a group that
    holds a third of the corpus costs no more to merge than any other.
    """
    r = redactor or Redactor()
    counts = F.col("_done.c")
    per_group = r.run_one(df.select(*group_cols, text_col), F.col(text_col)).groupBy(*group_cols).agg(
        *(F.sum(counts[i]).alias(f"n{i}") for i in range(len(r.detectors))),
        *(F.count_if(counts[i] > 0).alias(f"d{i}") for i in range(len(r.detectors))))
    rows = F.array(*(F.struct(F.lit(d).alias("detector"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("docs"))
                     for i, d in enumerate(r.detectors)))
    return per_group.select(*group_cols, F.explode(rows).alias("r")).select(*group_cols, "r.*")


def rollup_stats(stats: DataFrame, group_cols: Sequence[str] = ("lang", "source")) -> DataFrame:
    """Subtotals of ``redaction_stats`` over all combinations of the groups; NULL means all."""
    return stats.cube(*group_cols, "detector").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def length_change(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  redactor: Redactor | None = None) -> DataFrame:
    """Length of every text before and after redaction, and the difference."""
    done = redact(df.select(id_col, text_col), text_col, redactor)
    return done.select(id_col, F.col("len_before").alias("before"), F.col("len_after").alias("after"),
                       (F.col("len_after") - F.col("len_before")).alias("diff"))


def audit_columns(df: DataFrame, columns: Sequence[str], redactor: Redactor | None = None) -> DataFrame:
    """Column profile of a table: per column and detector the rows hit, their share and the replacements."""
    r = redactor or Redactor()
    done = r.run(df.select(*columns), F.array(*(F.col(c).cast("string") for c in columns)))
    cells = done.select(F.posexplode("_done").alias("_col", "_cell"))
    per_column = cells.groupBy("_col").agg(
        F.count("*").alias("rows"),
        *(F.sum(F.col("_cell.c")[i]).alias(f"n{i}") for i in range(len(r.detectors))),
        *(F.count_if(F.col("_cell.c")[i] > 0).alias(f"d{i}") for i in range(len(r.detectors))))
    stats = F.array(*(F.struct(F.lit(d).alias("detector"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("rows_hit"))
                      for i, d in enumerate(r.detectors)))
    names = F.array(*(F.lit(c) for c in columns))
    return (per_column.select(F.get(names, F.col("_col")).alias("column"), "rows", F.explode(stats).alias("s"))
            .select("column", "rows", "s.*", (F.col("s.rows_hit") / F.col("rows")).alias("share")))


def audit_detectors(df: DataFrame, text_col: str = "text", redactor: Redactor | None = None) -> DataFrame:
    """Per detector: documents, documents hit and their share."""
    r = redactor or Redactor()
    counts = F.col("_done.c")
    overall = r.run_one(df.select(text_col), F.col(text_col)).agg(
        F.count("*").alias("docs_total"),
        *(F.sum(counts[i]).alias(f"n{i}") for i in range(len(r.detectors))),
        *(F.count_if(counts[i] > 0).alias(f"d{i}") for i in range(len(r.detectors))))
    rows = F.array(*(F.struct(F.lit(d).alias("detector"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("docs"))
                     for i, d in enumerate(r.detectors)))
    return overall.select("docs_total", F.explode(rows).alias("r")).select(
        "r.detector", "r.n", "r.docs", "docs_total", (F.col("r.docs") / F.col("docs_total")).alias("share"))


def riskiest(df: DataFrame, k: int, group_cols: Sequence[str] = ("source",), id_col: str = "doc_id",
             text_col: str = "text", redactor: Redactor | None = None) -> DataFrame:
    """The ``k`` documents of each group with the most replacements (ties: smaller id).

    The rank filter is pushed below the shuffle, so that at most ``k`` rows per
    group leave a task: a hot group is never gathered in one place.
    """
    counts = redact(df.select(*group_cols, id_col, text_col), text_col, redactor)
    scored = counts.select(*group_cols, id_col, "n_total")
    order = Window.partitionBy(*group_cols).orderBy(F.col("n_total").desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("n_total") > 0))


def distinct_values(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    redactor: Redactor | None = None, approximate: bool = False) -> DataFrame:
    """Findings and distinct matched values per detector.

    Exact counting sends every distinct value once per task; ``approximate`` sends
    a fixed-size sketch per detector instead.
    """
    found = findings(df, (id_col,), text_col, redactor)
    if approximate:
        return found.groupBy("detector").agg(F.count("*").alias("n"), F.approx_count_distinct("match").alias("values"))
    # by value first: a value that makes up most of the findings is merged in the tasks that met it
    per_value = found.groupBy("detector", "match").agg(F.count("*").alias("n"))
    return per_value.groupBy("detector").agg(F.sum("n").alias("n"), F.count("*").alias("values"))


def top_values(df: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text",
               redactor: Redactor | None = None) -> DataFrame:
    """The ``k`` most frequent matches (ties: by detector and match)."""
    found = findings(df, (id_col,), text_col, redactor)
    return (found.groupBy("detector", "match").agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), "detector", "match").limit(k))


BIN = 128  # characters of a stretch of a text in which findings meet


def agreement(found: DataFrame, id_col: str | Sequence[str] = "doc_id") -> DataFrame:
    """How far recognizers agree: one row for each pair of them, ``one`` before ``two``.

    ``found`` has the ids, ``recognizer``, ``start``, ``end`` and ``label``. ``overlaps``: pairs of
    findings that share a character; ``exact``: those with the same bounds; ``conflicts``:
    those whose labels are of different kinds (what stands before a colon). ``only_one``,
    ``only_two``: findings that meet none of the other. Findings meet in stretches of a
    text, never in whole documents, and a pair is counted in the first stretch that it
    shares: a text with very many findings is no hot key.
    """
    ids = as_list(id_col)
    kind = F.regexp_extract("label", r"^\[?([A-Z0-9_]+)", 1)
    numbered = found.select(*ids, "recognizer", "start", "end", kind.alias("kind")).distinct()
    binned = numbered.withColumn("bin", F.explode(F.expr(f"sequence(start div {BIN}, greatest(end - 1, start) div {BIN})")))
    key = [*ids, "bin"]
    sides = [binned.select(*key, *(F.col(c).alias(f"{c}_{n}") for c in ("recognizer", "start", "end", "kind"))) for n in ("one", "two")]
    met = sides[0].join(sides[1], key).where("recognizer_one < recognizer_two AND start_one < end_two AND start_two < end_one").where(
        F.col("bin") == F.expr(f"greatest(start_one, start_two) div {BIN}"))
    pair = [F.col(f"recognizer_{n}").alias(n) for n in ("one", "two")]
    pairs = met.groupBy(*pair).agg(
        F.count("*").alias("overlaps"), F.count_if(F.expr("start_one = start_two AND end_one = end_two")).alias("exact"),
        F.count_if(F.expr("kind_one <> kind_two")).alias("conflicts"))
    totals = numbered.groupBy("recognizer").agg(F.count("*").alias("total"))
    # a finding that meets several is counted once: merged in the tasks, for each side
    hit = [met.select(*pair, *ids, F.col(f"start_{n}").alias("start"), F.col(f"end_{n}").alias("end"), F.col(f"kind_{n}").alias("kind")).distinct()
           .groupBy("one", "two").agg(F.count("*").alias(f"met_{n}")) for n in ("one", "two")]
    every = totals.select(F.col("recognizer").alias("one"), F.col("total").alias("total_one")).join(
        totals.select(F.col("recognizer").alias("two"), F.col("total").alias("total_two")), F.expr("one < two"))  # a row per recognizer
    out = every
    for part in (pairs, *hit):
        out = out.join(part, ["one", "two"], "left")
    out = out.fillna(0)
    return out.select("one", "two", "overlaps", "exact", "conflicts", (F.col("total_one") - F.col("met_one")).alias("only_one"),
                      (F.col("total_two") - F.col("met_two")).alias("only_two"))


def value_sketches(found: DataFrame, group_cols: Sequence[str] = (), lg_k: int = 12, items: int = 4096) -> DataFrame:
    """Per group and detector: ``n`` findings, a sketch of their distinct values and one of the frequent ones, as binary.

    Sketches of parts of a corpus, or of several runs, can be merged without reading
    any text again; their size does not grow with what they have seen.
    """
    return found.groupBy(*group_cols, "detector").agg(
        F.count("*").alias("n"), F.hll_sketch_agg("match", F.lit(lg_k)).alias("distinct"), F.expr(f"approx_top_k_accumulate(match, {items})").alias("frequent"))


def merge_sketches(sketches: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """The sketches of all rows of a group and detector as one."""
    return sketches.groupBy(*group_cols, "detector").agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.expr("approx_top_k_combine(frequent)").alias("frequent"))


def read_sketches(sketches: DataFrame, k: int = 5) -> DataFrame:
    """What sketches say: ``values``, about how many distinct ones, and ``top``, the ``k`` most frequent with their counts."""
    rest = [c for c in sketches.columns if c not in ("distinct", "frequent")]
    return sketches.select(*rest, F.hll_sketch_estimate("distinct").alias("values"), F.expr(f"approx_top_k_estimate(frequent, {k})").alias("top"))


def residual_scan(redacted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  redactor: Redactor | None = None) -> DataFrame:
    """Documents in which a redacted text still holds something outside labels: expected to be empty."""
    done = redact(redacted.select(id_col, text_col), text_col, redactor)
    return done.where("n_total > 0").select(id_col, "n_total", "counts")


def profile_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      path: Column | None = None) -> DataFrame:
    """Lines, characters, bytes and encoding of every text, and the extension of its ``path``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    extension = [extension_of(path).alias("extension")] if path is not None else []
    return df.select(
        id_col, (F.regexp_count(text, F.lit("\n")) + 1).alias("lines"), F.length(text).alias("chars"),
        F.octet_length(text).alias("bytes"),
        F.when(F.length(text) == F.octet_length(text), "ascii").otherwise("utf-8").alias("encoding"), *extension)


def extension_of(path: Column) -> Column:
    """The extension of a path or URL in lower case with its dot, or ''; query and fragment are no part of it."""
    name = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1))
