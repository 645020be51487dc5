"""Redaction of whole texts, lines, tables, nested values and markup.

All jobs here are narrow: one scan, one projection, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions import context
from scrubline.functions.passes import apply_rule, counts, start
from scrubline.functions.rules import DETECTORS, Rule, rules
from scrubline.functions.segments import segments
from scrubline.functions.text import chunks, hits, interleave, let, piece, quote, running_total, total


# As many as the analyzer resolves within its default number of iterations, with room to spare.
_RULES_PER_STEP = 4


class Redactor:
    """A choice of rules, ready to be applied to the texts of a DataFrame.

    ``detectors`` limits the choice, ``extra`` adds own rules, ``profile`` is
    ``fixed`` or ``ref`` (see ``functions.rules``).
    """

    def __init__(self, keywords: Sequence[str] = (), detectors: Iterable[str] | None = None,
                 profile: str = "fixed", extra: Sequence[Rule] = ()):
        self.profile = profile
        self.rules = rules(profile, keywords, detectors, extra)
        self.detectors = list(dict.fromkeys(rule.detector for rule in self.rules))
        #: Whether texts may be cut where ``functions.segments`` allows it.
        self.cuts = profile == "fixed" and not extra and not any("\n" in k for k in keywords)

    def run(self, df: DataFrame, texts: Column, name: str = "_done", marks: bool = False) -> DataFrame:
        """Add ``name``: for every text of the array ``texts`` the struct ``(t, c)``.

        ``t`` is the redacted text, ``c`` the replacements in the order of
        ``self.detectors``. A few rules at a time keep the analysis of the plan
        short; as every step refers to the one before only once, Catalyst merges
        them all into a single projection. With ``marks`` an element of ``texts`` is a
        struct of the text ``t`` and ascending offsets ``p`` in it, and so is the result,
        with the offsets moved along.
        """
        df = df.withColumn(name, texts)
        first_state = start("text.t", self.profile, "text.p") if marks else start("text", self.profile)
        df = df.withColumn(name, F.expr(f"transform({name}, text -> {first_state})"))
        at_once = 2 if marks else _RULES_PER_STEP
        for first in range(0, len(self.rules), at_once):
            step = name
            for rule in self.rules[first:first + at_once]:
                one = apply_rule("state", rule, self.detectors.index(rule.detector), self.profile, marks)
                step = f"transform({step}, state -> {one})"
            df = df.withColumn(name, F.expr(step))
        result = f"named_struct('t', state.t, 'c', {counts('state', len(self.detectors))}{", 'p', state.p" if marks else ''})"
        # the generator keeps a filter on the result from being pushed below it,
        # where it would evaluate all rules a second time
        return df.withColumn(name, F.explode(F.expr(f"array(transform({name}, state -> {result}))")))

    def run_one(self, df: DataFrame, text: Column, name: str = "_done") -> DataFrame:
        """As ``run`` for a single text per row: ``name`` is the struct itself.

        Where it makes no difference the text is cut into segments first, so that a rule
        which may match in one line runs over that line and not over the whole text.
        """
        if not self.cuts:
            return self.run(df, F.array(text), name).withColumn(name, F.element_at(name, 1))
        done = self.run(df.withColumn(name, F.coalesce(text, F.lit(""))).withColumn(name, F.expr(segments(name))), F.col(name), name)
        sums = f"transform(sequence(0, {max(len(self.detectors) - 1, 0)}), i -> aggregate({name}, 0, (n, d) -> n + d.c[i]))"
        # again behind a generator, so that nothing above it takes the expression in
        return done.withColumn(name, F.explode(F.expr(f"array(IF(size({name}) = 1, {name}[0], named_struct('t', array_join({name}.t, '\\n'), 'c', {sums})))")))

    def count(self, counts: Column, detector: str) -> Column:
        if detector not in self.detectors:
            return F.lit(0)
        return F.get(counts, self.detectors.index(detector))

    def counts_map(self, counts: Column) -> Column:
        """``MAP<STRING,INT>`` over all twelve detectors and the user's own, zeros included."""
        names = [*DETECTORS, *(d for d in self.detectors if d not in DETECTORS)]
        return F.map_from_arrays(F.array(*(F.lit(name) for name in names)),
                                 F.array(*(self.count(counts, name) for name in names)))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, n: acc + n)


def redact(df: DataFrame, text_col: str = "text", redactor: Redactor | None = None) -> DataFrame:
    """Replace ``text_col`` and add ``counts``, ``n_total``, ``len_before`` and ``len_after``."""
    r = redactor or Redactor()
    done = r.run_one(df, F.col(text_col))
    return done.select(
        *(c for c in df.columns if c != text_col),
        F.col("_done.t").alias(text_col),
        r.counts_map(F.col("_done.c")).alias("counts"),
        _sum(F.col("_done.c")).alias("n_total"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("len_before"),
        F.length("_done.t").alias("len_after"))


def redact_column(df: DataFrame, text_col: str, redactor: Redactor, n_col: str = "n") -> DataFrame:
    """Replace ``text_col`` and add the number of replacements."""
    done = redactor.run_one(df, F.col(text_col))
    return done.select(*(F.col("_done.t").alias(c) if c == text_col else F.col(c) for c in df.columns),
                       _sum(F.col("_done.c")).alias(n_col))


def redact_long_texts(df: DataFrame, id_cols: Sequence[str], text_col: str = "text", redactor: Redactor | None = None,
                      size: int = 1 << 16, n_col: str = "n") -> DataFrame:
    """As ``redact_column``, with texts longer than ``size`` redacted in parallel.

    They are cut where no rule can tell (see ``functions.segments``), and neighbouring
    segments are put together to pieces of ``size`` characters or little more, which
    are rows of their own, dealt out to all tasks, and assembled again by the ids, which
    must tell the texts apart. So the longest task depends on the longest stretch
    without such a place, not on the longest text; the result is the same. Shorter
    texts stay where they are.
    """
    r = redactor or Redactor()
    if not r.cuts:
        return redact_column(df, text_col, r, n_col)
    ids = list(id_cols)
    is_long = F.length(F.coalesce(F.col(text_col), F.lit(""))) > size
    longs = df.where(is_long)
    lengths = "transform(_parts, p -> length(p) + 1)"
    starts = running_total(lengths)
    # a piece is a run of segments that begin within the same stretch of the text
    cut = longs.select(*ids, F.expr(segments(text_col)).alias("_parts")).withColumn("_starts", F.expr(starts))
    rows = cut.select(*ids, F.explode(F.expr(f"transform(_parts, (p, i) -> named_struct('no', i, 'piece', _starts[i] div {size}, 'text', p))")).alias("_p"))
    pieces = rows.groupBy(*ids, F.col("_p.piece").alias("_piece")).agg(F.array_sort(F.collect_list(F.struct("_p.no", "_p.text"))).alias("_p"))
    pieces = pieces.select(*ids, "_piece", F.array_join("_p.text", "\n").alias("_text"))
    done = redact_column(pieces, "_text", r, "_n")
    whole = done.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("_piece", "_text"))).alias("_all"), F.sum("_n").cast("int").alias("_n"))
    whole = whole.select(*ids, F.array_join("_all._text", "\n").alias("_text"), "_n")
    joined = longs.drop(text_col).join(whole, ids).withColumnsRenamed({"_text": text_col, "_n": n_col}).select(*(_named(c) for c in df.columns), n_col)
    return redact_column(df.where(~is_long), text_col, r, n_col).union(joined)


def redact_lines(df: DataFrame, text_col: str = "text", redactor: Redactor | None = None) -> DataFrame:
    """Line by line within the row: every line is a block of its own, blank ones are skipped.

    Adds ``n_blocks`` (lines that are not blank) and ``n_changed``. The document
    stays one row, so nothing has to be shuffled to put it together again.
    """
    r = redactor or Redactor()
    rest = [c for c in df.columns if c != text_col]
    split = df.select(*rest, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("_lines"))
    # a blank line has nothing any rule could find, so it passes unchanged
    done = r.run(split, F.col("_lines"))
    return done.select(
        *rest,
        F.array_join(F.col("_done.t"), "\n").alias(text_col),
        F.size(F.filter("_lines", _not_blank)).alias("n_blocks"),
        F.size(F.filter(F.zip_with("_lines", "_done.t", lambda old, new: old != new), lambda x: x)).alias("n_changed"))


def _not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def redact_blocks(blocks: DataFrame, redactor: Redactor | None = None, text_col: str = "text") -> DataFrame:
    """A table with one block per row (paragraph, table cell, header, footer, page block).

    Keeps all rows and adds ``redacted`` and ``changed``; blank blocks pass unchanged.
    """
    r = redactor or Redactor()
    done = r.run_one(blocks, F.col(text_col))
    redacted = F.col("_done.t")
    return done.select(*blocks.columns, redacted.alias("redacted"),
                       (redacted != F.coalesce(F.col(text_col), F.lit(""))).alias("changed"))


def assemble_blocks(blocks: DataFrame, id_col: str = "doc_id", order_col: str = "block_no",
                    text_col: str = "redacted", separator: str = "\n") -> DataFrame:
    """Documents from their blocks in order: ``text``, ``n_blocks`` and ``n_changed``.

    What is gathered for a key is one document, the size of the result. Where the
    lines stand in one row to begin with, ``redact_lines`` needs no shuffle.
    """
    parts = F.array_sort(F.collect_list(F.struct(order_col, text_col)))
    return blocks.groupBy(id_col).agg(
        F.array_join(parts[text_col], separator).alias("text"),
        F.count_if(_not_blank(F.col(text_col))).cast("int").alias("n_blocks"),
        F.count_if("changed").cast("int").alias("n_changed"))


def redact_table(df: DataFrame, redactor: Redactor | None = None, columns: Sequence[str] | None = None,
                 keys: bool = True) -> DataFrame:
    """Every STRING column of a table, or those named; other types and NULLs are untouched.

    The cells of a row run through the rules together, as one array: the plan
    does not grow with the number of columns. With ``keys`` the name of a column
    tells about its cells (see ``functions.context``).
    """
    r = redactor or Redactor()
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    chosen = [c for c in strings if columns is None or c in columns]
    if columns is not None and set(columns) - set(chosen):
        raise ValueError(f"not STRING columns: {sorted(set(columns) - set(chosen))}")
    if not chosen:
        return df
    told = [context.of_key(c, None, r.detectors) if keys else None for c in chosen]
    done = r.run(df, F.array(*(_named(c) if k is None else F.expr(context.with_phrase(_quoted(c), str(k))) for c, k in zip(chosen, told))))

    def cell(c: str) -> Column:
        at = chosen.index(c)
        text = f"_done[{at}].t" if told[at] is None else context.without_phrase(_quoted(c), f"_done[{at}].t", str(told[at]))
        return F.when(_named(c).isNotNull(), F.expr(text)).alias(c)

    return done.select(*(cell(c) if c in chosen else _named(c) for c in df.columns))


def _named(column: str) -> Column:
    return F.col(_quoted(column))


def redact_nested(df: DataFrame, redactor: Redactor | None = None, columns: Sequence[str] | None = None, keys: bool = True) -> DataFrame:
    """String leaves of structs, arrays, maps and VARIANT columns; keys, other types and NULLs are untouched.

    All string leaves of a row are gathered in one array, in the order of a fixed
    walk, redacted together, and written back by their place in that walk: linear in
    the number of leaves. A VARIANT column is walked as its JSON text; one inside
    another type is refused, so that nothing passes unread.

    With ``keys`` a leaf is read with what its key tells about it: the name of its
    field, the key of its map entry, that of the array it stands in, the name of its
    column (see ``functions.context``). ``{"password": "hunter22x"}`` loses its value
    as it does in a text. Names of fields are looked up when the job is built, those of
    maps and of VARIANTs while it runs.
    """
    r = redactor or Redactor()
    wanted = [f for f in df.schema.fields if columns is None or f.name in columns]
    for f in wanted:
        if not isinstance(f.dataType, T.VariantType) and _has_variant(f.dataType):
            raise ValueError(f"column {f.name} has a VARIANT inside another type: extract it to a column of its own")
    variants = [f.name for f in wanted if isinstance(f.dataType, T.VariantType)]
    chosen = [f for f in wanted if _has_text(f.dataType)]
    if not chosen and not variants:
        return df
    detectors = r.detectors if keys else []
    json = {c: f"to_json({_quoted(c)})" for c in variants}
    parts, told, walks, base = [], [], {}, "0"
    for f in chosen:
        parts.append(_leaves(_quoted(f.name), f.dataType))
        told.append(_contexts(_quoted(f.name), f.dataType, context.of_key(f.name, None, detectors), detectors))
        walks[f.name], base = _walk(_quoted(f.name), f.dataType, base), f"{base} + {_count(_quoted(f.name), f.dataType)}"
    for c in variants:
        tokens = hits(json[c], JSON_STRING)
        strings = f"coalesce(transform({tokens}, s -> {_unquoted('s')}), CAST(array() AS ARRAY<STRING>))"
        parts.append(strings)
        told.append(_json_contexts(json[c], context.of_key(c, None, detectors), detectors) if detectors else None)
        written = f"transform({tokens}, (s, i) -> IF({_unquoted('s')} IS NULL, s, {_json_quoted(f'_done[{base} + i]')}))"
        pieces = f"split({json[c]}, {quote(JSON_STRING)}, -1)"
        walks[c], base = f"IF({json[c]} IS NULL, NULL, parse_json({interleave(pieces, written)}))", f"{base} + size({strings})"
    if all(t is None for t in told):
        done = r.run(df.withColumn("_leaves", F.expr(f"concat({', '.join(parts)})")), F.col("_leaves"))
        texts = F.col("_done.t")
    else:
        told = [t or _no_contexts(f"size({part})") for t, part in zip(told, parts)]
        done = df.withColumns({"_leaves": F.expr(f"concat({', '.join(parts)})"), "_told": F.expr(f"concat({', '.join(told)})")})
        done = r.run(done, F.expr(f"zip_with(_leaves, _told, (v, k) -> {context.with_phrase('v', 'k')})"))
        texts = F.expr(f"transform(_leaves, (v, i) -> {let('k', '_told[i]', let('d', '_done[i].t', context.without_phrase('v', 'd', 'k')))})")
    # behind a generator, or the array would be made again for each leaf that is read from it
    done = done.withColumn("_done", F.explode(F.array(texts)))
    return done.select(*(F.expr(walks[f.name]).alias(f.name) if f.name in walks else _named(f.name) for f in df.schema.fields))


# A string of a JSON text, with the colon that makes it a key.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?'


def _unquoted(token: str) -> str:
    """SQL: the value of a JSON string, NULL for a key."""
    return f"IF(endswith({token}, ':'), NULL, from_json(concat('[', {token}, ']'), 'ARRAY<STRING>')[0])"


def _json_quoted(text: str) -> str:
    return let("j", f"to_json(array({text}))", "substring(j, 2, length(j) - 2)")


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _has_variant(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_variant(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_variant(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_variant(dtype.keyType) or _has_variant(dtype.valueType)
    return isinstance(dtype, T.VariantType)


def _has_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_text(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_text(dtype.valueType)
    return isinstance(dtype, T.StringType)


def _fixed(dtype: T.DataType) -> int | None:
    """How many leaves every value of a type has, NULLs included; None if that varies."""
    if isinstance(dtype, T.StructType):
        own = [_fixed(f.dataType) for f in dtype.fields if _has_text(f.dataType)]
        return None if None in own else sum(own)
    return 1 if isinstance(dtype, T.StringType) else None


def _count(value: str, dtype: T.DataType, depth: int = 0) -> str:
    """SQL: the number of leaves of a value."""
    if (fixed := _fixed(dtype)) is not None:
        return str(fixed)
    if isinstance(dtype, T.StructType):
        return "(" + " + ".join(_count(f"{value}.{_quoted(f.name)}", f.dataType, depth) for f in dtype.fields if _has_text(f.dataType)) + ")"
    if isinstance(dtype, T.MapType):
        return _count(f"map_values({value})", T.ArrayType(dtype.valueType), depth)
    if (fixed := _fixed(dtype.elementType)) is not None:
        return f"IF({value} IS NULL, 0, size({value}) * {fixed})"
    return f"coalesce({total(f'transform({value}, x{depth} -> {_count(f'x{depth}', dtype.elementType, depth + 1)})')}, 0)"


def _leaves(value: str, dtype: T.DataType, depth: int = 0) -> str:
    """SQL: all string leaves of a value as ARRAY<STRING>, NULLs included."""
    if isinstance(dtype, T.StructType):
        return "concat(" + ", ".join(_leaves(f"{value}.{_quoted(f.name)}", f.dataType, depth) for f in dtype.fields if _has_text(f.dataType)) + ")"
    if isinstance(dtype, T.MapType):
        return _leaves(f"map_values({value})", T.ArrayType(dtype.valueType), depth)
    if isinstance(dtype, T.ArrayType):
        own = value if isinstance(dtype.elementType, T.StringType) else (
            f"flatten(transform({value}, x{depth} -> {_leaves(f'x{depth}', dtype.elementType, depth + 1)}))")
        return f"coalesce({own}, CAST(array() AS ARRAY<STRING>))"
    return f"array({value})"


def _contexts(value: str, dtype: T.DataType, around: int | str | None, detectors: list[str], depth: int = 0) -> str | None:
    """SQL: for each leaf, in the order of ``_leaves``, the context its key gives it, as ARRAY<INT>; None if no leaf has one.

    ``around`` is known (a number or None), or SQL for it where a key of a map decides."""
    if isinstance(dtype, T.StringType):
        return None if around is None else f"array({around})"
    if isinstance(dtype, T.StructType):
        fields = [(f"{value}.{_quoted(f.name)}", f) for f in dtype.fields if _has_text(f.dataType)]
        names = [around if context.normal(f.name) in context.PLAIN_KEYS else context.of_key(f.name, None, detectors) for _, f in fields]
        own = [_contexts(field, f.dataType, name, detectors, depth) for (field, f), name in zip(fields, names)]
        if all(o is None for o in own):
            return None
        return "concat(" + ", ".join(o or _no_contexts(_count(field, f.dataType, depth)) for o, (field, f) in zip(own, fields)) + ")"
    if isinstance(dtype, T.ArrayType):
        inner = _contexts(f"x{depth}", dtype.elementType, around, detectors, depth + 1)
        each = f"transform({value}, x{depth} -> {inner})"
    else:
        outer = "CAST(NULL AS INT)" if around is None else str(around)
        by_key = detectors and isinstance(dtype.keyType, T.StringType)
        inner = _contexts(f"e{depth}.value", dtype.valueType, f"k{depth}" if by_key else around, detectors, depth + 1)
        key = context.of_key_sql(f"e{depth}.key", outer, detectors) if by_key else outer
        each = f"transform(map_entries({value}), e{depth} -> {let(f'k{depth}', key, inner or 'NULL')})"
    return inner and f"coalesce(flatten({each}), CAST(array() AS ARRAY<INT>))"


def _no_contexts(number: str) -> str:
    return f"array_repeat(CAST(NULL AS INT), {number})"


# Steps of a walk over a JSON text: its strings, keys told by their colon, and the brackets between them.
_JSON_STEP = JSON_STRING + r"|[\[\]{}]"


def _json_contexts(json: str, around: int | None, detectors: list[str]) -> str:
    """SQL: for each string of a JSON text, keys included, the context of the key it stands under, as ARRAY<INT>.

    A text in which some key gives a context is walked with a stack of what holds
    around each bracket.
    """
    none = "CAST(array() AS ARRAY<INT>)"
    outer = "CAST(NULL AS INT)" if around is None else f"CAST({around} AS INT)"
    name = f"from_json(concat('[', regexp_replace(s, {quote(r'\s*:$')}, ''), ']'), 'ARRAY<STRING>')[0]"
    init = f"named_struct('up', {none}, 'k', {outer}, 'out', {none})"
    step = (f"CASE WHEN s IN ('{{', '[') THEN named_struct('up', concat(state.up, array(state.k)), 'k', state.k, 'out', state.out) "
            "WHEN s IN ('}', ']') THEN named_struct('up', slice(state.up, 1, size(state.up) - 1), 'k', element_at(state.up, -1), 'out', state.out) "
            f"WHEN endswith(s, ':') THEN named_struct('up', state.up, 'k', {context.of_key_sql(name, 'get(state.up, size(state.up) - 1)', detectors)}, "
            "'out', concat(state.out, array(CAST(NULL AS INT)))) "
            "ELSE named_struct('up', state.up, 'k', state.k, 'out', concat(state.out, array(state.k))) END")
    walked = f"aggregate({hits(json, _JSON_STEP)}, {init}, (state, s) -> {step}, state -> state.out)"
    told = f"exists({hits(json, JSON_STRING)}, s -> endswith(s, ':') AND {context.of_key_sql(name, 'CAST(NULL AS INT)', detectors)} IS NOT NULL)"
    strings = f"size({hits(json, JSON_STRING)})"
    return f"CASE WHEN {json} IS NULL THEN {none} WHEN {'true' if around is not None else told} THEN {walked} ELSE {_no_contexts(strings)} END"


def _walk(value: str, dtype: T.DataType, base: str, depth: int = 0) -> str:
    """SQL: the same value with its leaves taken from the redacted ones, from place ``base`` on."""
    if not _has_text(dtype):
        return value
    if isinstance(dtype, T.StructType):
        fields = []
        for f in dtype.fields:
            own = f"{value}.{_quoted(f.name)}"
            fields.append(f"{quote(f.name)}, {_walk(own, f.dataType, base, depth)}")
            if _has_text(f.dataType):
                base = f"{base} + {_count(own, f.dataType, depth)}"
        return f"IF({value} IS NULL, NULL, named_struct({', '.join(fields)}))"
    if isinstance(dtype, T.MapType):
        values = _walk(f"map_values({value})", T.ArrayType(dtype.valueType), base, depth)
        return f"map_from_arrays(map_keys({value}), {values})"
    if isinstance(dtype, T.ArrayType):
        x, i, fixed = f"x{depth}", f"i{depth}", _fixed(dtype.elementType)
        if fixed is not None:
            return f"transform({value}, ({x}, {i}) -> {_walk(x, dtype.elementType, f'{base} + {i} * {fixed}', depth + 1)})"
        starts = running_total(f"transform({value}, {x} -> {_count(x, dtype.elementType, depth + 1)})")
        return let(f"s{depth}", starts, (
            f"transform({value}, ({x}, {i}) -> {_walk(x, dtype.elementType, f'{base} + s{depth}[{i}]', depth + 1)})"))
    return f"IF({value} IS NULL, NULL, _done[{base}])"


def redact_json_text(df: DataFrame, json_col: str, redactor: Redactor | None = None) -> DataFrame:
    """JSON documents as they are printed: keys and numbers are redacted as well.

    Adds ``is_json``: whether the result still parses, or has become plain text.
    """
    done = redact_column(df, json_col, redactor or Redactor())
    return done.withColumn("is_json", F.try_parse_json(F.col(json_col)).isNotNull())


TAG = r"<[^>]*>"  # fixed value: what counts as markup
# Elements that text flows through.
INLINE = ("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var "
          "wbr").split()
INLINE_TAG = rf"<(?i:/?(?:{'|'.join(INLINE)}))(?=[\s/>])[^>]*>"
OTHER_TAG = rf"<(?!(?i:/?(?:{'|'.join(INLINE)}))[\s/>])[^>]*>"


def redact_markup(df: DataFrame, html_col: str = "html", redactor: Redactor | None = None,
                  text_nodes_only: bool = False) -> DataFrame:
    """Serialized markup, tags and attributes included, or its text nodes alone. Adds ``n``, the replacements made,
    those within what a later one has replaced as well."""
    r = redactor or Redactor()
    if not text_nodes_only:
        return redact_column(df, html_col, r)
    markup = F.coalesce(F.col(html_col), F.lit(""))
    done = r.run(df.withColumn("_tags", F.regexp_extract_all(markup, F.lit(TAG), F.lit(0))), F.split(markup, TAG, -1))
    return done.select(*(F.expr(interleave("_done.t", "_tags")).alias(c) if c == html_col else F.col(c)
                         for c in df.columns),
                       _sum(F.flatten(F.col("_done.c"))).alias("n"))


def redact_marked_text(df: DataFrame, html_col: str = "html", redactor: Redactor | None = None) -> DataFrame:
    """The text of markup, read across the tags of elements that text flows through; every tag stays.

    ``jo<b>hn</b>@mail.example.com`` is one address to the rules. The text between two
    other tags is one text; where its inline tags stood is kept as a list of offsets,
    which every pass moves along with what it replaces. A tag within a match ends up
    behind its label. Without its tags the result is the redacted text. Adds ``n``.
    """
    r = redactor or Redactor()
    markup = f"coalesce({_quoted(html_col)}, '')"
    text = "concat_ws('', gaps)"
    places = f"slice({running_total('transform(gaps, g -> length(g))')}, 2, size(gaps) - 1)"
    segments = f"transform(split({markup}, {quote(OTHER_TAG)}, -1), s -> {let('gaps', f'split(s, {quote(INLINE_TAG)}, -1)', f"named_struct('t', {text}, 'p', {places})")})"
    inner = f"transform(split({markup}, {quote(OTHER_TAG)}, -1), s -> {hits('s', INLINE_TAG)})"
    taken = df.withColumns({"_segments": F.expr(segments), "_inner": F.expr(inner), "_outer": F.expr(hits(markup, OTHER_TAG))})
    done = r.run(taken, F.col("_segments"), marks=True)
    before = piece("cut", "IF(i = 0, 0, d.p[greatest(i - 1, 0)])", "o")
    rest = piece("cut", "coalesce(get(d.p, size(d.p) - 1), 0)", "length(d.t)")
    whole = let("cut", chunks("d.t"), f"concat_ws('', flatten(transform(d.p, (o, i) -> array({before}, _inner[j][i]))), {rest})")
    written = interleave(f"transform(_done, (d, j) -> IF(size(d.p) = 0, d.t, {whole}))", "_outer")
    return done.select(*(F.expr(written).alias(c) if c == html_col else _named(c) for c in df.columns),
                       _sum(F.flatten(F.col("_done.c"))).alias("n"))
