"""Line dedup by content-defined chunks of lines and by units of two lines.

A rolling hash over the hashes of the last lines of a text decides, from content
alone, after which lines a chunk ends; a passage of lines is therefore cut alike
wherever it stands, however many lines precede it. A chunk of several lines that
occurs elsewhere, in the same text or another, is removed. So that a match does not
end with the chunk, each two lines that follow each other, blank ones between them
included, are a unit as well: a passage of two lines or more that recurs goes line by
line, as far as it recurs, whatever its neighbours are. The first occurrence of each
chunk and unit (smallest id, then text, then position) is not removed for its own
sake, and occurrences that overlap the first one do not count. The first place of
each line always stays.

Hashes of chunks and units are brought together first; only texts that hold a repeated
hash give bytes, which are grouped and so compared as bytes. Copies are merged within
tasks before they are shuffled: a passage that a third of all texts hold is a count, not
a group. Nothing is collected or broadcast.

Defined cases: a null or empty text has no chunk and stays as it is (null stays null).
A line that recurs alone, and blank lines alone, are never removed. Rows that share id
and text are one document stored twice: all are cut alike, and they do not make each
other's lines repeated. A null id comes after all others. Other columns pass through
unchanged.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import SLICE, as_bytes, own_columns, stored, table

_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Settings:
    """``window``: lines that the rolling hash looks back over. ``divisor``: mean distance of boundaries, in lines.
    ``least``: lines of a chunk that may be removed, and that a chunk has unless the text ends."""

    window: int = 1
    divisor: int = 2
    least: int = 2


def chunks(text: bytes, s: Settings = Settings()) -> list[tuple[int, int, int]]:
    """(begin, end, lines) of the chunks of a text, in bytes; they cover it, each with its closing line ends."""
    if not text:
        return []
    lines = text.split(b"\n")
    out, begin, at, held, rolling, past = [], 0, 0, 0, 0, []
    base, last = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, s.window, 1 << 64)
    for i, line in enumerate(lines):
        own = xxhash.xxh64_intdigest(line)
        past.append(own)
        rolling = (rolling * base + own) & _MASK
        if i >= s.window:
            rolling = (rolling - past[i - s.window] * last) & _MASK
        at += len(line) + 1
        held += 1
        if held >= s.least and (rolling >> 32) % s.divisor == 0:
            out.append((begin, min(at, len(text)), held))
            begin, held = at, 0
    if held:
        out.append((begin, len(text), held))
    return out


def body_of(text: bytes, chunk: tuple[int, int, int]) -> bytes:
    """The bytes of a chunk without its closing line end, which the last chunk of a text lacks."""
    begin, end, _ = chunk
    return text[begin:end - 1] if text[end - 1:end] == b"\n" else text[begin:end]


def spans(text: bytes, s: Settings = Settings()) -> dict[tuple[int, int], int]:
    """(begin, end) in bytes, without the closing line end, and hash of what could be removed: each two lines in a row
    that are not blank, with the blank ones between, and chunks that begin or end with a blank line. The lines of other
    chunks are those of their pairs."""
    out, at, before, base = {}, 0, None, 0x9E3779B97F4A7C15
    for line in text.split(b"\n"):
        if line.strip():
            own = xxhash.xxh64_intdigest(line)
            if before:
                out[before[0], at + len(line)] = (before[1] * base + own) & _MASK
            before = at, own
        at += len(line) + 1
    for c in chunks(text, s):
        body = body_of(text, c)
        lines = body.split(b"\n")
        if c[2] >= s.least and body.strip() and not (lines[0].strip() and lines[-1].strip() and len(lines) > 1):
            out.setdefault((c[0], c[0] + len(body)), xxhash.xxh64_intdigest(body))
    return out


def without(text: bytes, gone: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text without the lines that lie within ``gone``, how many lines it had and how many go."""
    if not text:
        return text, 0, 0
    lines, kept, at, reach, place, gone = text.split(b"\n"), [], 0, -1, 0, sorted(gone)
    for line in lines:
        while place < len(gone) and gone[place][0] <= at:
            reach = max(reach, gone[place][1])
            place += 1
        if at + len(line) > reach:
            kept.append(line)
        at += len(line) + 1
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text"))


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_key and _row, all columns as one: both joins by _key then need the same columns, and texts are shuffled once."""
    return docs.select(_key(id_col, text_col).alias("_key"), F.struct(*own_columns(docs)).alias("_row"))


def _hashed(keyed: DataFrame, text_col: str, s: Settings) -> DataFrame:
    """_key, begin, size, hash: the spans of each text that could be removed."""
    @F.arrow_udf("array<struct<begin: int, size: int, hash: long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, begins, sizes, hashes = [0], [], [], []
            for begin in range(0, len(texts), SLICE):
                for text in as_bytes(texts.slice(begin, SLICE)):
                    for (first, end), own in spans(text, s).items():
                        begins.append(first)
                        sizes.append(end - first)
                        hashes.append(own)
                    counts.append(len(begins))
            fields = [pa.array(begins, pa.int32()), pa.array(sizes, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64))]
            yield pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(fields, ["begin", "size", "hash"]))

    return keyed.select("_key", F.explode(run(F.col(text_col))).alias("span")).select("_key", "span.begin", "span.size", "span.hash")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """_key of each text (no_id, id, hash of the text) and ``gone``, begin and end of its spans that go."""
    keyed = docs.select(_key(id_col, text_col).alias("_key"), F.col(text_col).alias("text"))
    found = _hashed(keyed, "text", s)
    often = found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    wanted = found.join(often, "hash", "left_semi").groupBy("_key").agg(F.collect_set(F.struct("begin", "size")).alias("spans"))
    text = F.element_at(F.array("_row"), 1).getField(text_col).cast("binary")  # in an array, as no field is then drawn below the shuffle
    bodies = _packed(docs, id_col, text_col).join(wanted, "_key").select("_key", F.explode(F.transform("spans", lambda x: F.struct(
        x.begin.alias("begin"), F.substring(text, x.begin + 1, x.size).alias("body")))).alias("span"))  # of binary, in bytes
    bodies = bodies.select(F.col("span.body").alias("body"), F.struct("_key", "span.begin").alias("at"))
    # written, so that the join meets plain rows: those of a body that very many texts hold can be split
    groups = stored(bodies.groupBy("body").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").select("body", "first"))
    end = F.col("at.begin") + F.length("body")
    later = (F.col("at._key") != F.col("first._key")) | (F.col("at.begin") > F.col("first.begin") + F.length("body"))
    return (bodies.join(groups, "body").where(later).select("at._key", F.struct(F.col("at.begin").alias("begin"), end.alias("end")).alias("span"))
            .groupBy("_key").agg(F.collect_set("span").alias("gone")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings(),
                counts: Sequence[str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` without the repeated lines of their texts; what is left is joined as it stood. ``counts`` adds how many
    lines a text had and lost; none of them may be a column of ``docs``."""
    @F.arrow_udf("struct<text: string, n_lines: int, n_removed: int>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("text", pa.string()), ("n_lines", pa.int32()), ("n_removed", pa.int32())])
        for texts, gone in batches:
            out = []
            for text, places in zip(texts, gone.to_pylist()):
                raw = b"" if text.as_py() is None else text.as_buffer().to_pybytes()
                kept, n, lost = without(raw, [(x["begin"], x["end"]) for x in places or ()])
                out.append({"text": None if text.as_py() is None else kept.decode(), "n_lines": n, "n_removed": lost})
            yield pa.array(out, kind)

    gone = repeated(docs, id_col, text_col, s)
    joined = _packed(docs, id_col, text_col).join(gone, "_key", "left")
    joined = joined.select("_row", cut(F.col("_row").getField(text_col), F.col("gone")).alias("_cut"))
    kept = {text_col.lower(): F.col("_cut.text")}
    return joined.select(*(kept.get(c.lower(), F.col("_row").getField(c)).alias(c) for c in docs.columns),
                         *(F.col(f"_cut.{field}").alias(name) for field, name in zip(("n_lines", "n_removed"), counts)))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, number of lines, lines removed, and hash of the text that is left."""
    return (dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
            .select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"),
                    F.sha2("text", 256).alias("kept_sha256")))
