"""Suffix-array dedup: repeated passages found through the common-prefix intervals of sparse suffix arrays.

Every window of ``length`` bytes picks an anchor, the k-gram of least hash in it; equal
windows pick it at the same offset. Suffixes are therefore needed at anchors only, and
only those whose k-gram occurs again can take part in a repeat. Spark brings the
suffixes of one k-gram together, with the bytes before them: a small enhanced suffix
array. A stack scan of its common-prefix array visits the intervals bottom up. The
members of an interval of depth d agree in d bytes to the right; those that also agree
in the ``length - d`` bytes to the left form a repeat, with all its occurrences. Where
they cease to agree, on the left as on the right, the repeat is maximal: scanning the
suffixes and then, likewise, the reversed prefixes gives the farthest end of each
occurrence on either side. Nothing compares neighbours only.

Equal texts are one text with a number of copies, merged within tasks before they are
shuffled; the anchors of all texts are found once and written.
A k-gram with more than ``most`` suffixes is mostly one passage over and over: its
suffixes are first merged, within tasks, to their distinct surroundings with a count, and
the array is built over these; what is found returns to the places by a join. Should even
the distinct surroundings be more than ``most``, their windows are counted, by hash and
place relative to the anchor, again merged within tasks.

Defined cases: a null text counts as empty. A text shorter than ``length`` bytes loses
nothing. Repeated rows are copies of each other, and each loses all of its text if it
is long enough. Ids are never used, so null or repeated ids do not matter.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import as_bytes, fresh, own_columns, slices, stored, table


@dataclass(frozen=True)
class Settings:
    """``length``: bytes of the shortest repeat. ``gram``: bytes of an anchor. ``most``: suffixes brought together for
    one k-gram. ``block``: bytes of a text hashed at a time, below 2^23."""

    length: int = 200
    gram: int = 32
    most: int = 32768
    block: int = 1 << 20


_LOW = np.uint64((1 << 23) - 1)


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position, built from halves; ``gram`` is a power of two."""
    h, span, base = raw.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while span < gram:
        h = h[:-span] * np.uint64(base) + h[span:]
        span, base = span * 2, base * base % (1 << 64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(text: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows; of equal hashes in a window the rightmost."""
    positions, hashes = [], []
    for begin in range(0, max(0, len(text) - s.length + 1), s.block):
        raw = np.frombuffer(text, np.uint8)[begin:begin + s.block + s.length - 1]
        h = _gram_hashes(raw, s.gram)
        packed = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        at = (_LOW - (_least(packed, s.length - s.gram + 1) & _LOW)).astype(np.int64)
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        if positions and positions[-1][-1] == at[0] + begin:
            at = at[1:]
        if len(at):
            positions.append(at + begin)
            hashes.append(h[at].view(np.int64))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(positions), np.concatenate(hashes)) if positions else (empty, empty)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    odd = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (odd.bit_length() + 7) // 8


def prefix_intervals(strings: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """(depth, members) of the common-prefix intervals of two or more strings, each before those that contain it."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    stack = [(0, 0)]
    for i in range(1, len(order) + 1):
        depth = _common(strings[order[i - 1]], strings[order[i]]) if i < len(order) else -1
        begin = i - 1
        while stack and stack[-1][0] > depth:
            d, begin = stack.pop()
            yield d, order[begin:i]
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))


def farthest(own: list[bytes], other: list[bytes], length: int) -> list[int]:
    """For each member the greatest number of leading bytes of ``own`` that belong to a repeat of ``length`` bytes or
    more together with leading bytes of ``other``; -1 if there is none."""
    best, left = [-1] * len(own), len(own)
    for depth, members in prefix_intervals(own):
        need = max(0, length - depth)
        if not left or len(members) < 2 or all(best[i] >= 0 for i in members):
            continue
        agree = Counter(other[i][:need] for i in members if len(other[i]) >= need)
        for i in members:
            if best[i] < 0 and len(other[i]) >= need and agree[other[i][:need]] > 1:
                best[i] = depth
                left -= 1
    return best


def text_key(text_col: str) -> list[Column]:
    """a, b: two hashes that stand for a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("a"), F.hash(text).alias("b")]


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """a, b, text, copies."""
    return (docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(*text_key("text"), "text")
            .groupBy("a", "b").agg(F.first("text").alias("text"), F.count("*").alias("copies")))


def _keys(batch: pa.RecordBatch, places: np.ndarray) -> list[pa.Array]:
    places = pa.array(places)
    return [batch["a"].take(places), batch["b"].take(places)]


def _anchor_rows(texts: DataFrame, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [anchors(t, s) for t in as_bytes(batch["text"])]
            whose = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays([*_keys(batch, whose), pa.array(np.concatenate([f[0] for f in found]).astype(np.int32)),
                                              pa.array(np.concatenate([f[1] for f in found]))], ["a", "b", "pos", "gram"])

    return texts.mapInArrow(run, "a long, b int, pos int, gram long")


def _suffix_rows(texts: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """gram, a, b, pos, before (reversed), after: the wanted suffixes, cut to what a repeat can reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = batch["own"]
            ends = own.offsets.to_numpy()
            items = own.values
            pos, gram = items.field("pos").to_numpy(), items.field("gram").to_numpy()
            whose = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            before, after = [], []
            for i, text in enumerate(as_bytes(batch["text"])):
                for p in pos[ends[i]:ends[i + 1]].tolist():
                    before.append(text[max(0, p - s.length + s.gram):p][::-1])
                    after.append(text[p:p + s.length])
            inside = slice(ends[0], ends[-1])
            yield pa.RecordBatch.from_arrays([pa.array(gram[inside]), *_keys(batch, whose), pa.array(pos[inside]),
                                              pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["gram", "a", "b", "pos", "before", "after"])

    own = wanted.groupBy("a", "b").agg(F.collect_list(F.struct("pos", "gram")).alias("own"))
    return texts.join(own, ["a", "b"]).mapInArrow(run, "gram long, a long, b int, pos int, before binary, after binary")


def _interval_spans(suffixes: DataFrame, s: Settings) -> DataFrame:
    """a, b, begin, end: what the suffixes of each k-gram show to be repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def spans(rows: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            gram = rows["gram"].to_numpy()
            bounds = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)]
            whole = bounds if last else bounds[:-1]
            before, after, pos = rows["before"].to_pylist(), rows["after"].to_pylist(), rows["pos"].to_pylist()
            who, begins, ends = [], [], []
            for first, stop in zip(whole, whole[1:]):
                right = farthest(after[first:stop], before[first:stop], s.length)
                if max(right) < 0:
                    continue
                for i, (r, n) in enumerate(zip(right, farthest(before[first:stop], after[first:stop], s.length)), first):
                    if r >= 0:
                        who.append(i), begins.append(pos[i] - n), ends.append(pos[i] + r)
            held[:] = [] if last else [rows.slice(whole[-1])]
            return pa.RecordBatch.from_arrays([*_keys(rows, np.array(who, np.int64)), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())],
                                              ["a", "b", "begin", "end"])

        def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]

        for batch in batches:
            if batch.num_rows:
                yield spans(joined([*held, batch]), False)
        if held and held[0].num_rows:
            yield spans(held[0], True)

    return suffixes.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "a long, b int, begin int, end int")


def _window_spans(contexts: DataFrame, s: Settings) -> DataFrame:
    """The same for surroundings (with their number ``n``) too many for one task: their windows are counted, each with its
    place relative to the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            who, starts, keys = [], [], []
            for i, (b, a) in enumerate(zip(batch["before"].to_pylist(), batch["after"].to_pylist())):
                text = b[::-1] + a
                for start in range(len(text) - s.length + 1):
                    who.append(i), starts.append(start - len(b))
                    keys.append(xxhash.xxh3_128_digest(text[start:start + s.length], start + s.length - len(b)))
            places = np.array(who, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *_keys(batch, places), pa.array(starts, pa.int32()), batch["n"].take(pa.array(places))],
                                             ["window", "a", "b", "begin", "n"])

    windows = contexts.select("a", "b", "before", "after", "n").mapInArrow(run, "window binary, a long, b int, begin int, n long")
    often = stored(windows.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window"))
    return windows.join(often, "window", "left_semi").select("a", "b", "begin", (F.col("begin") + s.length).alias("end"))


def _merged_spans(suffixes: DataFrame, s: Settings) -> DataFrame:
    """The same for k-grams with very many suffixes, merged to their distinct surroundings first."""
    told = suffixes.withColumns({"c": F.xxhash64("before", "after"), "d": F.hash("before", "after")})
    own = stored(told)
    contexts = stored(own.groupBy("gram", F.col("c").alias("a"), F.col("d").alias("b")).agg(
        F.count("*").alias("n"), F.first("before").alias("before"), F.first("after").alias("after")).withColumn("pos", F.lit(0)))
    dense = contexts.groupBy("gram").agg(F.count("*").alias("kinds")).where(F.col("kinds") > s.most).select("gram")
    # two copies stand for any number
    copies = contexts.join(dense, "gram", "left_anti").withColumn("copy", F.explode(F.expr("IF(n > 1, array(1, 2), array(1))")))
    spans = _interval_spans(copies.select("gram", "a", "b", "pos", "before", "after"), s).union(_window_spans(contexts.join(dense, "gram", "left_semi"), s))
    found = stored(spans.distinct().select(F.col("a").alias("c"), F.col("b").alias("d"), "begin", "end"))
    return own.select("c", "d", "a", "b", "pos").join(found, ["c", "d"]).select(
        "a", "b", (F.col("pos") + F.col("begin")).alias("begin"), (F.col("pos") + F.col("end")).alias("end"))


def repeat_spans(texts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """a, b, spans (begin, end in bytes; they may overlap) of distinct texts that share a passage with another place."""
    found = stored(_anchor_rows(texts, s))
    # written, so that the join meets plain rows: those of a k-gram that stands everywhere can be split
    often = stored(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > s.most).alias("many")))
    wanted = found.join(often, "gram").select("gram", "a", "b", "pos", "many")
    few = _interval_spans(_suffix_rows(texts, wanted.where("NOT many"), s), s)
    many = _merged_spans(_suffix_rows(texts, wanted.where("many"), s), s)
    return few.union(many).groupBy("a", "b").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def cut_repeats(docs: DataFrame, text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """a, b, n_bytes, n_removed, n_spans, kept (bytes), kept_text of every distinct text. ``kept_text`` drops the rest of
    a character of which a part was removed."""
    texts = distinct_texts(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, copies, spans in zip(as_bytes(batch["text"]), batch["copies"].to_pylist(), batch["spans"].to_pylist()):
                n = len(text)
                gone = [(0, n)] if copies > 1 and n >= s.length else merged([(x["begin"], x["end"]) for x in spans or ()])
                edges = [0, *(e for span in gone for e in span), n]
                kept = [text[a:b] for a, b in zip(edges[::2], edges[1::2])]
                rows.append((n, sum(b - a for a, b in gone), len(gone), b"".join(kept), "".join(k.decode("utf-8", "ignore") for k in kept)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
                                             ["a", "b", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])

    return texts.join(repeat_spans(texts, s), ["a", "b"], "left").mapInArrow(
        run, "a long, b int, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string")


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = cut_repeats(docs).select("a", "b", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", *text_key("text")).join(cut, ["a", "b"]).drop("a", "b")


def without_repeats(docs: DataFrame, text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """``docs`` with the repeated passages cut from their texts; null texts stay null."""
    a, b, other_a, other_b, kept, null = fresh(docs, "_a", "_b", "_other_a", "_other_b", "_kept", "_null")
    cut = cut_repeats(docs, text_col, s).select(F.col("a").alias(other_a), F.col("b").alias(other_b), F.col("kept_text").alias(kept))
    # the texts themselves are not needed again: what is left of them comes with the join
    mine = docs.withColumns({**dict(zip((a, b), text_key(text_col))), null: F.col(text_col).isNull()}).drop(text_col)
    joined = mine.join(cut, (F.col(a) == F.col(other_a)) & (F.col(b) == F.col(other_b)))
    return joined.withColumn(text_col, F.when(~F.col(null), F.col(kept))).select(*own_columns(docs))
