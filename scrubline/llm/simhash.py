"""SimHash near-dedup: fingerprints linked within a Hamming radius, found with BK-trees.

A BK-tree keys the children of a node by their integer distance to it; a search follows
only edges within the radius of the distance to the query. One tree over all
fingerprints would have to be gathered and sent whole, so the fingerprints are cut into
shards, and each shard's tree is built and searched in one task: 64 bits make
``blocks`` blocks, and two fingerprints that differ in at most ``radius`` bits agree in
``blocks - radius`` of them at least; each choice of that many blocks, with their bits,
names a shard. So every link is found within some shard, and a shard holds only
fingerprints that agree in many bits. Shards of one fingerprint are dropped before the
trees. A shard of more than ``most`` is split into parts; the tree of each part is sent
to all parts of its shard, a task for each pair.

Copies have one fingerprint and travel as one. A tree gives only links that join parts
of its shard not yet joined, never all pairs of a group; components need no more.

Defined cases: a null or empty text has the fingerprint zero, which is linked like any
other. Repeated rows get the same answer. A null id does not take part in the smallest
id; a component without any id has a null ``component_id``.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import SLICE, as_bytes, stored, table, words
from scrubline.llm.components import components


@dataclass(frozen=True)
class Settings:
    """``shingle``: words of a shingle. ``radius``: bits that linked fingerprints differ in at most. ``blocks``: blocks
    of the 64 bits, more than ``radius``. ``most``: fingerprints in one tree."""

    shingle: int = 4
    radius: int = 4
    blocks: int = 6
    most: int = 4096


def simhash(text: bytes, shingle: int) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles, repeats included."""
    own = words(text)
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    begins = np.concatenate(([0], ends[:-shingle] + 1))
    set_in, n = np.zeros(64, np.int64), len(begins)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 16384):
        hashes = np.fromiter((digest(joined[b:e], 42) for b, e in zip(begins[at:at + 16384].tolist(), ends[shingle - 1:][at:at + 16384].tolist())),
                             np.uint64)
        set_in += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp", s: Settings = Settings()) -> DataFrame:
    """``docs`` with the fingerprint of each text, as a long with the same bits."""
    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [simhash(t, s.shingle) for begin in range(0, len(texts), SLICE) for t in as_bytes(texts.slice(begin, SLICE))]
            yield pa.array(np.array(out, np.uint64).view(np.int64))

    return docs.withColumn(out_col, run(F.col(text_col)))


class BKTree:
    """A tree of distinct fingerprints; children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values at most ``radius`` bits from ``value``."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            todo.extend(child for edge, child in self.children[at].items() if -radius <= edge - d <= radius)
        return found


def tree_links(members: list[int], queries: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links among ``members``, and between them and ``queries``, that join what was not yet joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    tree = BKTree()
    for mine, value in [(True, v) for v in members] + [(False, v) for v in queries]:
        for place in tree.within(value, radius):
            a, b = root(tree.values[place]), root(value)
            if a != b:
                parent[a] = b
                yield tree.values[place], value
        if mine:
            tree.add(value)


def shards(fps: DataFrame, s: Settings) -> DataFrame:
    """shard, lo, hi, part, fp: the parts whose pair (lo, hi) a task searches, for shards of two or more."""
    cuts = [round(64 * i / s.blocks) for i in range(s.blocks + 1)]
    bits = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]
    chosen = list(combinations(range(s.blocks), s.blocks - s.radius))
    names = [F.xxhash64(F.lit(i), *(bits[b] for b in blocks)) for i, blocks in enumerate(chosen)]
    keyed = fps.select("fp", F.explode(F.array(*names)).alias("shard"))
    sized = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / s.most).cast("int")
    mine = keyed.join(sized, "shard").select("shard", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return (mine.select("shard", "fp", "part", other)
            .select("shard", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "fp"))


def links(fps: DataFrame, s: Settings = Settings()) -> DataFrame:
    """a, b: enough links of distinct fingerprints (``fp``) to join all that are within the radius."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def runs(columns: list[np.ndarray], last: bool) -> Iterator[tuple[int, int]]:
            """Searches each run of rows with one shard, lo, hi; keeps the last run unless it is known to be whole."""
            shard, lo, hi, part, fp = columns
            new = np.flatnonzero((shard[1:] != shard[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            bounds = [0, *new.tolist(), len(shard)]
            whole = bounds if last else bounds[:-1]
            values, tree = fp.view(np.uint64).tolist(), (part == lo).tolist()
            for begin, end in zip(whole, whole[1:]):
                yield from tree_links([v for v, t in zip(values[begin:end], tree[begin:end]) if t],
                                      [v for v, t in zip(values[begin:end], tree[begin:end]) if not t], s.radius)
            held[:] = [] if last else [c[whole[-1]:] for c in columns]

        def out(found: Iterator[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(list(found), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                yield out(runs([np.concatenate(x) for x in zip(held, columns)] if held else columns, False))
        if held:
            yield out(runs(list(held), True))

    order = ["shard", "lo", "hi"]
    return (shards(fps, s).repartition(*order).sortWithinPartitions(*order, "fp").mapInArrow(search, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """id, fp, component_id of every row of ``docs``."""
    own = stored(fingerprints(docs.select(id_col, text_col), text_col, "fp", s).select(id_col, "fp"))
    distinct = own.groupBy("fp").agg(F.min(id_col).alias("least"))
    joined = components(links(distinct.select("fp"), s))
    nodes = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(nodes.join(names, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
