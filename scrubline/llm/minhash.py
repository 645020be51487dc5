"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets.

A signature has a 16-bit piece of the least hash for each of ``chunks * size`` hash
functions; its distance is the number of places that differ. Two signatures at distance
``radius`` or less, cut into ``chunks`` chunks, differ in ``errors`` places at most in
one of them (``radius`` is the largest distance for which that holds). So for each chunk
all choices of ``errors`` places are left out in turn, and what remains of the chunk,
with its place, is a key: signatures within the radius share a key, without exception.
Sets with a Jaccard similarity J differ in each place with probability 1 - J; with the
default settings two sets at the threshold lie beyond the radius with probability 2e-8.

A key with two or more sets is a bucket. A task searches a bucket (or a pair of parts of
a large one) breadth first and gives only those pairs within the radius that join what
is not yet joined, never all pairs. The components of these are candidates; their full
sets are brought together once and searched the same way, now by the exact test
``100 * intersection >= percent * union``. Components of what passes are the groups. As
a search compares a member with all that have not been reached, not with a leader only,
no link is lost; a candidate component of many shingles is cut into parts by weight, and
each pair of parts is a task.

Equal sets are one class and travel as one. Sets are held as 64-bit hashes of their
shingles (XXH64); classes are told apart by 128 bits over these.

Defined cases: a null text, an empty one and one without words have the empty set, which
is linked with nothing; such rows are their own component. One or two words are one
shingle. Repeated rows get the same answer. Null ids do not count as smallest; a
component without any id has a null ``component_id`` and keeps all of its rows.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from scrubline.llm.common import as_bytes, slices, stored, table, words
from scrubline.llm.components import components
from scrubline.llm.repeats import distinct_texts, text_key


@dataclass(frozen=True)
class Settings:
    """``shingle``: words of a shingle. ``percent``: least similarity of a link. ``chunks``, ``size``: chunks of a
    signature and places of each. ``errors``: places of a chunk that may differ, ``size`` less 3 at least. ``most``:
    signatures of a part of a bucket. ``weight``: shingles of a part of a candidate component."""

    shingle: int = 3
    percent: int = 85
    chunks: int = 6
    size: int = 5
    errors: int = 2
    most: int = 4096
    weight: int = 1 << 18

    @property
    def radius(self) -> int:
        return self.chunks * (self.errors + 1) - 1


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    own = words(text)
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    if len(own) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    begins = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[b:e]) for b, e in zip(begins, ends[shingle - 1:].tolist())), np.uint64, len(begins)))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each hash function 16 bits of the least hash."""
    least = np.full(len(flips), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        h = (shingles[at:at + 2048, None] ^ flips) * factors
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, h.min(axis=0))
    return ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.uint16)


def signed(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """id, a, b (hashes of the text), n (shingles), members (128 bits that stand for the set; null if empty), sig."""
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("a", LongType()), StructField("b", IntegerType()),
                         StructField("n", LongType()), StructField("members", BinaryType()), StructField("sig", BinaryType())])
    flips, factors = _multipliers(s.chunks * s.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, members, sigs = [], [], []
            for text in as_bytes(batch["text"]):
                own = shingle_set(text, s.shingle)
                n.append(len(own))
                members.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sigs.append(signature(own, flips, factors).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["a"], batch["b"], pa.array(n, pa.int64()), pa.array(members, pa.binary()),
                                              pa.array(sigs, pa.binary())], ["id", "a", "b", "n", "members", "sig"])

    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), *text_key(text_col)).mapInArrow(run, schema)


def keys(classes: DataFrame, s: Settings) -> DataFrame:
    """key, node: what is left of each chunk when ``errors`` of its places are left out, with the chunk and the choice."""
    kept = list(combinations(range(s.size), s.size - s.errors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sigs = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint16).astype(np.int64).reshape(-1, s.chunks, s.size)
            out = np.empty((len(sigs), s.chunks, len(kept)), np.int64)
            for choice, places in enumerate(kept):
                out[:, :, choice] = np.arange(s.chunks) * len(kept) + choice
                for place in places:
                    out[:, :, choice] = out[:, :, choice] << 16 | sigs[:, :, place]
            nodes = np.repeat(batch["node"].to_numpy(), s.chunks * len(kept))
            yield pa.RecordBatch.from_arrays([pa.array(out.ravel()), pa.array(nodes)], ["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that join all of ``n`` members that a chain of links joins, none twice. ``near(i, rest)``: which of ``rest`` are linked with i."""
    rest = np.arange(n)
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = near(i, rest)
            for j in rest[hit].tolist():
                yield i, j
                todo.append(j)
            rest = rest[~hit]


def _sized(n: np.ndarray, i: int, rest: np.ndarray, percent: int) -> np.ndarray:
    """Which sizes allow a link with that of ``i``."""
    return 100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])


def signature_links(sigs: np.ndarray, n: np.ndarray, s: Settings) -> Iterator[tuple[int, int]]:
    def near(i: int, rest: np.ndarray) -> np.ndarray:
        hit = _sized(n, i, rest, s.percent)
        some = rest[hit]
        hit[hit] = (sigs[some] != sigs[i]).sum(axis=1) <= s.radius
        return hit

    return _forest(len(n), near)


def set_links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links of sets (none empty) with ``100 * intersection >= percent * union``."""
    n = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(n)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(int(codes.max()) + 1, bool)
    held: list = [None, None, None]  # members whose codes lie together, the codes, where each begins

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        if held[0] is None or len(rest) * 2 < len(held[0]):
            held[:] = [rest, np.concatenate([codes[ends[j] - n[j]:ends[j]] for j in rest]), np.cumsum(n[rest]) - n[rest]]
        own = codes[ends[i] - n[i]:ends[i]]
        marked[own] = True
        common = np.add.reduceat(marked[held[1]], held[2], dtype=np.int64)[np.searchsorted(held[0], rest)]
        marked[own] = False
        return 100 * common >= percent * (n[rest] + n[i] - common)

    return _forest(len(sets), near)


def _in_groups(rows: DataFrame, group: list[str], links: Callable[[pa.RecordBatch], Iterator[tuple[int, int]]]) -> DataFrame:
    """x, y: the links that ``links`` finds among the rows of each group, as their ``node``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(rows: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            columns = [rows[c].to_numpy() for c in group]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            bounds = [0, *new.tolist(), rows.num_rows]
            whole = bounds if last else bounds[:-1]
            node = rows["node"].to_numpy()
            found = [(node[a + i], node[a + j]) for a, b in zip(whole, whole[1:]) if b - a > 1 for i, j in links(rows.slice(a, b - a))]
            held[:] = [] if last else [rows.slice(whole[-1])]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])

        for batch in batches:
            if batch.num_rows:
                yield out(pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch, False)
        if held and held[0].num_rows:
            yield out(held[0], True)

    return rows.repartition(*group).sortWithinPartitions(*group, "node").mapInArrow(run, "x long, y long").distinct()


def _part_pairs(rows: DataFrame, parts: Column) -> DataFrame:
    """``rows`` once for each pair (lo, hi) of parts of its group that holds it; (0, 0) where there is one part only."""
    split = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    other = F.expr("CASE WHEN parts = 1 THEN array(part) ELSE filter(sequence(0L, parts - 1), x -> x <> part) END")
    return (split.withColumn("other", F.explode(other))
            .withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("parts", "part", "other"))


def candidates(classes: DataFrame, s: Settings) -> DataFrame:
    """x, y: enough pairs of classes within the radius to join all that are."""
    keyed = keys(classes, s)
    sized = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    rows = keyed.join(sized, "key").join(classes.select("node", "n", "sig"), "node")

    def links(rows: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        sigs = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint16).reshape(rows.num_rows, -1)
        return signature_links(sigs, rows["n"].to_numpy(), s)

    return _in_groups(_part_pairs(rows, F.ceil(F.col("members") / s.most)).select("key", "lo", "hi", "node", "n", "sig"), ["key", "lo", "hi"], links)


def confirmed(docs: DataFrame, text_col: str, classes: DataFrame, joined: DataFrame, s: Settings) -> DataFrame:
    """x, y: enough links of full sets to join all that are linked within a candidate component."""
    mine = classes.select("node", "n", "rep").join(joined, "node")
    weights = mine.groupBy("root").agg(F.sum("n").alias("total"))
    members = mine.join(weights, "root").select("root", "node", "total", "rep.a", "rep.b")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = pa.array([shingle_set(t, s.shingle).tobytes() for t in as_bytes(batch["text"])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["root"], batch["node"], batch["total"], own], ["root", "node", "total", "own"])

    def links(rows: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        return set_links([np.frombuffer(x, np.uint64) for x in rows["own"].to_pylist()], s.percent)

    rows = (distinct_texts(docs, text_col).join(members, ["a", "b"]).select("root", "node", "total", "text")
            .mapInArrow(sets, "root long, node long, total long, own binary"))
    return _in_groups(_part_pairs(rows, F.ceil(F.col("total") / s.weight)).select("root", "lo", "hi", "node", "own"), ["root", "lo", "hi"], links)


def shingle_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """id, n_shingles, component_id, kept of every row of ``docs``."""
    own = stored(signed(docs, id_col, text_col, s))
    classes = stored(own.where("n > 0").groupBy("members").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"),
                                                             F.min(F.struct("a", "b")).alias("rep"))
                     .withColumn("node", F.monotonically_increasing_id()))
    joined = components(candidates(classes, s).select(F.col("x").alias("a"), F.col("y").alias("b")))
    linked = components(confirmed(docs, text_col, classes, joined, s).select(F.col("x").alias("a"), F.col("y").alias("b")))
    nodes = classes.select("members", "node", "least").join(linked, "node", "left").select("members", "least", F.coalesce("root", "node").alias("root"))
    names = nodes.groupBy("root").agg(F.min("least").alias("smallest"))
    named = own.select("id", "n", "members").join(nodes.join(names, "root").select("members", "smallest"), "members", "left")
    component = F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("id"))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.col("id").eqNullSafe(component).alias("kept"))


def op11_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return shingle_groups(table(spark, sf_dir, "documents"))
