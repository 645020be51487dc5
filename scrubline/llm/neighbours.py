"""Nearest neighbours by a block matrix join of int8 product tiles.

Queries and candidates are packed into blocks of a fixed number of vectors. Each pair of
blocks is a tile: the product of the int8 codes gives all inner products of the tile
with a bound on their error, so that a pair whose upper bound lies below the lower
bound of the k-th best of its query cannot be among the nearest and goes. The pairs that
survive are computed again in double precision, some at a time, and the k best of each
query leave the tile. The answers of the tiles are merged by heaps. Where a product may
leave the range of doubles the bounds say nothing, and all pairs of the query survive.

Every query meets every candidate, so the answer is exact. A block goes to the tiles of
its row or column only, as one row of bytes; the number of tiles that a block of
candidates meets is that of the query blocks. Nothing is broadcast or collected.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component
take no part, neither as query nor as candidate. Vectors meet those of equal length only.
Rows with a null id take no part. Rows that share an id are candidates each, but none of
them for a query of that id; repeated queries give one answer each. Fewer than k
candidates give all. Ties go to the smaller id, those of infinite products as well; a
product that is not a number comes last. An empty table gives no row.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import table


@dataclass(frozen=True)
class Settings:
    """``k``: neighbours. ``queries``, ``candidates``: vectors of a block, about."""

    k: int = 20
    queries: int = 1024
    candidates: int = 4096


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows, scale of each, length of each and of what the codes miss."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1  # a subnormal row
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x, axis=1), np.linalg.norm(x - q * scale[:, None], axis=1)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one fixed order."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (x * y).sum(axis=1)
    out[np.isnan(out)] = -np.inf
    return out


#: Pairs computed again at a time; products of lengths above which the bounds are not used.
_SOME, _WIDE = 1 << 16, 1e300


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """(place of the query, its k nearest as (score, id), best first)."""
    with np.errstate(over="ignore", invalid="ignore"):
        likely = _likely(qid, q, cid, c, k)
    rows, cols = np.nonzero(likely)
    scores = np.concatenate([np.zeros(0), *(exact(q[rows[a:a + _SOME]], c[cols[a:a + _SOME]]) for a in range(0, len(rows), _SOME))])
    order = np.lexsort((cid[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    begins = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else []
    for begin, stop in zip(begins, [*begins[1:], len(rows)]):
        stop = min(stop, begin + k)
        yield int(rows[begin]), list(zip(scores[begin:stop].tolist(), cid[cols[begin:stop]].tolist()))


def _likely(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Which pairs of a tile may be among the k nearest of their query."""
    qc, qs, qn, qe = codes(q)
    cc, cs, cn, ce = codes(c)
    wide = ~(qn * cn.max() < _WIDE)
    other = qid[:, None] != cid
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # holds sums of int8 products exactly
    near = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, None] * cs
    # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|, and a little for rounding
    error = qe[:, None] * cn + (qn + qe)[:, None] * ce
    error += 1e-12 * (qn[:, None] * cn)
    near[~other] = -np.inf
    low = near - error
    if low.shape[1] > k:
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    else:
        floor = np.full(len(q), -np.inf)
    return ((near + error >= floor[:, None]) | wide[:, None]) & other


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, x (doubles) of the vectors that take part."""
    x = F.col("x")
    whole = F.expr("NOT exists(x, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity')) AND exists(x, v -> v <> 0)")
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
            .where(F.col("id").isNotNull() & x.isNotNull() & whole).withColumn("dim", F.size("x")))


def _sizes(vectors: DataFrame, size: int) -> DataFrame:
    """dim, blocks: one row for each length of vectors."""
    return vectors.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))


def _blocks(vectors: DataFrame, sizes: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """dim, block, ids, rows: vectors packed as bytes, about ``size`` in each block."""
    dealt = vectors.join(F.broadcast(sizes), "dim").withColumn("block", F.pmod(F.xxhash64("id", "x"), F.col("blocks")).cast("int"))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        ids, x = rows["id"].to_numpy(), rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        order = sorted(range(len(ids)), key=lambda i: (ids[i], x[i].tobytes()))  # the same whatever order rows came in
        values = [[key[0].as_py()], [key[1].as_py()], [ids[order].tobytes()], [x[order].tobytes()]]
        return pa.table([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["dim", *names])

    return dealt.select("dim", "block", "id", "x").groupBy("dim", "block").applyInArrow(
        pack, f"dim int, {names[0]} int, {names[1]} binary, {names[2]} binary")


def nearest(queries: DataFrame, candidates: DataFrame, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest candidates of each query by inner product. Both tables as
    ``usable`` gives them."""
    sizes = _sizes(candidates, s.candidates)
    q = _blocks(queries, _sizes(queries, s.queries), ("q_block", "q_ids", "q"))
    c = _blocks(candidates, sizes, ("c_block", "c_ids", "c"))
    # each block of queries is sent to every block of candidates of its length, as named tiles
    wanted = q.join(F.broadcast(sizes), "dim").withColumn("c_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    tiles = wanted.join(c, ["dim", "c_block"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch["dim"][r].as_py()
                qid, cid = (np.frombuffer(batch[n][r].as_py(), np.int64) for n in ("q_ids", "c_ids"))
                own, all_ = (np.frombuffer(batch[n][r].as_py(), np.float64).reshape(-1, dim) for n in ("q", "c"))
                found = [(dim, int(batch["q_block"][r].as_py()) << 32 | p, int(qid[p]), v, score) for p, best in tile(qid, own, cid, all_, s.k) for score, v in best]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], ["dim", "place", "query_id", "vec_id", "score"])

    found = tiles.mapInArrow(answer, "dim int, place long, query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by query; a heap keeps the k best of the one at hand."""
        now, heap = None, []

        def rows(key: tuple | None, heap: list) -> list[tuple]:
            return [(key[2], rank, -v, score) for rank, (score, v) in enumerate(sorted(heap, reverse=True), 1)] if key else []

        for batch in batches:
            out = []
            for dim, place, query, v, score in zip(*(batch[n].to_pylist() for n in ("dim", "place", "query_id", "vec_id", "score"))):
                if (dim, place, query) != now:
                    out += rows(now, heap)
                    now, heap = (dim, place, query), []
                if len(heap) < s.k:
                    heapq.heappush(heap, (score, -v))
                else:
                    heapq.heappushpop(heap, (score, -v))
            yield _answers(out)
        yield _answers(rows(now, heap))

    return (found.repartition("dim", "place").sortWithinPartitions("dim", "place")
            .mapInArrow(merge, "query_id long, rank int, vec_id long, score double"))


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["query_id", "rank", "vec_id", "score"])


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(vectors.where("id % 20 = 0"), vectors)
