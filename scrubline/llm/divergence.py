"""Source divergence audit: how far the word use of the sources of a language lies apart.

Terms are counted within tasks, then per language, source and term in one shuffle by
language and term; there the terms of too few documents go and the others get an id.
What a group of a language and a source has of a block of term ids is a sorted array of
(id, count). Pair tasks co-group the arrays of two tiles of sources and merge each
unordered pair: the smaller array is searched in the larger one, by needles in order;
overlaps are priced term by term, terms of one side against the other side's share of a
term it does not have, and those absent from both by their number. Each pair is priced
once and read both ways.

A term's share of a group is ``1 + floor(10^9 * (count + 2) / (N + 2 * V))``, and two
shares are ``floor((p - q)^2 / (p + q))`` apart, all in whole numbers: the division goes
three decimal digits at a time, so that no product passes 64 bits while a group has
fewer than 10^15 terms.

A task holds the arrays of two tiles in one block, at most ``2 * tile * block`` entries
or so; blocks are dealt by hash, and their number grows with the language's terms. The
number of sources is not limited: every pair of sources of a language is in the result.

Defined cases: null language, source and text are empty ones. Groups without terms take
part: all their shares are those of absent terms. A language in which no term is frequent
enough has pairs of value 0 and no terms. Repeated rows count each time.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import as_bytes, slices, stored, table


@dataclass(frozen=True)
class Settings:
    """``least``: documents of a language that hold a term. ``top``: terms of a group in the result. ``tile``: sources
    whose arrays meet in one task. ``block``: terms of a block."""

    least: int = 10
    top: int = 10
    tile: int = 8
    block: int = 1 << 16


#: Entries of a task's counts before they are handed on.
_HELD = 1 << 17
_SCALE, _ADDED = 1_000_000_000, 2
#: What terms are made of, with A-Z in lower case; all other bytes separate them.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z in lower case."""
    return text.translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of each task's rows; ``docs`` has lang, source and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[Counter]] = {}

        def out() -> pa.RecordBatch:
            langs, sources, names, n, df = [], [], [], [], []
            for (lang, source), (counts, within) in held.items():
                langs += [lang] * len(counts)
                sources += [source] * len(counts)
                names += counts.keys()
                n += counts.values()
                df += [within[x] for x in counts]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(names, pa.binary()).cast(pa.string()),
                                               pa.array(n, pa.int64()), pa.array(df, pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in slices(batches):
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), as_bytes(batch["text"])):
                counts, within = held.setdefault((lang, source), [Counter(), Counter()])
                own = Counter(terms(text))
                counts.update(own)
                within.update(own.keys())
            if sum(len(x[0]) for x in held.values()) > _HELD:
                yield out()
        yield out()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, s: Settings) -> DataFrame:
    """lang, source, term, n (in the group), lang_n (in the language), id (of the term, in its language)."""
    alike = Window.partitionBy("lang", "term")
    counted = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (counted.withColumns({"df": F.sum("docs").over(alike), "lang_n": F.sum("n").over(alike)}).where(F.col("df") >= s.least)
            .withColumn("row", F.monotonically_increasing_id()).withColumn("id", F.min("row").over(alike))
            .select("lang", "source", "term", "n", "lang_n", "id"))


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (N), kinds (V), lang_total of every group that occurs."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kinds = kept.select("lang", "id").distinct().groupBy("lang").agg(F.count("*").alias("kinds"))
    langs = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    zero = {"total": 0, "kinds": 0, "lang_total": 0}
    return docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kinds, "lang", "left").join(langs, "lang", "left").fillna(zero)


def share(count: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kinds))."""
    below = np.int64(total + _ADDED * kinds)
    out, rest = np.divmod(count + np.int64(_ADDED), below)
    for _ in range(3):
        digits, rest = np.divmod(rest * np.int64(1000), below)
        out = out * 1000 + digits
    return out + 1


def apart(p, q):
    return (p - q) ** 2 // (p + q)


def merge(ids: np.ndarray, p: np.ndarray, p0: int, other_ids: np.ndarray, q: np.ndarray, q0: int) -> tuple[int, int]:
    """What the terms of either group add up to, and their number; ``p0`` and ``q0``: the share of an absent term."""
    if len(ids) > len(other_ids):
        ids, p, p0, other_ids, q, q0 = other_ids, q, q0, ids, p, p0
    at = np.searchsorted(other_ids, ids)
    both = at < len(other_ids)
    both[both] = other_ids[at[both]] == ids[both]
    alone = np.ones(len(other_ids), bool)
    alone[at[both]] = False
    value = apart(p[both], q[at[both]]).sum() + apart(p[~both], q0).sum() + apart(p0, q[alone]).sum()
    return int(value), len(ids) + int(alone.sum())


def pair_values(kept: DataFrame, groups: DataFrame, s: Settings) -> DataFrame:
    """lang, one, two, value of every unordered pair (one < two) of the sources of a language."""
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / s.tile).alias("tiles"))
    blocks = F.ceil(F.col("kinds") / s.block)
    known = groups.join(tiles, "lang").withColumns({"tile": F.pmod(F.xxhash64("source"), F.col("tiles")), "blocks": blocks})
    own = (kept.join(known.select("lang", "source", "blocks"), ["lang", "source"])
           .groupBy("lang", "source", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("own")))
    # a group has an array in each block, empty ones too, so that the terms of one side are priced wherever the other has none
    grid = known.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meet = grid.join(own, ["lang", "source", "block"], "left").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    none = F.array().cast("array<long>")
    sides = meet.select("lang", "block", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "source", "total", "kinds",
                        F.coalesce("own.id", none).alias("ids"), F.coalesce("own.n", none).alias("counts"))
    key = ["lang", "block", "lo", "hi"]

    def priced(rows: pa.Table) -> list[tuple]:
        out = []
        for batch in rows.to_batches():
            for i in range(batch.num_rows):
                total, kinds = batch["total"][i].as_py(), batch["kinds"][i].as_py()
                p = share(np.append(batch["counts"][i].values.to_numpy(), 0), total, kinds)
                out.append((batch["source"][i].as_py(), batch["ids"][i].values.to_numpy(), p[:-1], p[-1]))
        return out

    def run(name: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        one, two = priced(left), priced(right)
        within = name[2].as_py() == name[3].as_py()
        pairs = [(a, b) for i, a in enumerate(one) for b in one[:i]] if within else [(a, b) for a in one for b in two]
        rows = [(*sorted((a[0], b[0]), key=str.encode), *merge(*a[1:], *b[1:])) for a, b in pairs]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.table([pa.array([name[0].as_py()] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
                        names=["lang", "one", "two", "value", "held"])

    others = sides.where("tile = hi AND lo < hi").select(*(F.col(c).alias(c) for c in sides.columns))
    merged = (sides.where("tile = lo").groupBy(*key).cogroup(others.groupBy(*key))
              .applyInArrow(run, "lang string, one string, two string, value long, held long"))
    summed = merged.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"), F.sum("held").alias("held"))
    side = [groups.select("lang", "kinds", F.col("source").alias(n), F.col("total").alias(f"{n}_total")) for n in ("one", "two")]
    pairs = side[0].join(side[1].drop("kinds"), "lang").where("one < two")
    lonely = _spread(_share(F.lit(0), "one_total"), _share(F.lit(0), "two_total"))
    whole = F.when(F.col("kinds") > 0, F.col("value") + (F.col("kinds") - F.col("held")) * lonely).otherwise(0)
    return pairs.join(summed, ["lang", "one", "two"], "left").select("lang", "one", "two", whole.cast("long").alias("value"))


def _share(count: Column, total: str) -> Column:
    wide = [x.cast("decimal(20,0)") for x in (count, F.col(total) + _ADDED * F.col("kinds"))]
    return F.call_function("div", (wide[0] + _ADDED) * F.lit(_SCALE).cast("decimal(10,0)"), wide[1]) + 1


def _spread(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", s: Settings = Settings()) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by their distance, and the terms that set the source apart."""
    named = {"lang": lang_col, "source": source_col, "text": text_col}
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in named.items()))
    kept = stored(kept_terms(own, s))
    groups = stored(group_totals(own, kept))
    pairs = pair_values(kept, groups, s)
    both = (pairs.select("lang", F.col("one").alias("source"), F.col("two").alias("item"), "value")
            .union(pairs.select("lang", F.col("two").alias("source"), F.col("one").alias("item"), "value")))
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), "total").alias("p"),
                                                        _share(F.col("lang_n"), "lang_total").alias("q"))
    above = shares.where("p > q").select("lang", "source", "item", _spread(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part)) for df, part in ((both, "pair"), (above, "term"))]
    return ranked[0].union(ranked[1].where(F.col("rank") <= s.top)).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))
