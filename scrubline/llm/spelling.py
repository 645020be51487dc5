"""Spelling variant grouping: words one edit apart, found with an index of variable-length grams.

The gram dictionary is a pruned trie: a gram that more than ``often`` places of the
vocabulary share is split by its next character, up to ``longest`` characters. A word is
decomposed by reading, from its border and from each of its characters, until a gram is
rare enough. Where a gram ends is told by its own characters alone, so one edit touches
only the grams that cover its place, and all others stand in the edited word as well.
The most grams that cover one place of a word are its bound ``a``: a word one edit away
has at least all but ``a`` of its grams. Hence of the ``a + 1`` rarest grams of each of
two such words one is common to both, and lists are merged for these only: the words of
a list are compared with those of their length and of one more, in numpy, and only pairs
that are one edit apart leave the task. Words have six characters or more and grams at
most five, so that the bound never reaches the number of grams.

The dictionary is the one thing sent to all tasks. A gram enters it with more than one
in ``entries`` of all places, so it has at most ``entries`` grams of each length below
``longest``, whatever the size of the corpus. Lists of over ``most`` words are cut into
parts, and each pair of parts is a task.

Defined cases: null and empty texts have no words; a null id counts as the empty text in
``<doc_id>:<word>``. Repeated rows count each time. Of forms with equal counts the
smallest in code-point order is taken. A form has at least five times the count of its
word, so chains of forms end after fewer than 32 steps, which five doublings cover.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import slices, stored, table


@dataclass(frozen=True)
class Settings:
    """``least``: characters of a word, over ``longest``. ``count``: occurrences of a word. ``ratio``: times the count of
    its word that a form has. ``drop``: one in so many runs of a document loses a character (0: none). ``shortest``,
    ``longest``: characters of a gram. ``often``: places above which a gram is split. ``entries``: grams of one length in
    the dictionary. ``most``: words of a part of a list."""

    least: int = 6
    count: int = 5
    ratio: int = 5
    drop: int = 199
    shortest: int = 2
    longest: int = 5
    often: int = 64
    entries: int = 1 << 16
    most: int = 4096


#: Entries of a task's counts before they are handed on.
_HELD = 1 << 17


def _runs(least: int) -> re.Pattern:
    """Whole runs of letters, as they are once A-Z are in lower case, of ``least`` characters or more."""
    return re.compile("[a-zÀ-ÿ]{%d,}" % least)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """word, n of the words that occur often enough."""
    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, runs = Counter(), _runs(s.least)
        for batch in slices(batches):
            for name, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                begin = zlib.crc32(f"{name or ''}:".encode())
                for word, n in Counter(runs.findall((text or "").encode().lower().decode())).items():
                    if s.drop and (h := zlib.crc32(word.encode(), begin)) % s.drop == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < s.least:
                            continue
                    held[word] += n
            if len(held) > _HELD:
                yield out(held)
                held.clear()
        yield out(held)

    counted = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= s.count)


def _padded(word: str, s: Settings) -> str:
    return "\x01" + word + "\x00" * (s.longest - 1)


def decompose(word: str, split: set[str], s: Settings) -> tuple[list[str], int]:
    """The grams of a word, one from its border and one from each character, and the most of them that cover one character."""
    text, grams, begun = _padded(word, s), [], [0] * (len(word) + s.longest + 2)
    for at in range(len(word) + 1):
        end = at + s.shortest
        while end - at < s.longest and text[at:end] in split:
            end += 1
        grams.append(text[at:end])
        begun[at] += 1
        begun[end] -= 1
    covering, most = begun[0], 0
    for change in begun[1:len(word) + 1]:
        covering += change
        most = max(most, covering)
    return grams, most


def gram_dictionary(vocabulary: DataFrame, s: Settings = Settings()) -> set[str]:
    """The grams that are split: of each length below ``longest`` at most ``entries``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["gram", "n"])

        for batch in slices(batches):
            for word in batch["word"].to_pylist():
                text = _padded(word, s)
                for size in range(s.shortest, s.longest):
                    held.update(text[at:at + size] for at in range(len(word) + 1))
            if len(held) > _HELD:
                yield out()
                held.clear()
        yield out()

    places = vocabulary.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    counted = vocabulary.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram for r in counted.where(F.col("n") > max(s.often, places // s.entries)).select("gram").collect()}


def _one_edit(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Places of the pairs one edit apart; words in Latin-1."""
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(len(w), []).append(i)
    letters = {size: np.frombuffer(b"".join(words[i] for i in own), np.uint8).reshape(-1, size) for size, own in by_size.items()}
    for size, own in by_size.items():
        a, b = letters[size], letters.get(size + 1)
        step = max(1, (1 << 22) // (size * (len(own) + (0 if b is None else len(b)))))
        for at in range(0, len(own), step):
            some = a[at:at + step, None]
            x, y = np.nonzero((some != a).sum(axis=2, dtype=np.int32) == 1)
            for i, j in zip((x + at).tolist(), y.tolist()):
                if i < j:
                    yield own[i], own[j]
            if b is None:
                continue
            front, back = some == b[:, :size], (some == b[:, 1:])[:, :, ::-1]
            ahead = np.where(front.all(axis=2), size, front.argmin(axis=2))
            behind = np.where(back.all(axis=2), size, back.argmin(axis=2))
            for i, j in zip(*(x.tolist() for x in np.nonzero(ahead + behind >= size))):
                yield own[at + i], by_size[size + 1][j]


def near_words(vocabulary: DataFrame, s: Settings = Settings()) -> DataFrame:
    """x, y: all pairs of words (by their ``node``) that are one edit apart, each once."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(gram_dictionary(vocabulary, s))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = sent.value
        for batch in slices(batches):
            found = [decompose(w, split, s) for w in batch["word"].to_pylist()]
            whose = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            places = pa.array(whose)
            yield pa.RecordBatch.from_arrays([pa.array([g for f in found for g in f[0]], pa.string()), batch["node"].take(places),
                                              pa.array([f[1] for f in found], pa.int32()).take(places)], ["gram", "node", "bound"])

    rows = vocabulary.select("node", "word").mapInArrow(grams, "gram string, node long, bound int")
    often = rows.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.row_number().over(Window.partitionBy("node").orderBy("n", "gram"))
    few = rows.join(often, "gram").withColumn("rank", rarest).where("rank <= bound + 1").select("gram", "node").distinct()
    lists = stored(few.join(vocabulary.select("node", "word"), "node").select("gram", "node", "word"))
    sized = lists.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / s.most)
    split = lists.join(sized, "gram").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    other = F.expr("CASE WHEN parts = 1 THEN array(part) ELSE filter(sequence(0L, parts - 1), x -> x <> part) END")
    dealt = (split.withColumn("other", F.explode(other))
             .select("gram", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "word"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(rows: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            columns = [rows[c].to_numpy(zero_copy_only=False) for c in ("gram", "lo", "hi")]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            bounds = [0, *new.tolist(), rows.num_rows]
            whole = bounds if last else bounds[:-1]
            node, words = rows["node"].to_numpy(), [w.encode("latin-1") for w in rows["word"].to_pylist()]
            found = [(node[a + i], node[a + j]) for a, b in zip(whole, whole[1:]) for i, j in _one_edit(words[a:b])]
            held[:] = [] if last else [rows.slice(whole[-1])]
            pairs = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
            pairs = np.unique(pairs, axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])

        for batch in batches:
            if batch.num_rows:
                yield out(pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch, False)
        if held and held[0].num_rows:
            yield out(held[0], True)

    order = ["gram", "lo", "hi"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(merge, "x long, y long").distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    vocabulary = stored(word_counts(docs, id_col, text_col, s).withColumn("node", F.monotonically_increasing_id()))
    pairs = near_words(vocabulary, s)
    both = pairs.union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    other = vocabulary.select(F.col("node").alias("y"), F.struct((-F.col("n")).alias("less"), "word", F.col("node").alias("form")).alias("near"))
    near = both.join(other, "y").groupBy(F.col("x").alias("node")).agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    formed = -F.col("best.less") >= s.ratio * F.col("n")
    words = stored(vocabulary.join(near, "node", "left").select(
        "word", "n", "node", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("best")))
    chain = stored(words.where("best IS NOT NULL").select("node", F.col("best.form").alias("root"), F.col("best.word").alias("name")))
    for _ in range(5):
        after = chain.select(F.col("node").alias("root"), F.col("root").alias("far"), F.col("name").alias("far_name"))
        longer = chain.join(after, "root", "left")
        if longer.where("far IS NOT NULL").isEmpty():
            break
        chain = stored(longer.select("node", F.coalesce("far", "root").alias("root"), F.coalesce("far_name", "name").alias("name")))
    return words.join(chain.select("node", F.col("name").alias("root")), "node", "left").select(
        "word", F.col("best.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.less")).alias("form_n"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
