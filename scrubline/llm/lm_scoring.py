"""Scores of texts under a hashed maximum-entropy language model.

The probability of a word is that of its class, given the words before it, times that of
the word within its class. The class is a softmax over hashed features of the context:
the word before (a bigram), the two words before (a trigram) and, skipping one, the word
before that. Within a class the only feature is the word itself, whose best weight is the
logarithm of its count; counts are smoothed as in the base score, and each class keeps a
share for words never seen, so the model is a distribution over all texts.

Frequent words are put into classes by what stands before them; the rest, seen or not, by
their form. Texts are tokenised once to count their words and once to numbers, which are
written and read from then on. Training goes once through all training texts, in rounds,
each over a part of them that the id alone decides: at the weights as sent, tasks add up
for each feature and class how often the class followed and how often the model expected
it to; Spark adds these sums, and each weight takes a step along its gradient, scaled to
the logarithm of observed over expected. A sum does not depend on how texts are laid out
in tasks, so neither do the weights, but for rounding.

What travels: counts of words, merged within tasks, grow with the corpus and are joined,
not broadcast. A bounded part of the vocabulary (``lexicon`` words, some 10 MB) and the
weights (``rows`` x classes in 4 bytes, 7 MB) are broadcast; the rows used grow with the
training tokens up to that. A word beyond the lexicon takes its class from its form, and
its count from a join; rare words are not hot keys.

Defined cases: null and empty texts are one end token. A null id is held out, as crc32 of
the empty text is divisible by ten. Repeated rows are scored each for itself and count
each in training. Without any training text every word is unseen and classes are
uniform. An empty table gives no row.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import as_bytes, fold, slices, stored, table, words


@dataclass(frozen=True)
class Settings:
    """``lexicon``: words known by number; ``heads``: those with a class by context; ``groups``: such classes.
    ``rows``: hashed rows of weights at most, one for each ``tokens`` of training. ``rounds``: parts of the training texts,
    one after the other. ``rate``: of a step; ``prior``: occurrences of a feature that hold its weights back. ``batch``:
    tokens handled at a time. ``alpha``: smoothing of counts."""

    lexicon: int = 131072
    heads: int = 2048
    groups: int = 24
    contexts: int = 256
    rows: int = 1 << 15
    tokens: int = 64
    rounds: int = 6
    rate: float = 0.6
    prior: float = 80.0
    batch: int = 32768
    alpha: float = 0.1


#: Classes by form.
FORMS = 32
#: The end of a text; no word is empty.
END = b""


def form(word: bytes) -> int:
    """Class of a word that has none by context: how it ends, and a hash of its letters' kind."""
    bare = word.rstrip(b".,;:!?)\"'") or word
    tail = word[len(bare):len(bare) + 1]
    kind = 0 if not tail else 1 if tail == b"," else 2 if tail == b"." else 3
    if word.isascii():
        return kind * 8 + zlib.crc32(bare[-2:]) % 4
    return kind * 8 + 4 + zlib.crc32(bytes(b for b in bare if b >= 128)[:2]) % 4


def count_words(texts: DataFrame) -> DataFrame:
    """word, c of all tokens, ends included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return batch

        for batch in slices(batches):
            for text in as_bytes(batch["text"]):
                seen.update(words(text))
            seen[END] += batch.num_rows
            if len(seen) > 300_000:
                yield out()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def numbered(texts: list[bytes], number: dict[bytes, int]) -> tuple[list[np.ndarray], list[list[bytes]]]:
    """Numbers of the tokens of each text, its end included, and its words that have none: these are numbered by form,
    from ``len(number)`` on."""
    size = len(number)
    end, ids, rest = number.get(END, size + form(END)), [], []
    for text in texts:
        own = words(text)
        new = np.empty(len(own) + 1, np.int32)
        new[-1] = end
        new[:-1] = np.fromiter(map(number.get, own, repeat(-1)), np.int32, len(own))
        missing = np.flatnonzero(new < 0).tolist()
        unknown = [own[i] for i in missing]
        new[missing] = [size + form(w) for w in unknown]
        ids.append(new)
        rest.append(unknown + [END] * (end >= size))
    return ids, rest


def laid_out(ids: list[np.ndarray], blank: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row, two blanks before each, and where each begins, with the end of all."""
    sizes = [len(x) + 2 for x in ids]
    begins = np.cumsum([0, *sizes])
    out = np.full(begins[-1], blank, np.int64)
    for begin, x in zip(begins, ids):
        out[begin + 2:begin + 2 + len(x)] = x
    return out, begins


def context_rows(before: np.ndarray, second: np.ndarray, rows: int) -> np.ndarray:
    """The rows of the features of contexts: of the word before, of the word before that, of both."""
    bits = np.uint64(64 - (rows.bit_length() - 1))
    with np.errstate(over="ignore"):
        one = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        two = (second.astype(np.uint64) + np.uint64(0x27D4EB2F165667C5)) * np.uint64(0xD6E8FEB86659FD93)
        both = (one ^ (one >> np.uint64(29))) + two * np.uint64(0xA24BAED4963EE407)
        return np.stack([((m ^ (m >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> bits).astype(np.int64) for m in (one, two, both)])


@dataclass
class Model:
    settings: Settings
    number: dict[bytes, int]  # of the known words, the most frequent first
    log_count: np.ndarray  # log10(c + alpha) by number; 0 for forms, whose counts are joined
    class_of: np.ndarray  # by number
    log_mass: np.ndarray  # log10 of the smoothed count of each class
    bias: np.ndarray
    weights: np.ndarray

    def plain(self, *left_out: str) -> dict:
        """What is sent to tasks: numbers, arrays and a dictionary, no object of a class of this library."""
        own = {**self.__dict__, "settings": vars(self.settings)}
        return {k: None if k in left_out else v for k, v in own.items()}

    @staticmethod
    def of(plain: dict) -> "Model":
        return Model(**{**plain, "settings": Settings(**plain["settings"])})

    @property
    def blank(self) -> int:
        return len(self.class_of)

    def contexts(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places that hold a token, the number of the context of each, and the rows of the features of each context, taken once."""
        token = np.ones(len(ids), bool)
        token[begins[:-1]] = token[begins[:-1] + 1] = False
        at = np.flatnonzero(token)
        span = self.blank + 1
        pairs, which = np.unique(ids[at - 1] * span + ids[at - 2], return_inverse=True)
        return at, which, context_rows(pairs // span, pairs % span, len(self.weights))

    def logits(self, rows: np.ndarray) -> np.ndarray:
        z = self.weights[rows[0]]
        for own in rows[1:]:
            z += self.weights[own]
        z += self.bias
        return z


def shares(z: np.ndarray) -> np.ndarray:
    """Softmax of the rows, in place."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def add_sums(model: Model, ids: np.ndarray, begins: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> None:
    """Adds for each class and row how often the class occurs with the features of the row, and how often the model expects
    it to. Each context is looked at once, with the number of its places."""
    at, which, rows = model.contexts(ids, begins)
    size, batch = len(model.weights), model.settings.batch
    target = model.class_of[ids[at]] * size
    for feature in rows:
        seen += np.bincount(target + feature[which], minlength=seen.size).reshape(seen.shape)
    times = np.bincount(which, minlength=rows.shape[1]).astype(np.float32)
    for begin in range(0, rows.shape[1], batch):
        own = rows[:, begin:begin + batch]
        chance = shares(model.logits(own))
        chance *= times[begin:begin + batch, None]
        for of_class, column in zip(expected, np.ascontiguousarray(chance.T)):
            for feature in own:
                of_class += np.bincount(feature, column, minlength=size)


def steps(seen: np.ndarray, expected: np.ndarray, bias: np.ndarray, s: Settings) -> np.ndarray:
    """The change of the weights of some rows; little evidence changes little."""
    held = s.prior * np.exp(bias)
    return s.rate * (np.log(seen + held + 1e-9) - np.log(expected + held + 1e-9))


def groups_by_context(near: np.ndarray, groups: int) -> np.ndarray:
    """Class of each word from how often each hashed word stands before it: k-means on square roots of shares."""
    x = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
    centres = x[np.linspace(0, len(x) - 1, min(groups, len(x))).astype(int)] if len(x) else x
    own = np.zeros(len(x), np.int64)
    for _ in range(25 if len(x) else 0):
        own = (x @ centres.T - (centres ** 2).sum(axis=1) / 2).argmax(axis=1)
        held = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, i], minlength=len(centres)) for i in range(x.shape[1])], axis=1)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return own


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in batch["ids"].to_pylist()]


def _contexts(data: DataFrame, blank: int, heads: int, s: Settings) -> np.ndarray:
    """How often each hashed word stands before each of the most frequent words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(heads * s.contexts, np.int64)
        for batch in slices(batches):
            ids, _ = laid_out(_arrays(batch), blank)
            here, before = ids[1:], ids[:-1] * 0x9E3779B1 % (1 << 32) * s.contexts >> 32
            known = here < heads
            cells += np.bincount(here[known] * s.contexts + before[known], minlength=len(cells))
        found = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(cells[found])], ["cell", "n"])

    out = np.zeros(heads * s.contexts)
    sums = data.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out[sums.cell.to_numpy(np.int64)] = sums.n.to_numpy()  # at most heads * contexts rows
    return out.reshape(heads, s.contexts)


def _form_masses(counts: DataFrame, sent, heads: int, s: Settings) -> np.ndarray:
    """Smoothed counts of the classes by form: the words without a class by context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, mass = sent.value, np.zeros(FORMS)
        for batch in batches:
            for word, c in zip(batch["word"].to_pylist(), batch["c"].to_pylist()):
                if number.get(word, heads) >= heads:
                    mass[form(word)] += c + s.alpha
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FORMS)), pa.array(mass)], ["form", "mass"])

    sums = counts.mapInArrow(run, "form long, mass double").groupBy("form").agg(F.sum("mass").alias("mass")).toPandas()
    out = np.full(FORMS, s.alpha)  # what was never seen
    out[sums.form.to_numpy(np.int64)] += sums.mass.to_numpy()
    return out


#: Rows of weights that travel as one, and tokens whose contexts are looked at together.
_SPAN, _TOGETHER = 512, 1 << 20


def _round(data: DataFrame, model: Model) -> np.ndarray:
    """The weights after a step along the gradient over the texts of ``data``."""
    sent = data.sparkSession.sparkContext.broadcast(model.plain("number", "log_count", "log_mass"))
    rows, classes = model.weights.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of(sent.value)
        seen, expected, held = np.zeros((classes, rows), np.int64), np.zeros((classes, rows)), []
        for batch in slices(batches):
            held += _arrays(batch)
            if sum(map(len, held)) > _TOGETHER:
                add_sums(own, *laid_out(held, own.blank), seen, expected)
                held = []
        if held:
            add_sums(own, *laid_out(held, own.blank), seen, expected)
        spans = [at for at in range(0, rows, _SPAN) if seen[:, at:at + _SPAN].any()]
        yield pa.RecordBatch.from_arrays([pa.array(spans, pa.int32()), *(pa.array([x[:, a:a + _SPAN].astype(np.float32).tobytes() for a in spans], pa.binary())
                                                                         for x in (seen, expected))], ["span", "seen", "expected"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """New weights of the spans of a partition, whose sums are taken as they come."""
        added: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for span, *new in zip(*(batch[n].to_pylist() for n in ("span", "seen", "expected"))):
                new = [np.frombuffer(x, np.float32).astype(np.float64) for x in new]
                added[span] = [a + b for a, b in zip(added[span], new)] if span in added else new
        given = Model.of(sent.value)
        out = [given.weights[a:a + _SPAN] + steps(*(x.reshape(classes, -1).T for x in v), given.bias, given.settings) for a, v in added.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(added), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in out], pa.binary())], ["span", "weights"])

    weights = model.weights.copy()
    new = (data.select("ids").mapInArrow(sums, "span int, seen binary, expected binary").repartition("span").mapInArrow(step, "span int, weights binary"))
    for span, own in new.toLocalIterator():  # all together as large as the weights
        weights[span:span + _SPAN] = np.frombuffer(own, np.float32).reshape(-1, classes)
    sent.unpersist()
    return weights


def encoded(texts: DataFrame, sent) -> DataFrame:
    """row, doc_id, ids (4 bytes a token), rest (words beyond the lexicon, with their number), by turn, as a written table."""
    rest_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, row = sent.value, TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            ids, rest = numbered(as_bytes(batch["text"]), number)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows)), batch["doc_id"], batch["turn"], pa.array([x.tobytes() for x in ids], pa.binary()),
                                              pa.array([[{"word": w, "n": n} for w, n in Counter(r).items()] for r in rest], rest_type)],
                                             ["row", "doc_id", "turn", "ids", "rest"])
            row += batch.num_rows

    return stored(texts.select("doc_id", "turn", "text").mapInArrow(
        run, "row long, doc_id long, turn int, ids binary, rest array<struct<word: binary, n: int>>"), "turn")


def fit(data: DataFrame, sent, counts: DataFrame, known: list[int], n: int, s: Settings) -> Model:
    """The model of ``data`` (ids, turn: the round it is used in, -1: none), whose words have ``counts``; ``sent`` has the
    numbers of the known ones, ``known`` their counts, and there are ``n`` tokens."""
    c, heads, size = np.array(known, np.float64), min(s.heads, len(known)), len(known)
    number = sent.value
    group = groups_by_context(_contexts(data.where("turn >= 0"), size + FORMS, heads, s), s.groups)
    masses = np.concatenate((np.bincount(group, c[:heads] + s.alpha, minlength=s.groups), _form_masses(counts, sent, heads, s)))
    class_of = np.concatenate((group, [s.groups + form(w) for w in list(number)[heads:]], s.groups + np.arange(FORMS))).astype(np.int64)
    log_mass = np.log10(np.maximum(masses, s.alpha))
    bias = np.where(masses > 0, np.log(np.maximum(masses, s.alpha)) - np.log(masses.sum()), -50.0).astype(np.float32)
    rows = min(s.rows, max(_SPAN, 1 << max(0, n // s.tokens).bit_length()))
    model = Model(s, number, np.concatenate((np.log10(c + s.alpha), np.zeros(FORMS))), class_of, log_mass, bias, np.zeros((rows, len(bias)), np.float32))
    for turn in range(s.rounds if n else 0):
        model.weights = _round(data.where(F.col("turn") == turn), model)
    return model


def _scored(data: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, n_tokens, n_lexicon, log_counts (of the lexicon's words), classes."""
    sent = data.sparkSession.sparkContext.broadcast(model.plain("number"))
    size = len(model.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of(sent.value)
        batch_size = own.settings.batch
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            ids, begins = laid_out(_arrays(batch), own.blank)
            at, which, rows = own.contexts(ids, begins)
            kind = own.class_of[ids[at]]
            order = np.argsort(which, kind="stable")  # the places of a batch of contexts stand together
            bounds = np.searchsorted(which[order], np.arange(0, rows.shape[1] + batch_size, batch_size))
            classes = np.zeros(len(ids))
            for begin, first, end in zip(range(0, rows.shape[1], batch_size), bounds, bounds[1:]):
                some = order[first:end]
                chance = shares(own.logits(rows[:, begin:begin + batch_size]))[which[some] - begin, kind[some]]
                classes[at[some]] = np.log10(np.maximum(chance, 1e-30)) - own.log_mass[kind[some]]
            known, counted = np.zeros(len(ids)), np.zeros(len(ids))
            known[at], counted[at] = ids[at] < size, own.log_count[ids[at]]
            sums = [np.add.reduceat(x, begins[:-1]) for x in (classes, known, counted)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(np.diff(begins) - 2), pa.array(sums[1].astype(np.int64)),
                                              pa.array(sums[2]), pa.array(sums[0])], ["row", "doc_id", "n_tokens", "n_lexicon", "log_counts", "classes"])

    return data.select("row", "doc_id", "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, n_lexicon long, log_counts double, classes double")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    learnt = fold("doc_id", folds) != 0
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "turn", F.when(learnt, F.pmod(F.xxhash64("doc_id"), F.lit(s.rounds))).otherwise(-1).cast("int"))
    counts = stored(count_words(texts.where("turn >= 0")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = counts.orderBy(F.desc("c"), "word").limit(s.lexicon).toPandas()  # bounded by the setting
    sent = docs.sparkSession.sparkContext.broadcast({bytes(w): i for i, w in enumerate(known.word)})
    data = encoded(texts, sent)
    model = fit(data, sent, counts, known.c.tolist(), n, s)
    rest = data.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.n").join(counts, "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_rest"),
                                   F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + s.alpha)).alias("log_rest"))
    log_counts = F.col("log_counts") + F.coalesce("log_rest", F.lit(0.0))
    return (_scored(data, model).join(rest, "row", "left")
            .select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "n_tokens",
                    (F.col("n_lexicon") + F.coalesce("n_rest", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                    (log_counts - F.col("n_tokens") * float(np.log10(n + s.alpha * (v + 1)))).alias("base_score"),
                    (log_counts + F.col("classes")).alias("score")))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
