"""Toxicity of texts: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (with word ends) of a text, hashed.
Over labelled texts Spark counts in how many toxic and how many clean texts each
occurs; the log of the smoothed ratio scales the feature, and the n-grams with the
strongest evidence are kept. A logistic regression on the scaled features gives the
weights. The weights (one number per kept n-gram) are broadcast; scoring is one scan.

Long texts hold every common n-gram, so evidence is not diluted by length: a feature
counts once however often it occurs, and neutral n-grams have a ratio near zero.

Defined cases: a null text is scored as the empty text; the empty text gets the
score of the intercept. Labels that are null, or whose document is missing, are not
learnt from. If one class has no labelled text the score is the smoothed share of
toxic labels. Repeated documents are scored alike; repeated labels count each time.
"""

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import SLICE, fold, slices, stored, table

_BETWEEN = re.compile(r"\W+")
_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled texts learnt from at most, chosen by a hash of their id, so that the fit is bounded.
    ``bits``: hash width. ``kept``: n-grams kept. ``n_min``, ``n_max``: lengths of n-grams.
    ``toxic_weight``: weight of a toxic text in the fit; they are the rarer class."""

    sample: int = 16384
    bits: int = 20
    kept: int = 8192
    n_min: int = 3
    n_max: int = 6
    alpha: float = 1.0
    l2: float = 1e-4
    rounds: int = 300
    toxic_weight: float = 3.0


def hashed_grams(text: str, s: Settings) -> np.ndarray:
    """Hashed ids of the character n-grams of a text, with repeats. What lies between words counts as one space."""
    code = np.frombuffer(f" {_BETWEEN.sub(' ', text.lower())} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found, rolling, n = [], code, 1
    with np.errstate(over="ignore"):
        while n < s.n_max and len(rolling) > 1:
            rolling = rolling[:-1] * _BASE + code[n:]
            n += 1
            if n >= s.n_min:
                found.append(((rolling ^ (rolling >> np.uint64(29))) * _SPREAD >> np.uint64(64 - s.bits)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def logistic(found: list[np.ndarray], scale: np.ndarray, y: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and intercept, by accelerated gradient descent on the weighted mean loss.
    ``found``: places of the features of each text. Texts are taken in blocks, so that little is held besides them."""
    n, w, b = len(y), np.zeros(len(scale)), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    share = np.where(y > 0, s.toxic_weight, 1.0)
    share /= share.sum()
    blocks = [(slice(at, at + 1024), np.concatenate(found[at:at + 1024]), np.cumsum([0, *map(len, found[at:at + 1024])])) for at in range(0, n, 1024)]

    def sums(values: np.ndarray, cols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0.0], np.cumsum(values[cols])))[ends])

    step = 4.0 / (sum(share[own] @ sums(scale * scale, cols, ends) for own, cols, ends in blocks) + 1.0)
    ahead, ahead_b = w.copy(), b
    for k in range(s.rounds):
        grad, total, scaled = s.l2 * ahead, 0.0, scale * ahead
        for own, cols, ends in blocks:
            z = sums(scaled, cols, ends) + ahead_b
            miss = share[own] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[own])
            grad += scale * np.bincount(cols, np.repeat(miss, np.diff(ends)), minlength=len(scale))
            total += miss.sum()
        new, new_b = ahead - step * grad, ahead_b - step * total
        speed = k / (k + 3)
        ahead, ahead_b = new + speed * (new - w), new_b + speed * (new_b - b)
        w, b = new, new_b
    return w, b


@dataclass(frozen=True)
class Model:
    settings: Settings
    grams: np.ndarray
    weights: np.ndarray  # of the unscaled feature: weight times log-count ratio
    intercept: float

    def place(self) -> np.ndarray:
        """Place of each hashed id among the kept ones, -1 for the others."""
        out = np.full(1 << self.settings.bits, -1, np.int32)
        out[self.grams] = np.arange(len(self.grams))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """text, toxic of at most ``s.sample`` labelled rows. Only their ids are broadcast: at most ``s.sample`` of them."""
    chosen = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(s.sample))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The model learnt from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    s, sample = settings, labelled_sample(docs, labels, settings)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, (1 << s.bits) + 1), np.int64)  # the last place counts the texts
        for batch in slices(batches):
            for text, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                seen[y, np.unique(hashed_grams(text or "", s))] += 1
                seen[y, -1] += 1
        found = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[1, found]), pa.array(seen[0, found])], ["gram", "pos", "neg"])

    counts = stored(sample.mapInArrow(count, "gram long, pos long, neg long").groupBy("gram")
                    .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))  # at most 2^bits rows
    total = counts.where(F.col("gram") == 1 << s.bits).first()
    n_pos, n_neg = (total.pos, total.neg) if total else (0, 0)
    if not n_pos or not n_neg:
        return Model(s, np.zeros(0, np.int64), np.zeros(0), math.log((n_pos + 1) / (n_neg + 1)))
    a = s.alpha
    ratio = F.log((F.col("pos") + a) / (n_pos + 2 * a)) - F.log((F.col("neg") + a) / (n_neg + 2 * a))
    strength = F.abs(F.col("ratio")) / F.sqrt(1 / (F.col("pos") + a) + 1 / (F.col("neg") + a))  # in standard errors
    best = (counts.where(F.col("gram") < 1 << s.bits).withColumn("ratio", ratio).withColumn("strength", F.round(strength, 9))
            .orderBy(F.desc("strength"), "gram").limit(s.kept).select("gram", "ratio").toPandas().sort_values("gram"))
    kept, scale = best.gram.to_numpy(), best.ratio.to_numpy()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << s.bits, -1, np.int32)
        place[kept] = np.arange(len(kept))
        for batch in slices(batches):
            found = [np.unique(p[p >= 0]) for p in (place[hashed_grams(t or "", s)] for t in batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in found], pa.binary()), batch["toxic"]], ["found", "toxic"])

    data = sample.mapInArrow(encode, "found binary, toxic int").toPandas()  # at most s.sample rows of s.kept ids
    data = data.assign(key=data.found.map(zlib.crc32)).sort_values(["key", "toxic"])  # the same sum in any order of tasks
    weights, intercept = logistic([np.frombuffer(x, np.int32) for x in data.found], scale, data.toxic.to_numpy().astype(float), s)
    return Model(s, kept, weights * scale, intercept)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic. The weights are at most ``kept`` numbers."""
    # plain values: tasks need not know the classes of this library to unpack them
    sent = docs.sparkSession.sparkContext.broadcast((vars(model.settings), model.grams, model.weights, model.intercept))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, *rest = sent.value
        model = Model(Settings(**own), *rest)
        s, place = model.settings, model.place()
        for texts in batches:
            out = np.full(len(texts), model.intercept)
            for begin in range(0, len(texts), SLICE):
                for i, text in enumerate(texts.slice(begin, SLICE).to_pylist(), begin):
                    if text:
                        found = place[hashed_grams(text, s)]
                        out[i] += model.weights[np.unique(found[found >= 0])].sum()
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50))))

    return docs.withColumn(score_col, run(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7,
             settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learnt from the labels of the other folds."""
    model = fit(docs, labels.where(fold("doc_id", folds) != held), settings)
    return (score(docs.select("doc_id", "text"), model)
            .select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score",
                    F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
