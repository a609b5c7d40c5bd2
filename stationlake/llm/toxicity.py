"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

The models spell words: each predicts the next byte of a word from up to
``order`` - 1 bytes before it, so forms of one stem share what is known of the
stem. Both discount their counts, by what the counts of counts tell, and fall
back to one distribution: the interpolated continuation counts of both classes
together. The feature of a text is its log-likelihood ratio, toxic against
ordinary, per word. A gram that neither model knows, or that both know by the
shared counts only, has ratio 0, and every other ratio is shrunk by its
evidence: z the standard score of the difference of the classes after the same
context, it counts z^2 / (z^2 + ``DOUBT``). So the many words that say nothing
do not drown the few that do. A logistic curve turns the feature into a score.
It is fitted crosswise: each labelled row counts with the ratio that the models
of the other ``PARTS`` - 1 parts give it, and each class with its share of all
labels, however many of its rows are taken. So all labels train the models.

Labels of ``most_toxic`` and ``most_ordinary`` rows at most are learned from,
and of these up to ``calibration`` rows of each class fit the curve, all taken
by the hash of their key: this bounds the broadcast lists of keys. The model
keeps the ``max_grams`` grams with the highest counts, so its size is bounded
too. A word counts once per text. Every text is scored on all its words.

Defined results: null and empty texts have ratio 0, and the score of that; rows
without key are not held out; of repeated labels with one key the larger
counts; without words in labelled rows of both classes all scores are 0; where
all rows of a class lie in one part, the models of all parts stand in for those
of the others. Added columns replace columns of the same name.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.llm.frames import as_bytes, extended, stored
from stationlake.llm.hashing import LETTERS, Lookup, portions, spelled

SHARED_DISCOUNT, DOUBT = 0.75, 25.0
PARTS = 5


def fold(key: str, folds: int = 5) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


class Model:
    """Log-likelihood ratio of each known gram; unknown ones have none."""

    def __init__(self, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int):
        self.order, self.slope, self.offset = order, 0.0, -1000.0
        grams = grams.view(np.uint64)
        self.grams = Lookup(grams)
        contexts, at = np.unique(grams >> np.uint64(8), return_inverse=True)
        lower, size = _shared(grams, order), _sizes(grams, order)
        likely, known, totals = [], np.zeros(len(grams), bool), []
        for count in (toxic.astype(float), ordinary.astype(float)):
            discount = _discounts(count, size, order)[size]
            total = np.bincount(at, count, len(contexts))
            moved = np.bincount(at, np.minimum(count, discount), len(contexts))
            weight = np.where(total > 0, np.maximum(moved / np.maximum(total, 1), 1e-9), 1.0)
            own = np.where(total[at] > 0, np.maximum(count - discount, 0) / np.maximum(total[at], 1), 0.0)
            likely.append(np.log(own + weight[at] * lower))
            known |= own > 0
            totals.append(total[at])
        both = totals[0] + totals[1]
        share = (toxic + ordinary) / np.maximum(both, 1)
        spread = share * (1 - share) * totals[0] * totals[1] / np.maximum(both, 1)
        squared = np.where(spread > 0, (toxic - share * totals[0]) ** 2 / np.where(spread > 0, spread, 1), 0.0)
        self.ratio = np.append(np.where(known, (likely[0] - likely[1]) * squared / (squared + DOUBT), 0.0), 0.0)

    def ratios(self, texts: list[bytes | None]) -> np.ndarray:
        """Log-likelihood ratio per word of each text."""
        out = [np.empty(0)]
        for a, b in portions(texts):
            grams, starts, words = spelled(texts[a:b], self.order)
            total = np.concatenate(([0.0], np.cumsum(self.ratio[self.grams.find(grams)])))
            out.append((total[starts[1:]] - total[starts[:-1]]) / np.maximum(words, 1))
        return np.concatenate(out)

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):  # far below 0 the score is 0
            return 1.0 / (1.0 + np.exp(-(self.slope * ratios + self.offset)))


def _sizes(grams: np.ndarray, order: int) -> np.ndarray:
    return sum((grams >> np.uint64(8 * k) > 0).astype(np.int64) for k in range(order))


def _discounts(count: np.ndarray, size: np.ndarray, order: int) -> np.ndarray:
    """Share of one count to discount from grams of each size, n1 / (n1 + 2 n2); a half where none is seen once."""
    once, twice = (np.bincount(size[count == n], minlength=order + 1) for n in (1, 2))
    return np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)


def _shared(grams: np.ndarray, order: int) -> np.ndarray:
    """Probability of each gram's last byte after its context without the first byte.

    Interpolated Kneser-Ney: a shorter gram counts the distinct bytes before it.
    """
    size = _sizes(grams, order)
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in range(order - 1, 0, -1):
        longer = grams[size == n + 1]
        if n + 1 in tables:
            longer = np.union1d(longer, tables[n + 1][0])
        tables[n] = np.unique(longer & np.uint64((1 << 8 * n) - 1), return_counts=True)

    def probability(n: int, wanted: np.ndarray) -> np.ndarray:
        if n == 0 or not len(tables[n][0]):
            return np.full(len(wanted), 1 / 256)
        keys, counts = tables[n]
        contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(at, counts), np.bincount(at)
        weight = np.append(np.minimum(SHARED_DISCOUNT * kinds / total, 1.0), 1.0)
        key, context = Lookup(keys).find(wanted), Lookup(contexts).find(wanted >> np.uint64(8))
        own = np.maximum(np.append(counts, 0)[key] - SHARED_DISCOUNT, 0) / np.append(total, 1)[context]
        return own + weight[context] * probability(n - 1, wanted & np.uint64((1 << 8 * (n - 1)) - 1))

    out = np.full(len(grams), 1 / 256)
    for n in range(2, order + 1):
        of = size == n
        out[of] = probability(n - 1, grams[of] & np.uint64((1 << 8 * (n - 1)) - 1))
    return out


def _counted_words(batches):
    """Words of each batch by part, with the number of toxic and ordinary texts that hold them."""
    for batch in batches:
        counts = [(Counter(), Counter()) for _ in range(PARTS)]
        for text, toxic, part in zip(as_bytes(batch.column("__text")), *[batch.column(c).to_pylist() for c in ("__toxic", "__part")]):
            if text:
                counts[part][toxic].update(set(text.translate(LETTERS).split()))
        for part, (ordinary, toxic) in enumerate(counts):
            words = list(ordinary.keys() | toxic.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([part] * len(words), pa.int32()), *[pa.array([c[w] for w in words], pa.int64()) for c in (toxic, ordinary)]],
                names=["word", "part", "toxic", "ordinary"],
            )


def _counted_grams(order: int):
    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            counts = [batch.column(c).to_numpy() for c in ("toxic", "ordinary")]
            for a, b in portions(words):
                grams, starts, _ = spelled(words[a:b], order)
                of = a + np.repeat(np.arange(b - a), np.diff(starts))
                keys, at = np.unique(grams, return_inverse=True)
                sums = [np.bincount(at, c[of], len(keys)).astype(np.int64) for c in counts]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, sums)], names=["gram", "toxic", "ordinary"])

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    order: int = 5,
    most_toxic: int = 20_000,
    most_ordinary: int = 60_000,
    calibration: int = 5_000,
    max_grams: int = 1_000_000,
) -> Model:
    """The models from the labelled rows whose fold is not 0."""
    known = (
        labels.filter(F.col(label).isNotNull() & (fold(key) != 0))
        .groupBy(F.col(key).alias("__key"))
        .agg((F.max(label) > 0).alias("__toxic"))
        .withColumn("__order", F.xxhash64("__key", F.lit("order")))
        .withColumn("__part", F.pmod(F.xxhash64("__key", F.lit("part")), F.lit(PARTS)).cast("int"))
    )
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))

    def sample(toxic, size):
        of = known.filter(F.col("__toxic") == toxic)
        return of.orderBy("__order", "__key").limit(size).select("__key", "__toxic", "__part")

    chosen = sample(True, most_toxic).unionByName(sample(False, most_ordinary))
    counts = [F.sum(c).alias(c) for c in ("toxic", "ordinary")]
    words = stored(
        rows.join(F.broadcast(chosen), "__key")
        .select("__text", "__toxic", "__part")
        .mapInArrow(_counted_words, "word binary, part int, toxic long, ordinary long")
        .groupBy("word", "part")
        .agg(*counts),
        "words",
    )

    def learned(words):
        grams = words.mapInArrow(_counted_grams(order), "gram long, toxic long, ordinary long").groupBy("gram").agg(*counts)
        top = grams.orderBy(F.desc(F.expr("toxic + ordinary")), "gram").limit(max_grams).toPandas()
        if not len(top) or not top["toxic"].any() or not top["ordinary"].any():
            return None
        return Model(*[top[c].to_numpy() for c in ("gram", "toxic", "ordinary")], order)

    model = learned(words)
    if model is None:
        return Model(*[np.empty(0, np.int64)] * 3, order)
    drawn = sample(True, min(calibration, most_toxic)).unionByName(sample(False, min(calibration, most_ordinary)))
    tuned = stored(rows.join(F.broadcast(drawn), "__key").select("__text", "__toxic", "__part"), "tuning")
    points = []
    for part in range(PARTS):
        shared = docs.sparkSession.sparkContext.broadcast(learned(words.filter(F.col("part") != part)) or model)
        points.append(_scored(tuned.filter(F.col("__part") == part), shared, "__text", ["__toxic"]).toPandas())
        shared.destroy()
    x, y = (np.concatenate([p[c].to_numpy(float) for p in points]) for c in ("ratio", "__toxic"))
    share = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    weight = np.where(y > 0, share[True] / max(y.sum(), 1), share[False] / max((1 - y).sum(), 1))
    if 0 < y.sum() < len(y):
        model.slope, model.offset = _logistic(x, y, weight / weight.mean())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak pull to 0 for separable points."""
    scale = max(float(x.std()), 1e-9)
    features = np.column_stack([(x - x.mean()) / scale, np.ones_like(x)])
    w, pull = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (weight * (p - y)) + pull @ w
        step = np.linalg.solve((features * (weight * p * (1 - p))[:, None]).T @ features + pull, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * x.mean() / scale)


def scored(docs: DataFrame, model: Model, text: str = "text", keep=None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``ratio``."""
    return _scored(docs, docs.sparkSession.sparkContext.broadcast(model), text, keep)


def _scored(docs: DataFrame, shared, text: str, keep) -> DataFrame:
    def run(batches):
        for batch in batches:
            ratio = shared.value.ratios(as_bytes(batch.column(text)))
            score = shared.value.scores(ratio)
            yield [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(ratio)]

    return extended(docs, "score double, predicted int, ratio double", run, keep)


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """Documents not predicted to be toxic; columns as given."""
    model = fit(docs, labels, text=text, **options)
    packed = docs.select(F.col(text).alias("__text"), F.struct("*").alias("__row"))
    return scored(packed, model, "__text").filter("predicted = 0").select("__row.*")
