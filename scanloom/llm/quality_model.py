"""Positive-unlabelled quality classifier (operator 2).

A small network is fitted by the non-negative unbiased risk: with class prior p,
positives P and unlabelled texts U and logistic loss l,

    p * E_P[l(+g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)]).

P are trusted texts (quality 1), U are any training texts whatever their labels: the
tables have no source that is marked as the web. Labels are read of training rows only
(crc32 of the id modulo FOLDS is not 0), and labels other than 1 not at all.

p is estimated from P and U alone, by the best bin: networks of the same kind learn to
tell P from U on one half of them each and score the other half, and p is the ratio of
U's to P's share of scores above a threshold at the threshold where that ratio, raised
by a bound of its sampling error, is least.

The model is fitted on a bounded sample: at most POSITIVES and UNLABELLED ids, those of
the least hash, so that it doesn't depend on partitions, and of each id the text of the
least hash. All
else reads all rows: every whole text is scored. What a text is judged by comes
from its bytes and words alone; labels, lang, source and ids are never inputs.

A null or empty text has features of zero and gets the score of those. A null id
is held out. An id with several labels is positive if all of them are. Without a
positive or an unlabelled text every score is 1/2.
Repeated rows get equal scores; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

FOLDS = 5
POSITIVES, UNLABELLED = 6000, 12000
HIDDEN, STEPS, RATE, DECAY, SEED = 24, 400, 0.01, 1e-4, 7
THRESHOLD = 0.3
#: Steps of the network that tells P from U: few, so that it doesn't learn its rows by heart.
JUDGE_STEPS = 60

# Byte classes: 0 others, 1 a-z, 2 A-Z, 3 digits, 4 space, 5 line feed, 6 . , 7 other
# sentence marks, 8 # * $ % &, 9 | < >, 10 beyond ASCII
CLASSES = 11


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    for number, chars in ((4, b" \t\r"), (5, b"\n"), (6, b".,"), (7, b"!?;:'\"()-"), (8, b"#*$%&"), (9, b"|<>")):
        table[list(chars)] = number
    table[128:] = 10
    return table


_TABLE = _byte_classes()
WIDTH = CLASSES + CLASSES * CLASSES + 8


def features(text: str | None) -> np.ndarray:
    """Frequencies of byte classes and of pairs of them, and how words and lines
    repeat, of a whole text."""
    out = np.zeros(WIDTH, dtype=np.float32)
    data = (text or "").encode()
    if not data:
        return out
    kinds = _TABLE[np.frombuffer(data, dtype=np.uint8)]
    out[:CLASSES] = np.bincount(kinds, minlength=CLASSES) / len(kinds)
    pairs = kinds[:-1] * np.uint8(CLASSES) + kinds[1:]
    out[CLASSES : CLASSES + CLASSES * CLASSES] = np.bincount(pairs, minlength=CLASSES * CLASSES) / len(kinds)
    words = data.lower().split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = max(len(words), 1)
    out[-8:] = (
        np.log1p(len(data)) / 10,
        np.log1p(len(words)) / 10,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(map(eq, words, words[2:])) / n,
        sum(map(len, words)) / n / 10,
        len(set(zip(words, words[1:], words[2:]))) / n,
        1 - len(set(lines)) / max(len(lines), 1),
    )
    return out


class Model:
    """A network of one hidden layer over standardised features."""

    def __init__(self, prior: float | None):
        """prior: that of class 1; None to tell P from U."""
        self.prior = prior
        self.weights: list[np.ndarray] | None = None

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS) -> Model:
        if not len(positive) or not len(unlabelled):
            return self
        rng = np.random.default_rng(SEED)
        both = np.concatenate([positive, unlabelled]).astype(np.float64)
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-3
        x_p, x_u = self._scaled(positive), self._scaled(unlabelled)
        self.weights = [
            rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
        ]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for step in range(1, steps + 1):
            p, u = (x[rng.integers(0, len(x), min(len(x), 1024))] for x in (x_p, x_u))
            grads = self._gradients(p, u)
            for i, g in enumerate(grads):
                g = g + DECAY * self.weights[i] * (self.weights[i].ndim > 0)
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.weights[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        hidden = np.tanh(x @ w1 + b1)
        return hidden, hidden @ w2 + b2

    def _gradients(self, p: np.ndarray, u: np.ndarray) -> list[np.ndarray]:
        hidden_p, g_p = self._forward(p)
        hidden_u, g_u = self._forward(u)
        sig_p, sig_u = _sigmoid(g_p), _sigmoid(g_u)
        if self.prior is None:
            return self._back((p, hidden_p, (sig_p - 1) / len(p)), (u, hidden_u, sig_u / len(u)))
        negative = np.logaddexp(0, g_u).mean() - self.prior * np.logaddexp(0, g_p).mean()
        # slopes of l(+g) = log(1 + exp(-g)) and l(-g) = log(1 + exp(g))
        d_p, d_u = self.prior * (sig_p - 1) / len(p), np.zeros(len(u))
        sign = 1.0 if negative >= 0 else -1.0  # below zero: step back out of the overfit
        if negative < 0:
            d_p = np.zeros(len(p))
        d_u = d_u + sign * sig_u / len(u)
        d_p = d_p - sign * self.prior * sig_p / len(p)
        return self._back((p, hidden_p, d_p), (u, hidden_u, d_u))

    def risk(self, p: np.ndarray, u: np.ndarray) -> tuple[float, float]:
        """The part of the risk that P has as positives, and the part of negatives,
        which is below zero where the network overfits."""
        g_p, g_u = self._forward(p)[1], self._forward(u)[1]
        return float(self.prior * np.logaddexp(0, -g_p).mean()), float(np.logaddexp(0, g_u).mean() - self.prior * np.logaddexp(0, g_p).mean())

    def _back(self, *sides: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Gradients of the weights from rows, hidden values and slopes."""
        grads = [np.zeros_like(w) for w in self.weights]
        for x, hidden, d in sides:
            back = np.outer(d, self.weights[2]) * (1 - hidden * hidden)
            for i, g in enumerate((x.T @ back, back.sum(axis=0), hidden.T @ d, np.array([d.sum()]))):
                grads[i] += g
        return grads

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return _sigmoid(self._forward(self._scaled(x))[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of class 1 in the unlabelled rows, by the best bin."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    scores: list[list[np.ndarray]] = [[], []]
    for half in (0, 1):
        judge = Model(None).fit(positive[half::2], unlabelled[half::2], JUDGE_STEPS)
        for out, rows in zip(scores, (positive, unlabelled), strict=True):
            out.append(judge.score(rows[1 - half :: 2]))
    p, u = (np.sort(np.concatenate(x)) for x in scores)
    at = np.unique(p)
    share_p, share_u = (1 - np.searchsorted(x, at) / len(x) for x in (p, u))
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = int(np.argmin((share_u + slack) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs(doc_id, text), labels(doc_id, quality)."""
    trusted = (
        labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    order = F.xxhash64(F.lit(SEED), "doc_id")
    positive = trusted.where("quality = 1").orderBy(order, "doc_id").limit(POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    free = docs.where(~held_out(F.col("doc_id"))).select("doc_id").distinct().orderBy(order, "doc_id").limit(UNLABELLED)
    chosen = positive.unionByName(free.select("doc_id", F.lit(False).alias("positive")))
    roles = chosen.groupBy("doc_id").agg(F.max("positive").alias("positive"), F.min("positive").alias("also_positive"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.array(np.concatenate([features(t.as_py()) for t in batch.column("text")] or [np.zeros(0, np.float32)]))
            lists = pa.FixedSizeListArray.from_arrays(flat, WIDTH).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), batch.column("also_positive"), lists], ["doc_id", "positive", "also_positive", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")  # of an id that comes again
    sample = docs.join(F.broadcast(roles), "doc_id").groupBy("doc_id", "positive", "also_positive").agg(one)
    found = sample.mapInArrow(run, f"doc_id {kind}, positive boolean, also_positive boolean, x array<float>").toArrow().sort_by("doc_id")
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    is_p = found["positive"].to_numpy().astype(bool)
    only_p = is_p & found["also_positive"].to_numpy().astype(bool)
    return Model(estimate_prior(x[is_p], x[~only_p])).fit(x[is_p], x[~only_p])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text): one row per document, doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([features(t.as_py()) for t in batch.column("text")]) if batch.num_rows else np.zeros((0, WIDTH), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, fit(docs, labels))


#: Not expressible in SQL; tested by held-out accuracy, and risk and prior by brute force.
ORACLE = None
