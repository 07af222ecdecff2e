"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (within a word and its two edges) in a text. Its log-count ratio compares
how often it occurs in toxic and in other texts; a logistic regression is fitted on the features scaled by their ratios.

Learning uses a bounded sample: at most ``SAMPLE_ROWS`` labelled rows of either class (those with the smallest hashed ids),
hashed to ``1 << BITS`` features, of which the ``FEATURES`` most telling are kept. Both classes weigh the same in the fit, so
0.5 doesn't depend on how rare toxic rows are. An n-gram counts as a feature if ``LEAST_DOCS`` rows of the sample have it, and words of up to
``WHOLE`` letters and edges are one themselves. What reaches the driver and what is broadcast has a bounded size. The n-grams of many
texts' words are hashed together; what is known of words met is kept for the task, up to a bound.

Defined results: null and empty texts have no features and get the score of the intercept; without labelled rows of both
classes every score is next to 1 if all labelled rows are toxic, else next to 0; a row whose label is null teaches nothing; several equal
labels of one document count once, contradicting ones not at all; repeated documents are scored each time; very long texts are scored
whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, let_go, map_texts, saved
from .grams import Places, Spelled, grown

WORD = re.compile(r"[^\W_]+")
LENGTHS = (3, 4, 5, 6)
WHOLE = 24
BITS = 20
SAMPLE_ROWS = 3_000
FEATURES = 20_000
LEAST_DOCS = 3
SMOOTHING = 1.0
PENALTY, STEPS = 1.0, 200


#: Words of which a task keeps the known features.
MOST_WORDS = 400_000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words with their edges, of the lengths in ``LENGTHS`` and, up to ``WHOLE``, of their own; and the words they are of."""
    spelled = Spelled([f" {word} " for word in words])
    found = [spelled.grams(n) for n in LENGTHS]
    whole = np.flatnonzero((spelled.sizes > max(LENGTHS)) & (spelled.sizes <= WHOLE))
    found.append((spelled.hashes()[whole], whole))
    hashes, word = (np.concatenate(x) for x in zip(*found))
    return (hashes & np.uint64((1 << BITS) - 1)).astype("i8"), word


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    """The kept features in order, the weight (ratio times coefficient) of each, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """(_id, text, toxic) of documents with one label."""
    one = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("toxic"), F.max(label).alias("_most"))
    one = one.where(F.col("toxic") == F.col("_most")).select("_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(one, "_id")


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``most`` rows of either class, and how many rows each class has in all."""
    ids = labelled(docs.select(doc_id, F.lit("").alias(text)), labels, doc_id, text, label).select("_id", "toxic")
    sizes = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = first_by_hash(ids, "toxic", most).groupBy("_id").agg(F.first("toxic").alias("toxic"))
    # At most ``most`` ids of either class are broadcast.
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "_id"), sizes


def sample_features(sampled: DataFrame) -> DataFrame:
    """(toxic, features) of each sampled row, the features as packed unsigned 32-bit integers."""

    def start() -> Callable:
        def handle(texts: list[str | None]) -> list[tuple[bytes]]:
            words = [distinct_words(text) for text in texts]
            number = {word: k for k, word in enumerate(dict.fromkeys(chain.from_iterable(words)))}
            features, word = word_features(list(number))
            order = np.argsort(word, kind="stable")
            ends = np.searchsorted(word[order], np.arange(len(number) + 1))
            features, out = features[order], []
            for own in words:
                parts = [features[ends[k] : ends[k + 1]] for k in map(number.__getitem__, own)]
                out.append((np.unique(np.concatenate(parts)).astype("<u4").tobytes() if parts else b"",))
            return out

        return handle

    return map_texts(sampled, ["toxic"], "text", start, "features binary", together=True)


def feature_counts(features: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of either class (0, 1) that have each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(0).to_pylist())
            packed = [np.frombuffer(f, "<u4") for f in batch.column(1).to_pylist()]
            for label in (0, 1):
                own = [f for f, t in zip(packed, toxic) if t == label]
                found, n = np.unique(np.concatenate([*own, np.empty(0, "<u4")]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), label, "i4")), pa.array(found.astype("i8")), pa.array(n.astype("i8"))], ["toxic", "feature", "n"])

    summed = features.mapInArrow(run, "toxic int, feature long, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic")
    )
    counts = np.zeros((2, 1 << BITS))
    got = summed.where(F.col("clean") + F.col("toxic") >= LEAST_DOCS).toPandas()  # at most 1 << BITS rows
    counts[0, got["feature"]], counts[1, got["feature"]] = got["clean"], got["toxic"]
    return counts[0], counts[1]


def fit(rows: list[np.ndarray], toxic: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps on sparse rows: rows hold (column, value) pairs, classes weigh the same."""
    columns = np.concatenate([r[0] for r in rows]).astype("i4")
    values = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows), dtype="i4"), [len(r[0]) for r in rows])
    width, n = (int(columns.max()) + 1 if len(columns) else 0), len(rows)
    weight = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))
    squares = np.bincount(row, values * values, n) + 1
    step = 1 / (0.25 * float((weight * squares).sum()) + penalty / n)
    w = before = np.zeros(width + 1)  # the last is the intercept
    for k in range(steps):
        ahead = w + (k / (k + 3)) * (w - before)
        margin = np.bincount(row, values * ahead[columns], n) + ahead[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic)
        slope = np.append(np.bincount(columns, values * error[row], width) + penalty / n * ahead[:-1], error.sum())
        before, w = w, ahead - step * slope
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, most_features: int = FEATURES) -> Model:
    """The model learned from labelled documents; hold back what it is to be tested on before the call."""
    sampled, sizes = sample(docs, labels, doc_id, text, label, sample_rows)
    clean_rows, toxic_rows = sizes.get(0, 0), sizes.get(1, 0)
    if not clean_rows or not toxic_rows:
        return Model(np.zeros(0, "i8"), np.zeros(0), 30.0 if toxic_rows else -30.0)
    features = saved(sample_features(sampled), "toxic-features")
    clean, toxic = feature_counts(features)
    sampled_clean, sampled_toxic = min(clean_rows, sample_rows), min(toxic_rows, sample_rows)
    p, q = toxic + SMOOTHING, clean + SMOOTHING
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    share = (toxic + clean) / (sampled_toxic + sampled_clean)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / sampled_toxic + 1 / sampled_clean))
    telling = np.where(toxic + clean >= LEAST_DOCS, np.abs(toxic / sampled_toxic - clean / sampled_clean) / spread, 0)
    kept = np.sort(np.argsort(-telling, kind="stable")[:most_features])
    kept = kept[telling[kept] > 0]
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))

    rows, marks = [], []
    for r in features.toLocalIterator():  # at most 2 * sample_rows rows
        columns = place[np.frombuffer(r["features"], "<u4")]
        columns = columns[columns >= 0]
        rows.append((columns.astype("i4"), ratio[kept[columns]]))
        marks.append(r["toxic"])
    coefficients, intercept = fit(rows, np.array(marks))
    weights = np.zeros(len(kept))
    weights[: len(coefficients)] = coefficients * ratio[kept[: len(coefficients)]]
    return Model(kept, weights, intercept)


class Scorer:
    """Scores texts; the known features of words it has met are kept in one list with the place of each word's."""

    def __init__(self, model: Model, most_words: int = MOST_WORDS) -> None:
        self.model, self.places = model, Places(most_words)
        self.rank = np.full(1 << BITS, -1, "i4")
        self.rank[model.features] = np.arange(len(model.features))
        self._forget()

    def _forget(self) -> None:
        self.features, self.used = np.zeros(1 << 14, "i4"), 0
        self.starts, self.counts = np.zeros(1 << 12, "i8"), np.zeros(1 << 12, "i8")

    def _learn(self, words: list[str]) -> None:
        features, word = word_features(words)
        rank = self.rank[features]
        order = np.flatnonzero(rank >= 0)
        order = order[np.argsort(word[order], kind="stable")]
        counts = np.bincount(word[order], minlength=len(words))
        first, total = len(self.places) - len(words), len(order)
        self.features = grown(self.features, self.used + total)
        self.features[self.used : self.used + total] = rank[order]
        self.starts, self.counts = grown(self.starts, len(self.places)), grown(self.counts, len(self.places))
        self.starts[first : len(self.places)] = self.used + np.cumsum(counts) - counts
        self.counts[first : len(self.places)] = counts
        self.used += total

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The sum of the weights of each text's features, each counted once."""
        if self.places.tidy():
            self._forget()
        words = [distinct_words(text) for text in texts]
        sizes = np.array([len(w) for w in words])
        at = self.places.of(chain.from_iterable(words), int(sizes.sum()))
        new = self.places.taken()
        if new:
            self._learn(new)
        times = self.counts[at]
        place = np.repeat(self.starts[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        text = np.repeat(np.repeat(np.arange(len(texts)), sizes), times)
        wide = max(1, len(self.model.features))
        own = np.unique(text * wide + self.features[place])
        return self.model.intercept + np.bincount(own // wide, self.model.weights[own % wide] if len(own) else None, len(texts))

    def scores(self, texts: list[str | None]) -> list[tuple[float]]:
        return [(float(s),) for s in 1 / (1 + np.exp(-np.clip(self.margins(texts), -30, 30)))]


def predict(df: DataFrame, keep: list[str], model: Model, text: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1, higher: toxic likelier). The model holds at most ``FEATURES`` weights."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable:
        let_go()
        return Scorer(shared.value).scores

    return map_texts(df, keep, text, start, "score double", together=True)
