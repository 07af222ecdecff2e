"""Language ID by word-first backoff.

A known word is scored by its log frequency in each language. An unseen one falls back to its character n-grams, from
``LONGEST`` down: the longest length at which at least one n-gram is known decides, and each step down counts less. The
scores of a text's words are added up for every learned language.

The model is fitted on a bounded sample: at most ``SAMPLE_DOCS`` whole documents a language (those with the smallest
hashed ids), and at most ``MODEL_ENTRIES`` words and n-grams of each length, shared equally among the languages, that occur more
than once in it. Words of more than ``MOST_WORD_LENGTH`` letters aren't learned whole; such words are scored by their n-grams. So
the model, which is broadcast, has a bounded size, however large the corpus: for each level one array of 64-bit hashes and one
matrix. The ids of the sample are broadcast as well unless there are so many languages that they pass ``MOST_BROADCAST_IDS``; the
result is the same. New words of many texts are scored together; scores of words met are kept for the task, up to a bound.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned; ties go to the
language that sorts first; a null or empty ``lang`` teaches nothing but its rows are predicted; repeated rows count each time
in learning and are predicted each time; very long texts are scored whole; an empty table teaches nothing and gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import first_by_hash, let_go, map_texts, saved
from .grams import Places, Spelled, grown

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
#: What a level below the word counts, relative to the one above it.
STEP_DOWN = 0.8
SMOOTHING = 0.5
SAMPLE_DOCS = 2_000
MODEL_ENTRIES = 200_000
MOST_BROADCAST_IDS = 1_000_000
MOST_WORD_LENGTH = 64  # of a key in the model; longer words are scored by their n-grams
UNKNOWN = "und"


#: Words whose scores a task keeps.
MOST_WORDS = 400_000


@dataclass
class Level:
    """Hashes of keys in order, and a row of log frequencies for each."""

    keys: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, keys: list[str], rows: np.ndarray) -> Level:
        if not keys:
            return cls(np.zeros(0, "u8"), np.zeros((0, 0), "f4"))
        hashes, first = np.unique(Spelled(keys).hashes(), return_index=True)
        return cls(hashes, np.asarray(rows, "f4").reshape(len(keys), -1)[first])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash; -1 if it has none."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


@dataclass
class Model:
    """Languages in order; for each level (0: words, n: n-grams of that length) what is known."""

    languages: list[str]
    levels: dict[int, Level]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def sample(docs: DataFrame, language: str, doc_id: str, text: str, most: int = SAMPLE_DOCS) -> DataFrame:
    """At most ``most`` documents a language. Only ids and languages are ranked, then the texts are looked up."""
    labelled = docs.where((F.col(language) != "") & F.col(text).isNotNull())
    ids = labelled.select(F.col(language).alias("_lang"), F.col(doc_id).alias("_id"))
    chosen = first_by_hash(ids, "_lang", most).select("_id").distinct()
    # At most ``most`` ids for each language: few enough to be broadcast unless the languages are very many.
    if ids.select(F.count_distinct("_lang").alias("n")).first()["n"] * most <= MOST_BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    texts = labelled.select(F.col(language).alias("lang"), F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"))
    return texts.join(chosen, "_id", "left_semi").select("lang", "text")


def key_counts(sampled: DataFrame) -> DataFrame:
    """(lang, level, key, n) of words and n-grams, summed within each batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                words[lang].update(WORD.findall(text.lower()))
            for lang, found in words.items():
                for level in range(LONGEST + 1):
                    counts: Counter = Counter()
                    for word, n in found.items():
                        if level:
                            for gram in grams(word, level):
                                counts[gram] += n
                        elif len(word) <= MOST_WORD_LENGTH:
                            counts[word] = n
                    rows = len(counts)
                    columns = [[lang] * rows, [level] * rows, list(counts), list(counts.values())]
                    types = (pa.string(), pa.int32(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "level", "key", "n"])

    counted = sampled.select("lang", "text").mapInArrow(run, "lang string, level int, key string, n long")
    return counted.groupBy("lang", "level", "key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, language: str = "lang", doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, entries: int = MODEL_ENTRIES) -> Model:
    """The model learned from ``docs``; hold back what it is to be tested on before the call."""
    counts = key_counts(sample(docs, language, doc_id, text, sample_docs)).persist()
    try:
        totals = {(r["lang"], r["level"]): (r["n"], r["keys"]) for r in counts.groupBy("lang", "level").agg(F.sum("n").alias("n"), F.count("*").alias("keys")).collect()}
        languages = sorted({lang for lang, _ in totals})
        share = max(1, entries // max(1, len(languages)))
        common = Window.partitionBy("lang", "level").orderBy(F.col("n").desc(), "key")
        kept = counts.withColumn("_n", F.row_number().over(common)).where((F.col("_n") <= share) & (F.col("n") > 1)).select("level", "key").distinct()
        rows = saved(counts.join(kept, ["level", "key"]).groupBy("level", "key").agg(F.collect_list(F.struct("lang", "n")).alias("by")), "language-model")
    finally:
        counts.unpersist()
    levels = {}
    for level in range(LONGEST + 1):
        # At most ``entries`` rows.
        known = rows.where(F.col("level") == level).select("key", "by").toArrow()
        by = known.column("by").combine_chunks()
        told, lengths = by.flatten(), by.value_lengths().to_numpy()
        times = np.zeros((len(lengths), len(languages)))
        place = pc.index_in(told.field("lang"), pa.array(languages, pa.string())).to_numpy(zero_copy_only=False)
        times[np.repeat(np.arange(len(lengths)), lengths), place] = told.field("n").to_numpy()
        size = np.array([totals.get((lang, level), (0, 0)) for lang in languages], float).reshape(-1, 2)
        levels[level] = Level.of(known.column("key").to_pylist(), np.log((times + SMOOTHING) / (size[:, 0] + SMOOTHING * (size[:, 1] + 1))))
    return Model(languages, levels)


class Scorer:
    """Scores texts; the scores of words it has met are kept in one matrix."""

    def __init__(self, model: Model, most_words: int = MOST_WORDS) -> None:
        self.model, self.places = model, Places(most_words)
        self.rows, self.letters = np.zeros((1 << 12, len(model.languages)), "f4"), np.zeros(1 << 12, bool)

    def of_words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word, 0 for the best language."""
        levels, out = self.model.levels, np.zeros((len(words), len(self.model.languages)), "f4")
        at = levels[0].find(Spelled(words).hashes())
        if (at >= 0).any():
            out[at >= 0] = levels[0].rows[at[at >= 0]]
        left, weight = np.flatnonzero(at < 0), 1.0
        for n in range(LONGEST, 0, -1):
            weight *= STEP_DOWN
            if not len(left):
                break
            hashes, word = Spelled([f" {words[w]} " for w in left.tolist()]).grams(n)
            at = levels[n].find(hashes)
            at, word = at[at >= 0], word[at >= 0]
            known = np.bincount(word, minlength=len(left))
            hit = known > 0
            if not hit.any():
                continue
            for k in range(out.shape[1]):
                out[left[hit], k] = weight * np.bincount(word, levels[n].rows[at, k], len(left))[hit] / known[hit]
            left = left[~hit]
        return out - out.max(axis=1, keepdims=True) if out.shape[1] else out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        languages = self.model.languages
        if not languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        self.places.tidy()
        words = [WORD.findall(text.lower()) if text else [] for text in texts]
        sizes = np.array([len(w) for w in words])
        at = self.places.of(chain.from_iterable(words), int(sizes.sum()))
        new = self.places.taken()
        if new:
            self.rows, self.letters = grown(self.rows, len(self.places)), grown(self.letters, len(self.places))
            first = len(self.places) - len(new)
            self.rows[first : len(self.places)] = self.of_words(new)
            self.letters[first : len(self.places)] = [word.isalpha() or any(map(str.isalpha, word)) for word in new]
        text = np.repeat(np.arange(len(texts)), sizes)
        total = np.stack([np.bincount(text, self.rows[at, k], len(texts)) for k in range(len(languages))], axis=1)
        told = np.bincount(text, self.letters[at], len(texts)) > 0
        best = total.argmax(axis=1)
        # Words of a text depend on each other: the evidence grows with the root of their number.
        apart = (total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(sizes, 1))[:, None]
        score = 1 / np.exp(apart).sum(axis=1)
        return [(languages[b], float(s)) if t else (UNKNOWN, 0.0) for b, s, t in zip(best, score, told)]


def predict(df: DataFrame, keep: list[str], model: Model, text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (0 to 1). The model's size is bounded by ``MODEL_ENTRIES``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable:
        let_go()
        return Scorer(shared.value).predict

    return map_texts(df, keep, text, start, "lang_pred string, score double", together=True)


def accepted(least: float) -> Column:
    """The condition under which a predicted document stays in a corpus."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
