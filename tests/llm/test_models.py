"""Language ID and toxicity: held-out accuracy, defined cases, bounds of what is learned."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsight.llm import language_id, toxicity
from shelfsight.llm.common import first_by_hash, held_out
from shelfsight.llm.grams import Spelled
from shelfsight.llm.queries import op3_language, op7_toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_is_the_checksum_of_the_id(spark):
    ids = spark.createDataFrame([(k,) for k in range(200)] + [(None,), (-5,)], "doc_id long")
    for r in ids.select("doc_id", held_out(ids.doc_id).alias("h")).collect():
        assert r.h == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)


def test_language_of_held_out_documents(spark):
    found = op3_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.count() == 1000
    right = found.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.98 and 0 <= right[1] <= right[2] <= 1


def test_language_cases(spark):
    rows = [(k, "the cat and the dog of the house", "en", 0) for k in range(5)] + [(k + 5, "der hund und die katze im haus", "de", 0) for k in range(5)]
    rows += [(20, None, "en", 0), (21, "", None, 0), (22, "12 !? ½", "de", 0), (23, "und die", None, 0), (23, "und die", None, 0), (24, "the of " * 30_000, "", 0), (None, "katzen", "xx", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language_id.train(docs.where("lang <> 'xx'"))
    assert model.languages == ["de", "en"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, ["doc_id"], model).collect()}
    assert [got[k][0] for k in (0, 5, 20, 21, 22, 23, 24, None)] == ["en", "de", "und", "und", "und", "de", "en", "de"]
    assert got[20][1] == 0 and all(0 <= score <= 1 for _, score in got.values())
    assert language_id.predict(docs, ["doc_id"], model).count() == len(rows)
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, ["doc_id"], nothing).collect()} == {"und"}


def levels_of(known):
    return {n: language_id.Level.of(list(known.get(n, {})), list(known.get(n, {}).values())) for n in range(5)}


def test_words_come_before_ngrams_and_ngrams_get_shorter():
    model = language_id.Model(["a", "b"], levels_of({0: {"known": [-1.0, -2.0]}, 1: {"z": [-9.0, -1.0]}, 2: {"zz": [-1.0, -3.0]}}))
    scorer = language_id.Scorer(model)
    known, zz, z, q = scorer.of_words(["known", "zz", "z", "q"]).tolist()
    assert known == [0, -1]
    assert zz == pytest.approx([0, -2 * 0.8**3])
    assert z == pytest.approx([-8 * 0.8**4, 0])
    assert q == [0, 0]
    assert scorer.predict(["q q"]) == [("a", pytest.approx(0.5))]


def plain_language(languages, known, text):
    """The rule of the docstring, a word at a time."""
    words = re.findall(r"[^\W\d_]+", text.lower()) if text else []
    if not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    total = [0.0] * len(languages)
    for word in words:
        row, weight = known[0].get(word), 1.0
        for n in (4, 3, 2, 1) if row is None else ():
            weight *= 0.8
            padded = f" {word} "
            found = [known[n][g] for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g in known[n]]
            if found:
                row = [weight * sum(x) / len(found) for x in zip(*found)]
                break
        if row is not None:
            total = [t + x - max(row) for t, x in zip(total, row)]
    best = total.index(max(total))
    return languages[best], 1 / sum(math.exp((t - total[best]) / math.sqrt(len(words))) for t in total)


def test_scores_equal_a_plain_version():
    dice = random.Random(6)
    letters = "abcßéж日 "

    def word(n):
        return "".join(dice.choice(letters[:-1]) for _ in range(n))

    known = {0: {word(dice.randint(1, 5)): None for _ in range(60)}}
    known |= {n: {"".join(dice.choice(letters) for _ in range(n)): None for _ in range(9 * n)} for n in (1, 2, 3, 4)}
    known = {n: {k: [dice.uniform(-9, -1) for _ in range(3)] for k in keys} for n, keys in known.items()}
    scorer = language_id.Scorer(language_id.Model(["x", "y", "z"], levels_of(known)), most_words=40)
    for _ in range(12):
        texts = [" ".join(word(dice.randint(1, 7)) for _ in range(dice.randint(0, 30))) + dice.choice(["", " 12 ½", "!"]) for _ in range(9)] + [None, "", "½ 3"]
        for text, (lang, score) in zip(texts, scorer.predict(texts)):
            expected = plain_language(["x", "y", "z"], known, text)
            assert score == pytest.approx(expected[1], abs=1e-4) and (lang == expected[0] or score < 0.51)


def test_hashes_of_grams_equal_those_of_words():
    words = ["abc", "é", "日本語x", "ab"]
    spelled = Spelled(words)
    for n in (1, 2, 3, 4):
        hashes, word = spelled.grams(n)
        expected = [(w, words[w][i : i + n]) for w in range(len(words)) for i in range(len(words[w]) - n + 1)]
        assert word.tolist() == [w for w, _ in expected]
        assert hashes.tolist() == (Spelled([g for _, g in expected]).hashes().tolist() if expected else [])


def test_thinning_comes_before_rows_are_dealt_by_group(spark):
    ids = spark.range(5000).select(F.col("id").alias("_id"), F.when(F.col("id") < 4000, "one").otherwise("two").alias("g"))
    plan = first_by_hash(ids, "g", 10)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("hashpartitioning(g") <= 2  # of the window alone; adaptive plans are told twice


def test_samples_are_bounded_and_whole_when_small(spark):
    ids = spark.range(5000).select(F.col("id").alias("_id"), F.when(F.col("id") < 4900, "big").otherwise("small").alias("g"))
    got = {r.g: r.n for r in first_by_hash(ids, "g", 300).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {"big": 300, "small": 100}


def test_toxicity_of_held_out_documents(spark):
    found = op7_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    scores = [(r.score, r.toxic, r.predicted) for r in found.select("score", "toxic", "predicted").collect()]
    toxic, clean = [s for s, t, _ in scores if t], [s for s, t, _ in scores if not t]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean]) > 0.97
    assert np.mean([p == t for _, t, p in scores]) > 0.95
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, _, p in scores)


def plain_margin(model, text):
    """The rule of the docstring, a text and an n-gram at a time."""
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    features = set()
    for word in set(re.findall(r"[^\W_]+", text.lower())) if text else ():
        padded = f" {word} "
        grams = {padded[i : i + n] for n in (3, 4, 5, 6) for i in range(len(padded) - n + 1)} | ({padded} if 6 < len(padded) <= 24 else set())
        features |= {int(h) & ((1 << toxicity.BITS) - 1) for h in (Spelled([g]).hashes()[0] for g in grams)}
    return model.intercept + sum(weights.get(f, 0.0) for f in features)


def test_margins_equal_a_plain_version():
    dice = random.Random(8)
    words = ["".join(dice.choice("abcdé1") for _ in range(dice.choice([1, 2, 3, 5, 8, 22, 23, 40]))) for _ in range(80)]
    features, _ = toxicity.word_features(words)
    kept = np.unique(features)[::2]
    model = toxicity.Model(kept, np.array([dice.gauss(0, 1) for _ in kept]), -0.3)
    scorer = toxicity.Scorer(model, most_words=25)
    for _ in range(6):
        texts = [" ".join(dice.choices(words, k=dice.randint(0, 25))) for _ in range(8)] + [None, "", "!!", "_"]
        assert scorer.margins(texts).tolist() == pytest.approx([plain_margin(model, text) for text in texts])


def test_toxicity_cases(spark):
    rows = [(k, "you are a horrible idiot " + "x" * (k % 3), 0.5) for k in range(20)] + [(k + 20, "what a lovely morning " + "x" * (k % 3), 0.5) for k in range(20)]
    rows += [(50, None, 0.0), (51, "", 0.0), (52, "lovely " * 40_000, 0.0), (0, rows[0][1], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = [(k, int(k < 20)) for k in range(40)] + [(1, 1), (2, 0), (50, None), (None, 1)]
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.predict(docs, ["doc_id"], model).collect()}
    assert all((got[k] >= 0.5) == (k < 20) for k in range(40)) and got[52] < 0.5
    assert got[50] == got[51] == pytest.approx(1 / (1 + np.exp(-model.intercept)))
    one_class = toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert all(r.score < 1e-6 for r in toxicity.predict(docs, ["doc_id"], one_class).collect())
    assert toxicity.predict(docs.limit(0), ["doc_id"], model).count() == 0
