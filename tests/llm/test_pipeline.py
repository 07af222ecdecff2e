"""The stages against brute force on a small corpus, and all queries' names and columns."""

import hashlib

import corpus_pipeline
import public_tokenizers
import numpy as np
from tokenizers import Tokenizer

from shelfsight.llm import queries

HEX = "0123456789abcdef" * 3
LEAD = "one two three four five six seven eight nine ten eleven twelve"
EN = "the cat sat on the mat and looked at the dog of the house while it was in the garden with all of us"


def corpus(spark):
    rows = [(k, f"{EN} number{k} " + " ".join(f"en{k}w{j}" for j in range(20)), "en", "s", 0, "x") for k in range(30)]
    rows += [(100 + k, f"der hund und die katze sind im haus und das ist gut wort{k} " + " ".join(f"de{k}w{j}" for j in range(20)), "de", "s", 0, "x") for k in range(30)]
    rows += [(200, rows[3][1], "en", "t", 0, "x"), (200, rows[3][1], "en", "t", 0, "x"), (201, rows[4][1] + " more", "en", "t", 0, "x"), (None, rows[5][1], "en", "t", 0, "x")]
    rows += [(300, "", "en", "t", 0, "x"), (301, None, None, "t", 0, "x"), (302, "12345", None, "t", 0, "x")]
    rows += [(400, f"it was in the garden of the house {LEAD} and the cat", "en", "t", 0, "x"), (401, f"the key of the house is token={HEX} and it was in the garden", "en", "t", 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string")


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, LEAD)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        left.append(sorted((r.doc_id if r.doc_id is not None else -1) for r in docs.collect()))
    usual = [*range(30), *range(100, 130)]
    assert left[0] == sorted([-1, *usual, 200, 200, 201, 400, 401])
    assert left[1] == sorted([-1, *usual, 400, 401])
    assert left[2] == left[3] == sorted([-1, *usual, 401])
    kept = {r.doc_id: r for r in docs.collect()}
    assert kept[401].text == "the key of the house is <secret> and it was in the garden"
    assert kept[401].n_chars == len(kept[401].text) and kept[401].lang_pred == "x"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in got) == left[3]
    for r in got:
        ids = tokenizer.encode(kept[r.doc_id].text, add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].text.encode()).hexdigest()


def test_near_copies_of_repeated_and_missing_ids(spark):
    texts = [" ".join(f"t{k}w{j}" for j in range(60)) for k in range(5)]
    rows = [
        (1, texts[0], "a"), (1, texts[0] + " more", "a"), (1, texts[0].upper(), "a"), (1, texts[1], "b"),  # one id, several texts
        (2, texts[0] + " yet more", "a"), (2, texts[2], "c"), (0, texts[2] + " more", "c"),  # 2 links with the groups of 1 and of 0
        (None, texts[3], "d"), (None, texts[3] + " more", "d"), (None, texts[3], "d"), (None, texts[4], "e"),
        (7, None, "n"), (7, "", "n"), (7, "", "n"), (None, "", "m"), (None, None, "m"),
    ]
    docs = spark.createDataFrame([(i, t, g, "x", 1) for i, t, g in rows], "doc_id long, text string, _key string, component string, n long").repartition(3)
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    left = got.collect()
    assert sorted((r._key, r.doc_id or 0) for r in left) == [("a", 1), ("b", 1), ("c", 0), ("d", 0), ("e", 0), ("m", 0), ("m", 0), ("n", 7), ("n", 7)]
    assert {(r.doc_id, r.text, r._key) for r in left} <= set(rows)


def test_empty_corpus(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark).limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, LEAD)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_names():
    assert sorted(queries.all_queries()) == sorted(
        ["op1_bpe", "op2_html", "op3_language", "op4_warc", "op5_secrets", "op6_topk", "op7_toxicity", "op8_decontaminate", "op9_token_counts", "op10_ngram_join", "op11_source_audit", "op12_near_vectors", "op13_vector_codes", "pipeline"]
    )
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark", "secrets", "tokens"]
