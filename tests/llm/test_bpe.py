"""The codec against the tokenizers library, and token counts against plain sums."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfsight.llm import bpe, token_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def codec():
    with open(bpe.default_vocabulary(), encoding="utf-8") as file:
        return bpe.Codec(file.read())


def packed(ids):
    return np.array(ids, "<u4").tobytes()


TEXTS = [
    "", " ", "  ", "\n\n a", "a\n", "plain words, and more.", "it's they'll I'd", "tabs\tand spaces　here", "é ü ñ 漢字 🙂🙂",
    "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "<|endoftext", "x" * 5000, "ab" * 3000, " " * 700 + "a", "1234567890" * 40, "a  b   c", "\x00\x01\x1c \x1d",
]


def test_ids_and_text_equal_the_librarys(library, codec):
    dice = random.Random(5)
    parts = ["<|endoftext|>", "a", "the", " the", "é", " ", "  ", "\n", "'s", "1", "!!", "の", "-", "\t", " "]
    made = ["".join(dice.choice(parts) for _ in range(dice.randrange(60))) for _ in range(400)]
    for text in TEXTS + made:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == packed(ids), text
        assert codec.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False) == text


def test_scan_and_heap_merge_alike(codec):
    dice = random.Random(1)
    for _ in range(300):
        word = "".join(dice.choice("abcdethin éß") for _ in range(dice.randrange(2, 150))).encode()
        assert codec.merge(word) == codec._merge_long(word)


def test_invalid_bytes_become_replacement_characters(library, codec):
    ids = library.encode("é", add_special_tokens=False).ids + [codec.id_of[b"\xc3"]]
    assert codec.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)


def test_tables(spark, library):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, None, ""), (3, None, ""), (3, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(bpe.round_trip(docs, ["doc_id"]), ["doc_id"]).collect()
    assert len(got) == len(rows)
    want = {}
    for k, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.setdefault(k, set()).add((len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) in want[r.doc_id] for r in got)
    coded = bpe.encode(docs, ["doc_id"])
    assert sorted(r.decoded for r in bpe.decode(coded, ["doc_id"]).collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpe.round_trip(docs.limit(0), ["doc_id"]).count() == 0


def test_token_counts_equal_plain_sums(spark):
    dice = random.Random(2)
    lengths = [dice.choice([0, 1, 5, 1023, 1024, 1025, dice.randrange(5000)]) for _ in range(300)] + [0, None, 7, 7]
    table = spark.createDataFrame([(n,) for n in lengths], "n long")
    histogram = token_counts.histogram_of(table, "n")
    plain = [n or 0 for n in lengths]
    rows = token_counts.limits(histogram).collect()
    assert sorted(r.context_limit for r in rows) == sorted(set(plain))
    for r in rows:
        limit = r.context_limit
        assert (r.n_docs, r.docs_cut) == (plain.count(limit), sum(n > limit for n in plain))
        assert (r.truncated_tokens, r.total_tokens) == (sum(min(n, limit) for n in plain), sum(plain))
        assert r.quantile_from == pytest.approx(sum(n < limit for n in plain) / len(plain))
        assert r.quantile_to == pytest.approx(sum(n <= limit for n in plain) / len(plain))
    one = token_counts.truncated_total(histogram, 1000).first()
    assert tuple(one) == (sum(min(n, 1000) for n in plain), sum(n > 1000 for n in plain))
    assert token_counts.limits(histogram.limit(0)).count() == 0
    assert tuple(token_counts.truncated_total(histogram.limit(0), 5).first()) == (0, 0)


def test_lengths_come_from_the_codec(spark, library):
    docs = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "text string")
    got = {r.n_tokens: r.n_docs for r in token_counts.length_histogram(docs).collect()}
    sizes = [len(library.encode(t, add_special_tokens=False).ids) for t in TEXTS] + [0]
    assert got == {n: sizes.count(n) for n in sizes}
