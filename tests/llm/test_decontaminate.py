"""The FM-index against plain search, and the operator against windows found by brute force."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from shelfsight.llm import decontaminate as d


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, window=10):
    words = plain_words(text)
    hit, found = set(), set()
    for name, item in items:
        w = plain_words(item)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            part = w[at : at + window]
            for k in range(len(words) - len(part) + 1):
                if words[k : k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    found.add(str(name))
    return len(words), hit, sorted(found)


def test_suffix_order():
    dice = np.random.default_rng(3)
    for _ in range(60):
        text = dice.integers(0, 4, dice.integers(1, 80))
        text[-1] = 0
        ends = np.cumsum(text == 0)
        keys = [[(0, int(ends[j])) if text[j] == 0 else (1, int(text[j])) for j in range(i, len(text))] for i in range(len(text))]
        assert d.suffix_order(text.astype("i8")).tolist() == sorted(range(len(text)), key=keys.__getitem__)


def test_wavelet_matrix():
    dice = np.random.default_rng(4)
    for top in (1, 5, 100):
        sequence = dice.integers(0, top + 1, 300)
        matrix = d.WaveletMatrix(sequence, top)
        place = np.arange(300)
        symbol, before = matrix.access(place)
        assert (symbol == sequence).all()
        assert (before == [(sequence[:i] == sequence[i]).sum() for i in range(300)]).all()
        assert (matrix.rank(np.full(301, top), np.arange(301)) == [(sequence[:i] == top).sum() for i in range(301)]).all()


def test_index_counts_and_locates():
    dice = random.Random(5)
    documents = [[dice.choice([b"a", b"b", b"c"]) for _ in range(dice.randrange(60))] for _ in range(12)]
    documents += [documents[3], [], [b"a"] * 50]
    index = d.FMIndex(d.Shard(documents))
    phrases = [tuple(dice.choice([b"a", b"b", b"c", b"z"]) for _ in range(dice.randrange(1, 6))) for _ in range(80)]
    windows = d.Windows(enumerate(map(list, phrases)))
    which, low, high = index.search(windows)
    got = {int(windows.owner[k]): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which, low, high)}
    for k, phrase in enumerate(phrases):
        want = [int(start) + at for start, words in zip(index.starts, documents) for at in range(len(words) - len(phrase) + 1) if tuple(words[at : at + len(phrase)]) == phrase]
        assert got.get(k, []) == sorted(want)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven TWELVE"), (2, "short item"), (3, None), (4, " ... "), (10, "one two three four five six seven eight nine ten"), (5, "été à la plage"), (6, "Short, item!")]


def documents():
    dice = random.Random(6)
    lead = "one two three four five six seven eight nine ten eleven twelve"
    texts = [lead, f"x {lead.upper()} y {lead}", "a short-item here", "shortitem short\nitem", lead.replace("six", "6"), "", None, "...", "ÉTÉ à la plage été à la plage", "one two three four five six seven eight nine", lead + " " + lead]
    texts += [" ".join(dice.choice(lead.split()[:3] + ["short", "item"]) for _ in range(200)) for _ in range(5)] + ["filler " * 50_000 + lead]
    return [(k, t, "x", 0) for k, t in enumerate(texts)] + [(0, texts[0], "x", 0), (None, texts[2], "x", 0)]


def test_operator_equals_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hit int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for options in ({}, {"shard_words": 20}, {"block_chars": 30}):
        got = d.find(docs, ["doc_id", "text"], items, **options).collect()
        assert len(got) == len(rows)
        for r in got:
            n, hit, found = brute(r.text, ITEMS)
            assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), found), r.doc_id
            assert {w for s in r.spans for w in range(s.first_word, s.end_word)} == hit
            places = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", r.text or "")]
            assert all((s.start, s.end) == (places[s.first_word][0], places[s.end_word - 1][1]) for s in r.spans)


def test_random_items_equal_brute_force():
    dice = random.Random(7)
    for _ in range(40):
        texts = [" ".join(dice.choice("abcd") for _ in range(dice.randrange(60))) for _ in range(8)]
        items = [(str(k), " ".join(dice.choice("abcdz") for _ in range(dice.randrange(9)))) for k in range(30)] + [(None, texts[0]), ("30", texts[1]), ("31", texts[1])]
        window = dice.randrange(1, 12)
        windows = d.Windows(((k, d.words_of(t)) for k, t in items), window)
        for text, (found, spans) in zip(texts, d.search_shard(d.Shard(d.words_of(t) for t in texts), windows)):
            assert sorted(set(found)) == brute(text, [i for i in items if i[0] is not None], window)[2]
            assert {w for a, b in spans for w in range(a, b)} == brute(text, items, window)[1]


def test_memory_of_a_block():
    words = [b"%d" % k for k in range(50_000)]
    dice = random.Random(8)
    windows = d.Windows([(str(k), dice.choices(words, k=1000)) for k in range(300)])
    assert len(windows.end) == 300 * 991
    assert sum(a.nbytes for a in (windows.text, windows.end, windows.length, windows.owner)) <= 20 * 300_000


def test_digest_cut_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "é a Short item b"), (2, "clean")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = d.find(docs, ["doc_id", "text"], items)
    assert {r.doc_id: r.t for r in found.select("doc_id", d.cut(F.col("text"), F.col("spans")).alias("t")).collect()} == {1: "é a  b", 2: "clean"}
    told = {r.doc_id: r for r in d.digests(found, ["doc_id"]).collect()}
    assert (told[1].n_items, told[1].items_sha256, told[1].contaminated) == (2, hashlib.sha256(b"2,6").hexdigest(), True)
    assert (told[2].n_items, told[2].items_sha256, told[2].contaminated) == (0, hashlib.sha256(b"").hexdigest(), False)
    assert [(r.n_words, r.n_hit) for r in d.find(docs.where("doc_id = 2"), ["doc_id"], items.limit(0)).collect()] == [(1, 0)]
    assert d.find(docs.limit(0), ["doc_id"], items).count() == 0


def test_items_without_an_id_and_blocks_one_at_a_time(spark, monkeypatch):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hit int").repartition(3)
    items = [*ITEMS, (None, "short item"), (None, "filler filler filler"), (None, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    live, most = set(), []
    broadcast = type(spark.sparkContext).broadcast

    def counted(context, value):
        told = broadcast(context, value)
        destroy = told.destroy
        live.add(id(told)), most.append(len(live))
        told.destroy = lambda *a: (live.discard(id(told)), destroy(*a))
        return told

    def read(items, blocks):
        for block in blocks_of(items, blocks):
            assert not live  # the block before is gone
            yield block

    blocks_of = d.blocks_of
    monkeypatch.setattr(d, "blocks_of", read)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    for options in ({}, {"block_chars": 30}):
        most.clear(), live.clear()
        got = d.find(docs, ["doc_id", "text"], benchmark, **options).collect()
        assert len(got) == len(rows) and max(most) == 1 and (len(most) > 1) == bool(options)
        for r in got:
            n, hit, _ = brute(r.text, items)
            assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), brute(r.text, ITEMS)[2]), r.doc_id
            assert {w for s in r.spans for w in range(s.first_word, s.end_word)} == hit
