"""Links and components against all pairs; components against a plain search."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

from shelfsight.llm import ngram_join
from shelfsight.llm.components import components


def shingle_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)].append(doc)
    return sorted(((doc, len(s), min(least[find(k)], default=None)) for k, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def joined(spark, rows):
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, digest binary, n int").repartition(4)
    return sorted((tuple(r) for r in ngram_join.join(docs).collect()), key=str)


def made():
    dice = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [dice.choice(words) for _ in range(90)]
    texts = []
    for _ in range(60):  # near copies, some only linked through others
        copy = list(base)
        for _ in range(dice.randrange(7)):
            copy[dice.randrange(len(copy))] = dice.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(base[:50] + [dice.choice(words) for _ in range(dice.randrange(5, 40))]) for _ in range(25)]  # a passage
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[k * 7 : k * 7 + 100]) for k in range(12)]
    texts += [" ".join(chain[:100]).upper()] * 5
    # At the threshold: 6 of 8 shingles are 75 percent, 5 of 8 less.
    texts += ["q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11", "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q12", "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q13"]
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    rows += [(None, "a b c"), (7000, "A b  c"), (7001, ""), (7002, None), (7003, "  \n"), (7004, "a b c d"), (7001, "x " * 300), (5, "x " * 30_000), (None, None), (None, "only here"), (8000, "é É z"), (8001, "é é z"), (1, texts[0])]
    return rows


def test_components_equal_all_pairs(spark):
    rows = made()
    assert joined(spark, rows) == brute(rows)


def test_blocks_of_opened_groups(spark, monkeypatch):
    """Every group is a single node and every opened group is cut into blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 3)
    monkeypatch.setattr(ngram_join, "_keys", lambda found: [int(found[-1] >> 1), 1 + int(found[0] >> 1), 2 + int(found[0] >> 1)])
    rows = made()[:100:2]
    assert joined(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_component_roots(spark):
    dice = random.Random(8)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(dice.randrange(200, 260), dice.randrange(200, 260)) for _ in range(45)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {n: n for pair in links if pair[0] != pair[1] for n in pair}
    for _ in range(100):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_shingles_are_spread_and_counted_once(spark, monkeypatch):
    line = "this very common line stands in all of the documents here"
    texts = [f"{line} " + " ".join(f"h{k}w{j}" for j in range(12 + k % 9)) for k in range(300)]
    texts += texts[:150] + [f"{line} {line}"] * 20 + ["h1w0 h1w1 h1w2 h1w3 h1w4 h1w5", line, None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    sets = {ngram_join._short(ngram_join.digest(s)): s for s in map(ngram_join.shingles, texts) if len(s)}
    half = {k: set(s[s < (1 << 63)].tolist()) for k, s in sets.items()}
    times = Counter(t for s in half.values() for t in s)
    want = {k: n for k, s in half.items() if (n := sum(times[t] > 1 for t in s))}
    largest = max(times.values())
    assert largest > 300
    for least, share in ((64, 256), (2, 1_000_000), (1_000_000, 1)):
        monkeypatch.setattr(ngram_join, "HOT_SETS", least)
        monkeypatch.setattr(ngram_join, "HOT_SHARE", share)
        got = {r.short: r.shared for r in ngram_join.shared_counts(docs, "text", 4).collect()}
        assert {k: n for k, n in got.items() if n} == want, least


def test_deals_follow_the_rows(spark, monkeypatch):
    base = [f"d{j}" for j in range(60)]
    docs = spark.createDataFrame([(k, " ".join(base[: 40 + k % 20] + [f"x{k}y{j}" for j in range(k % 7)])) for k in range(60)], "doc_id long, text string")
    want = sorted(tuple(r) for r in ngram_join.join(docs).collect())
    monkeypatch.setattr(ngram_join, "DEAL_ROWS", 3)
    assert sorted(tuple(r) for r in ngram_join.join(docs).collect()) == want


def test_shingles_are_mixed_in_place():
    text = " ".join(f"w{k % 500} x{k % 499}" for k in range(100_000))
    assert len(ngram_join.shingles(text)) == len(shingle_set(text))
    tracemalloc.start()
    ngram_join.shingles(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 78 * 200_000  # bytes a word, the words included
