"""Divergence of sources against a plain version in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from shelfsight.llm import source_audit

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {b: b + 32 for b in range(65, 91)}


def brute(rows, least_docs=3, leading=200):
    told, have, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((x or "", y or "", z or "") for x, y, z in rows):
        words = Counter(WORD.findall(text.translate(LOWER)))
        told[lang, source].update(words)
        have[lang].update(words.keys())
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in have[lang].items() if n >= least_docs]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        whole = shares(sum((told[lang, s] for s in sources), Counter()))
        for s in sources:
            p = shares(told[lang, s])
            pairs = []
            for o in sources - {s}:
                q = shares(told[lang, o])
                pairs.append((sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o))
            over = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if told[lang, s][t] and p[t] > whole[t]]
            for part, found in (("pair", pairs), ("term", over)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, n + 1) for n, (v, t) in enumerate(found) if part == "pair" or n < leading]
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, rank int").repartition(3)
    return sorted(tuple(r) for r in source_audit.audit(df, **how).collect())


def corpus(seed, sources, n=150):
    dice = random.Random(seed)
    words = ["a", "Bb", "ÄRGER", "été", "日本", "x1y", "don't", "Z", "ß", "mixED", "ſ", "K"] + [f"w{chr(97 + k)}" for k in range(20)]
    joins = [" ", "\n", "\x00", "_", "7", "[", "{", "\x7f", " "]
    rows = []
    for _ in range(n):
        text = "".join(dice.choice(words) + dice.choice(joins) for _ in range(dice.randrange(30)))
        rows.append((dice.choice(["en", "en", "de", None]), dice.choice(sources), text))
    return rows


def test_terms():
    assert source_audit.terms("AbÄc_dE9f\x7f Z".encode()) == ["abÄc".encode(), b"de", b"f", " z".encode()]
    assert source_audit.terms(b"") == source_audit.terms(b" 1_\x00\n") == []


@pytest.mark.parametrize("how", [{}, {"block": 2, "deal_rows": 7}, {"block": 3, "deal_rows": 50}, {"leading": 2}])
def test_against_plain_counts(spark, how):
    rows = corpus(1, ["s1", "s2", "s3", "hot", "hot", "hot", None, "ü"])
    rows += [("fr", "one", "seul"), ("it", "a", None), ("it", "b", ""), ("it", "c", "12 34"), ("xx", "a", "few words"), ("xx", "b", "few")]
    assert found(spark, rows, **how) == brute(rows, leading=how.get("leading", 200))


def test_nulls_empty_ties_repeats_and_long_texts(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None, None)]) == []
    same = [("en", s, "alpha beta beta") for s in ("a", "b", "c") for _ in range(3)]
    assert found(spark, same) == brute(same)
    long = [("en", "a", "wa wb " * 200_000), ("en", "b", "wa " * 10 + "q" * 300_000)] + corpus(3, ["a", "b"], 40)
    assert found(spark, long) == brute(long)


def test_held_rows_are_given_out_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_audit, "HELD_TERMS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en", "de"]), pa.array(["a", "a", "b"]), pa.array([b"x y", b"y z", b""], pa.binary())], ["lang", "source", "text"])
    rows = [tuple(r.values()) for b in source_audit._counted([batch]) for r in b.to_pylist()]
    assert sorted(rows, key=str) == sorted([("en", "a", b"x", 1, 1), ("en", "a", b"y", 2, 2), ("en", "a", b"z", 1, 1), ("en", "a", None, 0, 0), ("de", "b", None, 0, 0)], key=str)
