"""Source divergence audit: how far the words of each (language, source) group lie from those of other groups.

A translate table lowers A-Z and blanks all ASCII separators of a text's UTF-8 bytes in one pass; ``bytes.split`` gives the terms,
a Counter per document their frequencies. Documents of a task are summed by (group, term) before they leave it, so what is
shuffled is sparse counts, and a group with a third of all documents is only more of these.

A language keeps the terms in at least ``LEAST_DOCS`` of its documents. In a group with N kept occurrences, of V kept terms of its
language, a term with n occurrences has p = 1 + floor(10^9 (n + 1) / (N + V)), and p of one group beside q of another counts
floor((p - q)^2 / q). All of it is whole numbers.

* Part ``pair`` sums this over all kept terms, for each other source of the language. Terms that neither source has all count the same,
  so only terms that occur are handled: they are dealt by hash, each deal holds up to ``BLOCK`` sources a side as a dense
  matrix of terms by sources, and its sums per pair of sources are added. No pair of sources is a row before it is a sum.
* Part ``term`` gives the terms of a group that stand above the language's own share, the ``LEADING`` first of them.

Defined results: null text, language and source count as ''; texts without a term (empty ones too) still make their group occur; a
group without kept terms has N = 0, a language without any gives 0 for its pairs and no terms; repeated rows and ids are documents
of their own; ties go to the item that is smaller in UTF-8; very long texts are counted whole, one at a time; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

LEAST_DOCS = 3
LEADING = 200
SCALE = 1_000_000_000
#: A task sums what it has counted when it holds so many (document, term) rows or has read so many bytes since.
HELD_TERMS, HELD_BYTES = 300_000, 32 << 20
#: Sources on each side of a matrix, and (term, source) rows of one deal.
BLOCK, DEAL_ROWS = 256, 100_000
#: Cells of a matrix that are computed at a time.
CELLS = 1 << 20

#: A-Z become a-z; of the other bytes only a-z and those of characters beyond ASCII stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def _summed(names: list[tuple[str, str]], groups: list[int], sizes: list[int], words: list[bytes], times: list[int]) -> pa.RecordBatch:
    """One row per (group, term) held, and one with a null term per group."""
    held = pa.table({"g": np.repeat(np.array(groups, "i4"), sizes), "term": pa.array(words, pa.binary()), "n": pa.array(times, pa.int64())})
    summed = held.group_by(["g", "term"]).aggregate([("n", "sum"), ("n", "count")])
    occur = np.unique(np.array(groups, "i4"))
    at = pa.array(np.concatenate([summed.column("g").to_numpy(), occur]))
    none = pa.nulls(len(occur), pa.binary())
    zeros = pa.array(np.zeros(len(occur), "i8"))
    columns = [pa.array([x[k] for x in names], pa.string()).take(at) for k in (0, 1)]
    for name, rest in (("term", none), ("n_sum", zeros), ("n_count", zeros)):
        columns.append(pa.concat_arrays([*summed.column(name).chunks, rest]))
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers: dict[tuple[str, str], int] = {}
    groups, sizes, words, times, read = [], [], [], [], 0
    for batch in batches:
        for row in range(batch.num_rows):
            lang, source, text = (batch.column(k)[row].as_py() for k in range(3))
            found = Counter(terms(text))
            groups.append(numbers.setdefault((lang, source), len(numbers)))
            sizes.append(len(found))
            words.extend(found)
            times.extend(found.values())
            read += len(text)
            if len(words) >= HELD_TERMS or read >= HELD_BYTES:
                yield _summed(list(numbers), groups, sizes, words, times)
                numbers, groups, sizes, words, times, read = {}, [], [], [], [], 0
    if groups:
        yield _summed(list(numbers), groups, sizes, words, times)


def term_counts(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and documents that have it; a null term per group."""
    told = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = df.select(told(lang).alias("lang"), told(source).alias("source"), told(text).cast("binary").alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """p of a term with n of a group's total occurrences; 1 where the language keeps no term."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.when(kept > 0, F.lit(1) + F.call_function("div", whole, (total + kept).cast("decimal(20,0)"))).otherwise(F.lit(1).cast("long"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _summing(block_size: int):
    """Function for the rows of one cell: two blocks of sources, one deal of terms."""

    def sums_of(key: tuple, rows: pa.Table) -> pa.Table:
        """For each ordered pair of sources of one cell: its terms' values, less what the same number of absent terms would count."""
        lang, first, second = (k.as_py() for k in key[:3])
        block, spot, p = (rows.column(c).to_numpy() for c in ("block", "spot", "p"))
        at = spot + block_size * (block != first)
        width = 2 * block_size if second != first else block_size
        absent = np.zeros(width, "i8")
        heads = rows.column("term").is_null().to_numpy()
        absent[at[heads]] = p[heads]
        held = np.flatnonzero(absent)  # p is 1 at least, so these are the sources that there are
        code = rows.column("term").combine_chunks().filter(pa.array(~heads)).dictionary_encode().indices.to_numpy()
        order = np.argsort(code, kind="stable")
        code, spots, p = code[order], at[~heads][order], p[~heads][order]
        sides = [(held, held)] if second == first else [(x, y) for x, y in ((held[held < block_size], held[held >= block_size]),) for x, y in ((x, y), (y, x))]
        of, other, value = [], [], []
        sums = {k: [np.zeros(len(others), "i8") for _ in own] for k, (own, others) in enumerate(sides)}
        step = max(1, CELLS // width)
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, step):
            a, b = np.searchsorted(code, (low, low + step))
            matrix = np.tile(absent, (min(step, int(code[-1]) + 1 - low), 1))
            matrix[code[a:b] - low, spots[a:b]] = p[a:b]
            for k, (own, others) in enumerate(sides):
                beside = matrix[:, others]
                for j, s in enumerate(own):
                    apart = matrix[:, s, None] - beside
                    sums[k][j] += (apart * apart // beside).sum(axis=0) - len(matrix) * ((absent[s] - absent[others]) ** 2 // absent[others])
        number = lambda spots: np.where(spots < block_size, first * block_size + spots, second * block_size + spots - block_size)
        for k, (own, others) in enumerate(sides):
            for j, s in enumerate(own):
                keep = others != s
                of.append(np.repeat(number(s), keep.sum()))
                other.append(number(others[keep]))
                value.append(sums[k][j][keep])
        joined = [np.concatenate(x).astype("i8") if x else np.zeros(0, "i8") for x in (of, other, value)]
        return pa.table({"lang": pa.array([lang] * len(joined[0]), pa.string()), "own": joined[0], "other": joined[1], "value": joined[2]})

    return sums_of


def _pairs(kept: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """(lang, source, item, value): each source beside each other source of its language."""
    placed = groups.select("lang", "source", F.expr(f"cast(no div {block} as int)").alias("block"), (F.col("no") % block).cast("int").alias("spot"), "blocks", "deals", "p0", "own_n", "kept_terms")
    every = F.explode(F.expr("sequence(0, deals - 1)"))
    heads = placed.select("lang", "block", "spot", "blocks", every.alias("deal"), F.lit(None).cast("binary").alias("term"), F.col("p0").alias("p"))
    deal = F.pmod(F.xxhash64("term"), F.col("deals")).cast("int").alias("deal")
    found = kept.join(placed, ["lang", "source"]).select("lang", "block", "spot", "blocks", deal, "term", _share(F.col("n"), F.col("own_n"), F.col("kept_terms")).alias("p"))
    # A block meets each block of its language once; the smaller number stands first.
    met = heads.union(found).withColumn("_other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = met.select("lang", F.least("block", "_other").alias("a"), F.greatest("block", "_other").alias("b"), "deal", "block", "spot", "term", "p")
    summed = cells.groupBy("lang", "a", "b", "deal").applyInArrow(_summing(block), "lang string, own long, other long, value long").groupBy("lang", "own", "other").agg(F.sum("value").alias("sum"))
    mine = groups.select("lang", F.col("no").alias("own"), "source", F.col("p0").alias("_p"), "kept_terms")
    theirs = groups.select("lang", F.col("no").alias("other"), F.col("source").alias("item"), F.col("p0").alias("_q"))
    return summed.join(mine, ["lang", "own"]).join(theirs, ["lang", "other"]).select("lang", "source", "item", (F.col("sum") + F.col("kept_terms") * _apart(F.col("_p"), F.col("_q"))).alias("value"))


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, leading: int = LEADING, block: int = BLOCK, deal_rows: int = DEAL_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups."""
    counts = saved(term_counts(df, lang, source, text), "term-counts")
    # The rows of one term are at most one per source.
    whole = Window.partitionBy("lang", "term")
    kept = (
        counts.where("term is not null")
        .withColumns({"_docs": F.sum("docs").over(whole), "lang_term_n": F.sum("n").over(whole), "_first": F.row_number().over(whole.orderBy("source"))})
        .where(F.col("_docs") >= least_docs)
    )
    kept = saved(kept.select("lang", "source", "term", "n", "lang_term_n", (F.col("_first") == 1).alias("first")), "kept-terms")
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("first").alias("kept_terms"), F.count("*").alias("rows"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    named = counts.where("term is null").select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("no"))
    sources = named.groupBy("lang").agg(F.expr(f"cast(1 + max(no) div {block} as int)").alias("blocks"))
    groups = named.join(sources, "lang").join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0, ["lang_n", "kept_terms", "rows", "own_n"])
    # A cell holds at most two blocks of sources, each with one row a term.
    deals = F.expr(f"cast(1 + least(rows, {2 * block} * kept_terms) div {deal_rows} as int)")
    groups = saved(groups.withColumns({"p0": _share(F.lit(0), F.col("own_n"), F.col("kept_terms")), "deals": deals}), "groups")

    p, q = F.col("p"), F.col("q")
    shares = kept.join(groups.select("lang", "source", "own_n", "lang_n", "kept_terms"), ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("own_n"), F.col("kept_terms")).alias("p"), _share(F.col("lang_term_n"), F.col("lang_n"), F.col("kept_terms")).alias("q")
    )
    above = shares.where(p > q).select("lang", "source", F.col("term").alias("item"), _apart(p, q).alias("value"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), F.col("item").cast("string").alias("item"), "value", "rank")

    pairs = saved(_pairs(kept, groups, block), "source-pairs")
    return ranked(pairs, "pair").union(ranked(above, "term").where(F.col("rank") <= leading))
