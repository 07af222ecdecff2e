"""Benchmark decontamination with an FM-index for each training shard.

A task cuts its documents into shards of about ``SHARD_WORDS`` words and indexes each over its words: the Burrows-Wheeler
transform of the suffix order is held in a wavelet matrix that answers how often a word occurs before a place, and every
``SAMPLE``-th text position (and each document's first) is stored with its suffix. Test phrases are found by backward search,
one step for all phrases at a time; their occurrences are located by stepping back to a stored position; overlapping ones are
merged into removal spans.

A phrase is a window of ``WINDOW`` consecutive words of a benchmark item, or the whole item if it has fewer words (but not
none). Documents are never cut at a shard border; a shard also ends with its Arrow batch. The benchmark is broadcast in blocks of at most ``BLOCK_CHARS`` characters
(or one item) of it, as numbered words and ends of windows (``Windows``); more blocks are further steps over the same rows, each adding what it finds. A step is written to the shared
folder and its broadcast is destroyed before the next block is read, so the driver holds one block at a time.

Defined results: null and empty texts have no words and no hits; items without words and null texts are never found; equal
items are found together; an item with a null id is hit and removed as any other, but has no id to list; repeated rows get a result each; an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import give_back, let_go, saved, schema_of

WINDOW = 10
SHARD_WORDS = 1 << 20
SAMPLE = 16
BLOCK_CHARS = 4_000_000
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<first_word:int,end_word:int,start:int,end:int>>"

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: On UTF-8: A-Z to a-z, what is no part of a word to a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Windows:
    """Windows of items over numbered words, ordered by their words from the last to the first.

    The words stand once, item after item; a window is its end and its length there, with its item. So a block takes about 20
    bytes a word beside its vocabulary, and 60 more while it is put in order.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        number: dict[bytes, int] = defaultdict(count().__next__)
        text, sizes = array("i"), array("q")
        self.items: list[str | None] = []
        for item, words in items:
            self.items.append(item)
            sizes.append(len(words))
            text.extend(map(number.__getitem__, words))
        self.vocabulary, self.text = list(number), np.array(text, "i4")
        size = np.array(sizes, "i8")
        times = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        self.owner = np.repeat(np.arange(len(size), dtype="i4"), times)
        self.length = np.minimum(size, window).astype("i4")[self.owner]
        first = np.cumsum(size) - size - np.cumsum(times) + times
        self.end = (first[self.owner] + np.arange(len(self.owner)) + self.length).astype("i4")
        if len(self.end):
            words = (np.where(k < self.length, self.text[np.maximum(self.end - 1 - k, 0)], -1) for k in range(int(self.length.max())))
            order = np.lexsort([*words][::-1])
            self.end, self.length, self.owner = self.end[order], self.length[order], self.owner[order]


class Ranks:
    """Ones before a place in a bit vector."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view("u1")[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, "i8")
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, place: np.ndarray) -> np.ndarray:
        block = place >> 6
        below = (np.uint64(1) << (place & 63).astype("u8")) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)

    def bit(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype("u8")) & np.uint64(1)


class WaveletMatrix:
    """Access and rank over a sequence of numbers, one bit vector for each bit from the highest."""

    def __init__(self, sequence: np.ndarray, largest: int) -> None:
        self.shifts = list(range(max(1, int(largest).bit_length()) - 1, -1, -1))
        self.levels, self.zeros = [], []
        for shift in self.shifts:
            bits = (sequence >> shift) & 1 == 1
            self.levels.append(Ranks(bits))
            low = sequence[~bits]
            self.zeros.append(len(low))
            sequence = np.concatenate([low, sequence[bits]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        first = np.zeros_like(place)
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros):
            one = (symbol >> shift) & 1 == 1
            a, b = level.ones(first), level.ones(place)
            first = np.where(one, zeros + a, first - a)
            place = np.where(one, zeros + b, place - b)
        return place - first

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbol, first = np.zeros_like(place), np.zeros_like(place)
        for level, zeros in zip(self.levels, self.zeros):
            one = level.bit(place) == 1
            a, b = level.ones(first), level.ones(place)
            first = np.where(one, zeros + a, first - a)
            place = np.where(one, zeros + b, place - b)
            symbol = symbol * 2 + one
        return symbol, place - first


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions by the order of their suffixes; 0 ends a document and no two ends are equal.

    Prefix doubling: suffixes ordered by their first words are told apart by the order of what follows. Only those that
    are not told apart yet are sorted again.
    """
    n = len(text)
    ends = text == 0
    rank = text.astype("i4") + np.int32(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    bits = int(rank.max()).bit_length()
    width = max(1, 62 // max(1, bits))  # words of which one number holds the order
    key = np.zeros(n, "i8")
    for k in range(min(width, n)):
        key[: n - k] |= rank[k:].astype("i8") << (bits * (width - 1 - k))
    order = np.argsort(key).astype("i4")
    at, open_ = order, np.arange(n, dtype="i4")
    key = key[order]
    while True:
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(fresh)
        rank[at] = np.repeat(open_[starts], np.diff(np.append(starts, len(at))))
        open_ = open_[~(fresh & np.append(fresh[1:], True))]  # places in the order that still tie
        if not len(open_):
            return order
        at = order[open_]
        key = rank[at].astype("i8") * n + rank[np.minimum(at + width, n - 1)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at  # the ties of one rank fill the places from that rank on
        width *= 2


class Shard:
    """Documents as numbers of their words, each ended by 0; the words themselves stand once."""

    def __init__(self, documents: Iterable[list[bytes]] = ()) -> None:
        self.number: dict[bytes, int] = defaultdict(count(1).__next__)
        self.text, self.starts = array("i"), array("q")
        for words in documents:
            self.add(words)

    def add(self, words: list[bytes]) -> None:
        self.starts.append(len(self.text))
        self.text.extend(map(self.number.__getitem__, words))
        self.text.append(0)


class FMIndex:
    """Index over the words of a shard."""

    def __init__(self, shard: Shard) -> None:
        self.number, self.starts = dict(shard.number), np.array(shard.starts, "i8")
        text = np.array(shard.text, "i4")
        order = suffix_order(text)
        self.size = len(text)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.number) + 1))]).astype("i8")
        self.last = WaveletMatrix(text[order - 1], len(self.number))
        sampled = np.zeros(self.size, bool)
        sampled[::SAMPLE] = True
        sampled[self.starts] = True
        stored = sampled[order]
        self.marked, self.stored = Ranks(stored), order[stored]

    def search(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For windows that occur: their number and the interval of their suffixes.

        Only the vocabulary is looked up word by word. A window with a word that is not in the shard is left out before the
        first step, and windows that end alike take their common steps once: they stand beside each other.
        """
        text = np.fromiter((self.number.get(w, 0) for w in windows.vocabulary), "i8", len(windows.vocabulary))[windows.text]
        missing = np.concatenate([[0], np.cumsum(text == 0)])
        which = np.flatnonzero(missing[windows.end] == missing[windows.end - windows.length])
        end, length = windows.end[which], windows.length[which]
        low, high = np.zeros(len(which), "i8"), np.full(len(which), self.size, "i8")
        active, step = np.arange(len(which)), 0
        while len(active):
            step += 1
            state = np.stack([text[end[active] - step], low[active], high[active]])
            fresh = np.append(True, (state[:, 1:] != state[:, :-1]).any(0))
            symbol, a, b = state[:, fresh]
            node = np.cumsum(fresh) - 1
            low[active] = (self.below[symbol] + self.last.rank(symbol, a))[node]
            high[active] = (self.below[symbol] + self.last.rank(symbol, b))[node]
            active = active[(low[active] < high[active]) & (length[active] > step)]
        found = np.flatnonzero(low < high)
        return which[found], low[found], high[found]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a stored one."""
        rows, steps = rows.copy(), np.zeros(len(rows), "i8")
        walking = np.flatnonzero(self.marked.bit(rows) == 0)
        while len(walking):
            symbol, before = self.last.access(rows[walking])
            rows[walking] = self.below[symbol] + before
            steps[walking] += 1
            walking = walking[self.marked.bit(rows[walking]) == 0]
        return self.stored[self.marked.ones(rows)] + steps


def search_shard(shard: Shard, windows: Windows) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """For each document: the items found in it, and the merged spans of its words."""
    result: list[tuple[list[str], list[tuple[int, int]]]] = [([], []) for _ in shard.starts]
    index = FMIndex(shard)
    which, low, high = index.search(windows)
    if not len(which):
        return result
    length = windows.length[which]
    # Equal windows stand beside each other and are located once.
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (length[1:] != length[:-1])))
    owners = np.split(windows.owner[which], first[1:])
    low, length, times = low[first], length[first], (high - low)[first]
    row = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
    phrase, position = np.repeat(np.arange(len(first)), times), index.locate(row)
    document = np.searchsorted(index.starts, position, "right") - 1
    for d, p in np.unique(np.stack([document, phrase], 1), axis=0).tolist():
        result[d][0].extend(windows.items[k] for k in owners[p].tolist() if windows.items[k] is not None)
    cover = np.bincount(position, minlength=index.size + 1) - np.bincount(position + length[phrase], minlength=index.size + 1)
    inside = np.concatenate([[0], np.cumsum(cover) > 0, [0]]).astype("i1")
    edge = np.flatnonzero(np.diff(inside))
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        d = int(np.searchsorted(index.starts, start, "right")) - 1
        result[d][1].append((start - int(index.starts[d]), end - int(index.starts[d])))
    return result


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _with_places(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of words with their code points in the text."""
    if not spans:
        return []
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    return [{"first_word": a, "end_word": b, "start": places[a][0], "end": places[b - 1][1]} for a, b in spans]


def items_of(benchmark: DataFrame, item_id: str, text: str, most: int) -> tuple[DataFrame, int]:
    """(item, text) of the items with a text, and the number of blocks of about ``most`` characters at the most."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    return items, 1 + int(total) // most


def blocks_of(items: DataFrame, blocks: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks, read one at a time."""
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        if rows:
            yield [tuple(r) for r in rows]


def find(docs: DataFrame, keep: list[str], benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` columns, number of words and of hit words, ids of the items found (as sorted strings) and removal spans."""
    at_text = keep.index(text) if text in keep else len(keep)
    source = docs.select(*keep, *([] if text in keep else [F.col(text).cast("string").alias("_text")]))
    out = StructType([*source.schema.fields, *schema_of(FOUND).fields])
    found = source.withColumns({f.name: F.lit(None).cast(f.dataType) for f in out.fields[len(source.columns) :]})
    arrow = to_arrow_schema(out)
    spark = docs.sparkSession
    items, blocks = items_of(benchmark, item_id, item_text, block_chars)
    told = None
    for block in blocks_of(items, blocks):
        told = spark.sparkContext.broadcast(Windows(((item, words_of(text)) for item, text in block), window))
        found = found.mapInArrow(_searcher(told, at_text, len(source.columns), arrow, shard_words), out)
        if blocks > 1:
            found = saved(found, "decontaminated")
            told.destroy()
    if told is None:  # an empty block counts the words where there is no benchmark
        found = found.mapInArrow(_searcher(spark.sparkContext.broadcast(Windows([])), at_text, len(source.columns), arrow, shard_words), out)
    return found.select(*keep, *(f.name for f in out.fields[len(source.columns) :]))


def _searcher(block, at_text: int, width: int, schema: pa.Schema, shard_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        windows = block.value

        def result(piece: pa.RecordBatch, shard: Shard) -> pa.RecordBatch:
            texts, earlier_items, earlier_spans = (piece.column(k).to_pylist() for k in (at_text, width + 2, width + 3))
            columns: list[list] = [[], [], [], []]
            sizes = (np.diff([*shard.starts, len(shard.text)]) - 1).tolist()
            for text, size, old, old_spans, (new, spans) in zip(texts, sizes, earlier_items, earlier_spans, search_shard(shard, windows)):
                spans = merged(spans + [(s["first_word"], s["end_word"]) for s in old_spans or []])
                values = (size, sum(b - a for a, b in spans), sorted({*new, *(old or [])}), _with_places(text, spans))
                for column, value in zip(columns, values):
                    column.append(value)
            arrays = [c.cast(f.type) for c, f in zip(piece.columns[:width], schema)]
            arrays += [pa.array(c, f.type) for c, f in zip(columns, list(schema)[width:])]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            shard, first = Shard(), 0
            for at, text in enumerate(t.as_py() for t in batch.column(at_text)):
                shard.add(words_of(text))
                if len(shard.text) - len(shard.starts) >= shard_words or at + 1 == batch.num_rows:
                    yield result(batch.slice(first, at + 1 - first), shard)
                    shard, first = Shard(), at + 1
            give_back()

    return run


def digests(found: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the counts, a digest of the item ids, and whether anything was hit."""
    return found.select(
        *keep,
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut(text: Column, spans: Column) -> Column:
    """The text without its removal spans."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda done, s: F.struct(s["end"].alias("at"), F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"])).alias("out"))
    rest = lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))
