"""BPE encoding and decoding with a contiguous rank array.

A short word is held as a list of part boundaries and a list with the rank of each adjacent pair. The smallest rank is
looked for again and again, its inner boundary is deleted and the two neighbouring ranks are refreshed. Words over
``LONG_WORD`` bytes take the same merges from a heap over linked parts, so that their time doesn't grow with the square
of their length. Each distinct word is merged once per task and cache filling.

Defined results: a null text counts as empty, an empty text has no ids and decodes to the empty text, repeated rows and
ids give repeated results, other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, held_by_worker, map_texts

# The word pattern of this vocabulary family, as published.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes from which the heap takes over from the scan.
LONG_WORD = 192
NO_RANK = 1 << 40


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary of 50,257 entries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _MoreSpace(Exception):
    """A chunk begins or ends with white space or is empty."""


class Codec:
    """A vocabulary: ranks of pairs, ids of parts and bytes of ids."""

    def __init__(self, description: str) -> None:
        told = json.loads(description)
        byte_of = _byte_of_char()
        raw = lambda token: bytes(byte_of[c] for c in token)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"])
        pairs = [(raw(a), raw(b)) for a, b in pairs]
        # A pair is looked up by its joined bytes; left[rank] says where the pair of that rank is divided.
        self.rank = {a + b: i for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.left = [len(a) for a, _ in pairs]
        if len(self.rank) != len(pairs):
            raise ValueError("this codec needs a vocabulary in which each part has one merge")
        self.id_of = {raw(token): i for token, i in told["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for part, i in self.id_of.items():
            self.bytes_of[i] = part
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.words = regex.compile(WORD)
        ordered = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile(f"({'|'.join(map(re.escape, ordered))})") if ordered else None
        self.packed = Cache(lambda word: struct.pack(f"<{len(ids := self.merge(word.encode()))}I", *ids))
        self.spaced = Cache(self._spaced, 600_000)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        if len(word) > LONG_WORD:
            return self._merge_long(word)
        rank, left = self.rank.get, self.left
        bounds = list(range(len(word) + 1))
        ranks = [rank(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            at, to = bounds[i], bounds[i + 1]
            if i:
                r = rank(word[bounds[i - 1] : to], NO_RANK)
                ranks[i - 1] = r if r == NO_RANK or left[r] == at - bounds[i - 1] else NO_RANK
            if i < len(ranks):
                r = rank(word[at : bounds[i + 2]], NO_RANK)
                ranks[i] = r if r == NO_RANK or left[r] == to - at else NO_RANK
        return [self.id_of[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _merge_long(self, word: bytes) -> list[int]:
        rank, n = self.rank.get, len(word)
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once it is merged away
        before = list(range(-1, n - 1))
        waiting: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := rank(word[i : end[j]], NO_RANK)) != NO_RANK and self.left[r] == j - i:
                heapq.heappush(waiting, (r, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, j, stop = heapq.heappop(waiting)
            if end[i] != j or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        ids, i = [], 0
        while i < n:
            ids.append(self.id_of[word[i : end[i]]])
            i = end[i]
        return ids

    def _spaced(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _MoreSpace
        return self._words(" " + chunk)

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.words.findall(text)))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        A word of the pattern never runs over a single space with no white space beside it, except to take that space in
        front. So the text is cut there and equal chunks are encoded once; a text with more white space goes whole.
        """
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self._words(text)
        try:
            return self._words(first) + b"".join(map(self.spaced.__getitem__, rest))
        except _MoreSpace:
            return self._words(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        parts = enumerate(self.specials.split(text))
        return b"".join(struct.pack("<I", self.special[part]) if i % 2 else self._plain(part) for i, part in parts)

    def decode(self, ids: bytes | None) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        numbers = np.frombuffer(ids or b"", "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


def codec_maker(df: DataFrame, vocabulary: str | None) -> Callable[[], Codec]:
    """Makes the codec inside a task from the vocabulary file, which is read once here and broadcast.

    The file has a fixed size, so the broadcast doesn't grow with the data. The worker keeps the codec for its next tasks, with the
    words it has merged, until another operator has something to keep.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as file:
        text = file.read()
    told, name = df.sparkSession.sparkContext.broadcast(text), f"codec {hashlib.sha256(text.encode()).hexdigest()}"
    return lambda: held_by_worker(name, lambda: Codec(told.value))


def encode(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns and ``ids`` (binary, little-endian unsigned 32-bit integers) of each text."""
    make = codec_maker(df, vocabulary)

    def start():
        codec = make()
        return lambda t: (codec.encode(t),)

    return map_texts(df, keep, text, start, "ids binary")


def decode(df: DataFrame, keep: list[str], ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns and ``decoded`` (string) of each row's ids; null ids decode to the empty text."""
    make = codec_maker(df, vocabulary)

    def start():
        codec = make()
        return lambda packed: (codec.decode(bytes.fromhex(packed) if packed else b""),)

    return map_texts(df.withColumn(ids, F.hex(ids)), keep, ids, start, "decoded string")


def round_trip(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns, ``ids`` and the text ``decoded`` from them, in one pass."""
    make = codec_maker(df, vocabulary)

    def start():
        codec = make()

        def handle(t):
            ids = codec.encode(t)
            return ids, codec.decode(ids)

        return handle

    return map_texts(df, keep, text, start, "ids binary, decoded string")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns and ``n_tokens``, the encoded length of each text."""
    make = codec_maker(df, vocabulary)

    def start():
        codec = make()
        return lambda t: (len(codec.encode(t)) // 4,)

    return map_texts(df, keep, text, start, "n_tokens long")


def digests(encoded: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, number of tokens and SHA-256 of ids and decoded text of a ``round_trip`` result."""
    return encoded.select(
        *keep,
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
