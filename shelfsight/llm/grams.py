"""Hashes of words and of their character n-grams, for many words at a time, and numbers for words that were met.

A word or n-gram of code points c0, c1, ... has the polynomial c0 + c1 b + c2 b^2 + ... over 64 bits, mixed with its length. So the hashes of
all n-grams of a list of words are a few array operations, and an n-gram's equals that of a word of the same letters.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, length) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (np.asarray(length).astype("u8") * np.uint64(0xD6E8FEB86659FD93))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


class Spelled:
    """The code points of a list of words, one after the other."""

    def __init__(self, words: list[str]) -> None:
        self.points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
        self.sizes = np.fromiter(map(len, words), "i8", len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.points)) - np.repeat(self.starts, self.sizes)
        self.word = np.repeat(np.arange(len(words)), self.sizes)

    def hashes(self) -> np.ndarray:
        """One of each word; the words must not be empty."""
        if not len(self.points):
            return np.zeros(0, "u8")
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(self.sizes.max()) - 1, _BASE)]), dtype="u8")
            return _mixed(np.add.reduceat(self.points * powers[self.place], self.starts), self.sizes)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams in order, and the words they are of."""
        count = len(self.points) - n + 1
        if count <= 0:
            return np.zeros(0, "u8"), np.zeros(0, "i8")
        whole = np.zeros(count, "u8")
        with np.errstate(over="ignore"):
            power = np.uint64(1)
            for j in range(n):
                whole += self.points[j : j + count] * power
                power = power * _BASE
        own = np.flatnonzero(self.place[:count] + n <= self.sizes[self.word[:count]])
        return _mixed(whole[own], n), self.word[own]


class Places(dict):
    """Numbers words in the order in which they are first asked for; the latest wait in ``new``.

    ``tidy`` empties it once it holds ``most`` words or ``most_letters`` letters, so its memory has a bound.
    """

    def __init__(self, most: int, most_letters: int = 1 << 23) -> None:
        super().__init__()
        self.most, self.most_letters, self.letters, self.new = most, most_letters, 0, []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.letters += len(word)
        self.new.append(word)
        return at

    def of(self, words: Iterable[str], count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), "i8", count)

    def taken(self) -> list[str]:
        """The words numbered since the last call."""
        new, self.new = self.new, []
        return new

    def tidy(self) -> bool:
        if len(self) < self.most and self.letters < self.most_letters:
            return False
        self.clear()
        self.letters = 0
        return True


def grown(table: np.ndarray, rows: int) -> np.ndarray:
    """The table with room for so many rows."""
    if rows <= len(table):
        return table
    wider = np.zeros((max(rows, 2 * len(table)), *table.shape[1:]), table.dtype)
    wider[: len(table)] = table
    return wider
