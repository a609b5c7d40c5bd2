"""64-bit hashes of the words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.default_rng(20240611)
_LETTER = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)
#: A-Z in lower case; tab to carriage return and space are white space, all else belongs to words.
SPACED = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if 0x09 <= c <= 0x0D else c for c in range(256))
#: A-Z in lower case; digits, letters and all bytes beyond ASCII belong to words.
LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def _power(n: int) -> np.ndarray:
    """_STEP ** 0 .. n - 1, modulo 2 ** 64; grows with the longest word seen."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        factors = np.full(size, _STEP, np.uint64)
        factors[0] = 1
        _powers = np.cumprod(factors, dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes | None], table: bytes = SPACED, initials: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all words in order, and where each text's words start (one more entry than texts).

    ``table`` maps bytes as ``bytes.translate``; spaces separate words. With
    ``initials`` also a hash of the first two bytes of each word, or of its only one and a space.
    """
    joined = b" ".join([t.translate(table) if t else b"" for t in texts]) + b" "
    codes = np.frombuffer(joined, np.uint8)
    inside = codes != 0x20
    begin = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
    starts = np.searchsorted(begin, offsets)
    if not len(begin):
        return (np.empty(0, np.uint64), starts) + (np.empty(0, np.uint64),) * initials
    end = np.flatnonzero(inside & np.concatenate((~inside[1:], [True]))) + 1
    size = end - begin
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    letters = codes[inside]
    place = np.arange(len(letters)) - np.repeat(first, size)
    values = _LETTER[letters] * _power(int(size.max()))[place]
    hashes = mixed(np.add.reduceat(values, first) + size.astype(np.uint64))
    if not initials:
        return hashes, starts
    return hashes, starts, mixed(codes[begin].astype(np.uint64) * np.uint64(256) + codes[begin + 1])


def portions(texts: list[bytes | None], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is one range."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def shingle_sets(texts: list[bytes | None], size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    for a, b in portions(texts):
        hashes, starts = word_hashes(texts[a:b])
        n = max(len(hashes) - size + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for j in range(size):
            rolled += hashes[j : j + n] * _PLACES[j]
        rolled = mixed(rolled)
        for i in range(b - a):
            lo, hi = int(starts[i]), int(starts[i + 1])
            if hi - lo >= size:
                yield np.unique(rolled[lo : hi - size + 1])
            elif hi > lo:
                whole = (hashes[lo:hi] * _PLACES[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo) * _PLACES[63]
                yield mixed(np.array([whole], np.uint64))
            else:
                yield np.empty(0, np.uint64)


class Lookup:
    """Positions of unsigned 64-bit keys by open addressing, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.bits = max(int(4 * self.n - 1).bit_length(), 4)
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        left, slot, self.probes = np.arange(self.n), self._slot(self.keys[:-1]), 0
        while len(left):
            self.probes += 1
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            placed = self.slots[slot] == left
            left, slot = left[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _STEP) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or the number of keys where absent."""
        slot = self._slot(keys)
        at = self.slots[slot]
        out = np.where(at >= 0, at, self.n)
        open_ = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.slots[slot[open_]]
            out[open_] = np.where(at >= 0, at, self.n)
            open_ = open_[(at >= 0) & (self.keys[at] != keys[open_])]
        out[open_] = self.n
        return out


def spelled(texts: list[bytes | None], order: int, table: bytes = LETTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every byte of every word, and its end, packed with up to ``order`` - 1 bytes before it.

    A space stands for the start and the end of a word; no gram reaches beyond
    its word. Gives the grams in order, where each text's grams start, and the
    number of words of each text.
    """
    joined = b" " + b" ".join([t.translate(table) if t else b"" for t in texts]) + b" "
    codes = np.frombuffer(joined, np.uint8)
    letter = codes != 0x20
    wanted = letter[1:] | letter[:-1]
    packed = codes[1:].astype(np.uint64)
    inside = np.ones(len(packed), bool)
    for j in range(1, min(order, len(codes))):
        earlier = np.zeros(len(packed), np.uint64)
        earlier[j - 1 :] = codes[: len(codes) - j]
        packed |= np.where(inside, earlier << np.uint64(8 * j), np.uint64(0))
        before = np.zeros(len(packed), bool)
        before[j - 1 :] = letter[: len(codes) - j]
        inside &= before
    offsets = np.concatenate(([0], np.cumsum([(len(t) if t else 0) + 1 for t in texts])))
    starts = np.concatenate(([0], np.cumsum(wanted)))[offsets]
    words = np.diff(np.concatenate(([0], np.cumsum(letter[:-1] & ~letter[1:])))[offsets])
    return packed[wanted], starts, words
