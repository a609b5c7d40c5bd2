"""Packing of documents into sequences: patterns of few lengths fitted to the histogram of lengths.

1. A document's ids with the end id make one piece, or several if it is longer
   than a sequence: then only the first may be shorter than a sequence.
2. Spark counts the pieces of every length: at most ``size`` numbers, however
   many documents there are. The histogram alone goes to the driver.
3. ``fit`` lists every way to fill a sequence with up to three lengths and
   finds how often to repeat each by non-negative least squares against the
   histogram (accelerated projected gradients; long lengths weigh more, as short
   pieces find room anywhere). The repeats are rounded along the list, the error
   carried on to the next, alike pattern, and never exceed what there is. A few
   shares of the fit are rounded and finished; the one with fewest sequences stays.
4. ``best_fit`` packs the pieces that no pattern took, longest first, into the
   fullest sequence with room. It works on numbers of equal sequences.
5. A piece finds its place by its rank among the pieces of its length.

Steps 3 and 4 depend on the sequence's size, not on the data: 87,000 patterns
and a second or two at 1,024.

Defined results: null and empty texts have the end id only. Rows without key or
that repeat a key are packed like others. Other columns, of whatever name, are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationlake.llm.frames import stored
from stationlake.llm.tokenfiles import Encoder

#: Parts of the fitted repeats that are tried: a smaller one leaves more pieces to best fit.
SHARES = (1.0, 0.97, 0.9, 0.8)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of pieces of documents with ``n`` ids, and each piece's start and length."""
    count = -(-n // size)
    head = n - (count - 1) * size
    first = np.cumsum(count) - count
    number = np.arange(int(count.sum())) - np.repeat(first, count)
    begin = np.where(number == 0, 0, np.repeat(head, count) + (number - 1) * size)
    return count, begin, np.where(number == 0, np.repeat(head, count), size)


@lru_cache(maxsize=1)
def encoder(tokenizer_file: str, words: int = 1_000_000) -> Encoder:
    """One encoder for all tasks of a worker process; ``words`` are kept, some 250 MB."""
    return Encoder(tokenizer_file, words)


def _cutter(tokenizer_file: str, end: int, size: int, texts_at_once: int = 250):
    def run(batches):
        encode, part = encoder(tokenizer_file), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            names = batch.column("doc_id")
            for begin in range(0, batch.num_rows, texts_at_once):
                texts = [t or "" for t in batch.column("text").slice(begin, texts_at_once).to_pylist()]
                ids, n = encode(texts, end)
                count, start, length = cut(n, size)
                # The ids of all texts stand in one row, in order: so do the pieces.
                ends = np.cumsum(length)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist())]
                # The rank of a piece among those of its length in this task.
                order = np.argsort(length, kind="stable")
                of = length[order]
                new = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                nth = np.empty(len(of), np.int64)
                nth[order] = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of)))) + seen[of]
                seen += np.bincount(length, minlength=size + 1)
                number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(begin, texts_at_once).take(pa.array(np.repeat(np.arange(len(n)), count))),
                        pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                        pa.array(np.full(len(of), part, np.int32)), pa.array(nth),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return run


def pieces(docs: DataFrame, tokenizer_file: str, end: int, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents, with their rank ``nth`` among those of their length in the same ``part``."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_cutter(tokenizer_file, end, size), PIECES)


def patterns(lengths: np.ndarray, size: int, most: int = 3) -> np.ndarray:
    """All ways to fill ``size`` with two to ``most`` (at most three) of the lengths: rows in falling order, 0 where none is.

    The list begins with the longest first length; the next pattern differs as little as it can.
    """
    has = np.zeros(size + 1, bool)
    has[lengths] = True
    found = []
    for a in np.sort(lengths)[::-1].tolist():
        rest = size - a
        if 0 < rest <= a and has[rest]:
            found.append(np.array([[a, rest, 0]]))
        if most > 2:
            b = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
            c = rest - b
            fits = (c > 0) & (c <= b)
            b, c = b[fits], c[fits]
            both = has[b] & has[c]
            found.append(np.stack([np.full(int(both.sum()), a), b[both], c[both]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def fit(counts: np.ndarray, listed: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Repeats x >= 0 of the patterns that minimise the weighted squared difference of their lengths to ``counts``.

    A length of the histogram weighs its share of a sequence. The step is the
    inverse of a bound on the curvature; momentum starts anew when it climbs.
    """
    size = len(counts) - 1
    weight = np.arange(size + 1) / size
    weight[0] = 0
    total = counts.sum()
    if not len(listed) or not total:
        return np.zeros(len(listed))
    goal, columns = counts / total, [listed[:, i] for i in range(3)]
    w2 = weight**2

    def covered(x):
        return sum(np.bincount(c, weights=x, minlength=size + 1) for c in columns)

    # The curvature is at most the largest row sum of A'WA.
    touched = covered(np.ones(len(listed))) * w2
    step = 1 / max(sum(touched[c] for c in columns).max(), 1e-12)
    x = np.zeros(len(listed))
    y, t = x, 1.0
    for _ in range(rounds):
        off = (covered(y) - goal) * w2
        slope = sum(off[c] for c in columns)
        new = np.maximum(y - step * slope, 0)
        if np.dot(slope, new - x) > 0:
            t = 1.0
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / faster * (new - x)
        x, t = new, faster
    return x * total


def rounded(x: np.ndarray, listed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeats whose running sum follows that of ``x``, within ``counts``; and what they leave of these."""
    whole = np.diff(np.floor(np.concatenate(([0.0], np.cumsum(x))) + 0.5)).astype(np.int64)
    left, taken = counts.copy(), np.zeros(len(x), np.int64)
    for i in np.flatnonzero(whole).tolist():
        lengths = [v for v in listed[i].tolist() if v]
        n = min([int(whole[i]), *[int(left[v]) // lengths.count(v) for v in set(lengths)]])
        if n:
            taken[i] = n
            for v in lengths:
                left[v] -= n
    return taken, left


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many), packed longest first into the fullest with room.

    Equal sequences are kept as one entry with their number: a length costs as
    many steps as there are kinds of sequences it meets, not pieces.
    """
    size = len(counts) - 1
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    room[size].append(((), 1 << 62))
    spaces = np.zeros(size + 1, bool)
    spaces[size] = True
    for length in range(size, 0, -1):
        m = int(counts[length])
        while m:
            space = length + int(np.argmax(spaces[length:]))
            held, n = room[space].pop()
            each = space // length
            full, some = min(n, m // each), m - each * min(n, m // each)
            parts = [(each, full)]
            if full < n and some:
                parts.append((some, 1))
                some = 0
            m = some
            used = sum(k for _, k in parts)
            if used < n:
                room[space].append((held, n - used))
            for k, many in parts:
                if many:
                    after = space - k * length
                    room[after].append(((*held, *[length] * k), many))
                    spaces[after] = True
            spaces[space] = bool(room[space])
    return [(held, n) for found in room.values() for held, n in found if held]


def plan(counts: np.ndarray, most: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many) that hold exactly the pieces of ``counts`` (by length; 0 unused)."""
    size = len(counts) - 1
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    out = [((size,), int(counts[size]))] if counts[size] else []
    counts[size] = 0
    listed = patterns(np.flatnonzero(counts), size, most)
    fitted, best = fit(counts, listed), None
    for share in SHARES:
        taken, left = rounded(share * fitted, listed, counts)
        rest = best_fit(left)
        total = int(taken.sum()) + sum(n for _, n in rest)
        if best is None or total < best[0]:
            best = total, taken, rest
    _, taken, rest = best
    out += [(tuple(v for v in listed[i].tolist() if v), int(taken[i])) for i in np.flatnonzero(taken).tolist()]
    return out + rest


class Places:
    """For every length, the sequences and offsets that its pieces take, by rank."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]], size: int):
        slots: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]
        before = 0
        for lengths, n in planned:
            at = 0
            for length in lengths:
                slots[length].append((n, before, at))
                at += length
            before += n
        rows = [r for of in slots for r in of]
        self.begins = np.concatenate(([0], np.cumsum([len(of) for of in slots]))).astype(np.int64)
        n, self.first, self.offset = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        ends = np.cumsum(n)
        self.starts = ends - n
        # All lengths in one row of numbers: ranks of a length begin at its own start.
        self.base = np.append(self.starts, ends[-1:] if len(ends) else 0)[np.minimum(self.begins, len(rows))]

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.base[length] + rank
        slot = np.searchsorted(self.starts, at, side="right") - 1
        return self.first[slot] + at - self.starts[slot], self.offset[slot]


def pack(
    docs: DataFrame, tokenizer_file: str, end: int = 2, size: int = 1024, most: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` of every piece.

    Ranks need no sort: a task numbers its own pieces of a length, and the
    numbers of the tasks before it are added by a join on (task, length).
    """
    cuts = stored(pieces(docs, tokenizer_file, end, size, key, text), "pieces")
    tasks = cuts.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for row in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        counts[row["length"]] = row["n"]
    places = Places(plan(counts, most), size)
    of_length = Window.partitionBy("length").orderBy("part")
    before = tasks.select("part", "length", (F.sum("n").over(of_length) - F.col("n")).alias("before"))
    ranked = cuts.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))

    def run(batches):
        for batch in batches:
            ids, offsets = places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(ids), pa.array(offsets)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, schema)
