"""Packing: exact pieces, gapless places, few sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stationlake.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


def plain_pieces(docs, size):
    """doc_id, piece, start, length and checksum by the library itself."""
    tokenizer = Tokenizer.from_file(FILE)
    out = []
    for name, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        bounds = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            out.append((name, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=repr)


def check(rows, docs, size):
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == plain_pieces(docs, size)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0, *[n for _, n in places[:-1]]]).tolist()
        assert sum(n for _, n in places) <= size
    return len(held)


@pytest.mark.parametrize("size", [1024, 64])
def test_given_documents(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs, FILE, size=size).collect()
    n = check(rows, [tuple(r) for r in docs.collect()], size)
    # Never fewer than the ids need; at most a thousandth and two sequences more.
    least = -(-sum(r["length"] for r in rows) // size)
    assert least <= n <= least * 1.001 + 2


def test_odd_rows(spark):
    given = [(None, None), (1, ""), (1, ""), (2, "word " * 30_000), (3, "a"), (3, "a"), (None, "a b")]
    docs = spark.createDataFrame([(*g, 1, "x", 2) for g in given], "doc_id long, text string, part int, Piece string, offset int")
    check(packing.pack(docs, FILE).collect(), given, 1024)
    assert packing.pack(docs.limit(0), FILE).collect() == []


def test_plan_holds_the_histogram():
    rng = random.Random(4)
    for _ in range(30):
        size = rng.choice([1, 2, 3, 12, 50])
        counts = np.array([0, *[rng.choice([0, 0, 1, 5, 1000]) for _ in range(size)]])
        planned = packing.plan(counts)
        held = np.zeros(size + 1, int)
        for lengths, n in planned:
            assert n > 0 and sum(lengths) <= size
            np.add.at(held, list(lengths), n)
        assert (held == counts).all()


def test_patterns_are_all_there_are():
    for size, lengths in ((9, range(1, 9)), (12, (2, 3, 4, 6, 10))):
        got = {tuple(v for v in row if v) for row in packing.patterns(np.array(lengths), size).tolist()}
        assert got == {
            tuple(sorted(p, reverse=True))
            for p in [(a, b) for a in lengths for b in lengths] + [(a, b, c) for a in lengths for b in lengths for c in lengths]
            if sum(p) == size
        }


def test_fit_against_plain_coordinate_descent():
    """Equal weighted error as a slow exact descent, one pattern at a time."""
    size, rng = 16, np.random.default_rng(2)
    counts = np.array([0, *rng.integers(1, 50, size - 1), 0])
    listed = packing.patterns(np.flatnonzero(counts), size)
    a = np.zeros((size + 1, len(listed)))
    for j, row in enumerate(listed):
        for v in row[row > 0]:
            a[v, j] += 1
    w = np.arange(size + 1) / size
    a, goal = a * w[:, None], counts * w
    x = np.zeros(len(listed))
    for _ in range(20_000):
        for j in range(len(x)):
            x[j] = max(0, x[j] + a[:, j] @ (goal - a @ x) / (a[:, j] @ a[:, j]))
        if _ % 200 == 0 and _ > 1000:
            break
    error = lambda y: float(((a @ y - goal) ** 2).sum())
    fitted = packing.fit(counts, listed, rounds=5000)
    assert (fitted >= 0).all()
    assert error(fitted) <= error(x) * 1.001 + 1e-6


def test_best_fit_against_one_piece_at_a_time():
    rng = random.Random(7)
    for _ in range(50):
        size = rng.choice([10, 30])
        counts = np.array([0, *[rng.choice([0, 0, 1, 2, 7]) for _ in range(size)]])
        bins = []
        for length in range(size, 0, -1):
            for _ in range(counts[length]):
                room = [b for b in bins if b[0] >= length]
                target = min(room, key=lambda b: b[0]) if room else [size]
                if not room:
                    bins.append(target)
                target[0] -= length
        assert sum(n for _, n in packing.best_fit(counts)) == len(bins)
