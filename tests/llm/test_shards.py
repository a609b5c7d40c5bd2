"""Shards: even bytes, whole rows, gapless slots, copies side by side."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stationlake.llm import shards


def check(rows, given, n, per_row=16):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d, len((t or "").encode()) + per_row, zlib.crc32((t or "").encode())) for d, t in given
    )
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def sizes(rows, n):
    out = np.zeros(n)
    for r in rows:
        out[r["shard"]] += r["size"]
    return out


@pytest.mark.parametrize("cell_rows", [50_000, 37])
def test_given_documents(spark, cell_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    given = [tuple(r) for r in docs.collect()]
    out = shards.shard(docs, 8, cell_rows=cell_rows)
    assert out.columns == ["doc_id", "text", "size", "text_crc32", "shard", "slot"]
    rows = out.collect()
    check(rows, given, 8)
    even = sum(r["size"] for r in rows) / 8
    # A splitter misses by the tolerance or by half a row.
    assert np.abs(sizes(rows, 8) - even).max() <= 2 * (0.0005 * even + max(r["size"] for r in rows))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows))
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text"]].add(r["shard"])
    assert max(map(len, by_text.values())) <= 2


def test_hot_text_spreads(spark):
    given = [(i, "the same text again" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    rows = shards.shard(docs, 40).collect()
    check(rows, given, 40)
    total = sizes(rows, 40)
    assert total.max() - total.min() <= 4 * 40


def test_odd_rows(spark):
    given = [(None, None), (1, ""), (1, ""), (2, "a" * 200_000), (3, "é"), (3, "é"), (4, "z")]
    docs = spark.createDataFrame([(*g, "mine", 7) for g in given], "doc_id long, text string, Shard string, size int")
    out = shards.shard(docs, 3)
    assert out.columns == ["doc_id", "text", "size", "text_crc32", "shard", "slot"]
    check(out.collect(), given, 3)
    assert shards.shard(docs.limit(0), 3).collect() == []
    assert [r["shard"] for r in shards.shard(docs.filter("doc_id = 4"), 3).collect()] in ([0], [1], [2])


def test_equal_texts_meet(spark):
    """Groups of up to a tenth of an even shard stay whole; a heavier one may be split, and shards stay near equal."""
    given = [(i, f"copy {i // 25} " * 3 if i < 2500 else f"text {i} of its own") for i in range(6000)]
    given += [(10_000 + i, "one heavy text") for i in range(2000)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    for cell_rows, most in ((50_000, 20_000), (100, 20_000), (100, 7)):
        rows = shards.shard(docs, 20, cell_rows=cell_rows, most_cells=most).collect()
        check(rows, given, 20)
        even = sum(r["size"] for r in rows) / 20
        found = defaultdict(list)
        for r in rows:
            found[r["text"]].append(r)
        for group in found.values():
            assert len({r["shard"] for r in group}) == 1 or sum(r["size"] for r in group) > 0.1 * even
        assert np.abs(sizes(rows, 20) - even).max() <= 0.1 * even + 2 * (0.0005 * even + 100)
