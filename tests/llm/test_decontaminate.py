"""Benchmark windows against plain code, for any number of slices."""

import re

import pytest

from stationlake.llm import decontaminate

LONG = "one two three four five six seven eight nine ten eleven twelve"


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


DOCS = [
    (1, f"Before, {LONG.upper()}! after"), (2, LONG), (3, "one two three four five six seven eight nine"), (4, None), (5, ""), (6, "...,;"),
    (7, "Ätna? short item, and ÄTNA"), (8, f"{LONG} {LONG} x one-two-three four five six seven eight nine ten"), (8, LONG), (None, "short item"),
    (9, "pad " * 20_000 + "short item " + "pad " * 5), (10, "shortitem"), (11, "one two 3 ß"),
]
ITEMS = [(1, LONG), (2, "short item"), (2, "short item"), (30, "Short, ITEM"), (4, None), (5, ""), (6, "3 ß"), (None, "Ätna"), (7, "unseen words here")]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 20])
def test_hits_equal_plain_code(spark, slice_bytes):
    docs = spark.createDataFrame([(*d, 3, "s") for d in DOCS], "doc_id long, text string, n_hit int, spans string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.scan(docs, bench, slice_bytes=slice_bytes)
    assert out.columns == ["doc_id", "text", "n_words", "n_hit", "item_ids", "spans"]
    rows = out.collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in rows), key=repr) == plain(DOCS, ITEMS)
    assert all(sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_hit"] for r in rows)


def test_documents_or_spans_go(spark):
    docs = spark.createDataFrame([(*d, 3) for d in DOCS], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    clean = [p[0] for p in plain(DOCS, ITEMS) if not p[2]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(clean, key=repr)
    cut = decontaminate.without_spans(docs, bench)
    assert cut.columns == docs.columns and cut.count() == len(DOCS)
    texts = {(r["doc_id"], r["n_hit"]): r["text"] for r in cut.collect() if r["doc_id"] != 8}
    assert texts[1, 3] == "Before, ! after" and texts[2, 3] == "" and texts[4, 3] is None and texts[3, 3] == DOCS[2][1]
    assert texts[7, 3] == ", and "


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.scan(docs.limit(0), bench).collect() == []
    assert {r["n_hit"] for r in decontaminate.scan(docs, bench.limit(0)).collect()} == {0}
