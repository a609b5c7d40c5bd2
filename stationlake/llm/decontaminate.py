"""Benchmark decontamination: a hash set of benchmark windows against all documents.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
characters. A window is ``size`` consecutive words of a benchmark item; an item
with fewer words, but at least one, is one window. A document word inside any
occurrence of a window is hit.

The benchmark is cut into slices of at most ``slice_bytes`` of text, so what is
broadcast has a bound; the documents pass through one scan per slice, in the
same job, and spans and items add up.

Defined results: null and empty texts have no words and no hits; an item
without words has no window; repeated items count once; an item whose id is
null is searched for but not listed; an empty benchmark hits nothing. Added
columns replace columns of the same name.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm.frames import as_bytes, extended, others
from stationlake.llm.hashing import LETTERS

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
ADDED = "n_words long, n_hit long, item_ids array<string>, spans array<struct<first: int, last: int>>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(LETTERS).split() if text else []


class Windows:
    """The distinct windows of some items, by length, behind sorted 64-bit hashes."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int):
        found: dict[tuple[bytes, ...], set[str | None]] = {}
        for item, text in items:
            listed = words(text)
            for i in range(max(len(listed) - size, 0) + 1 if listed else 0):
                found.setdefault(tuple(listed[i : i + size]), set()).add(item)
        self.ids = {w: i for i, w in enumerate(sorted({w for window in found for w in window}))}
        self.by_length = []
        for n in sorted({len(w) for w in found}):
            windows = sorted(w for w in found if len(w) == n)
            matrix = np.array([[self.ids[w] for w in window] for window in windows], np.int64)
            seed = 0
            while True:  # windows of one length never share a hash
                factors = np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
                hashes = (matrix.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
                order = np.argsort(hashes)
                if len(np.unique(hashes)) == len(hashes):
                    break
                seed += 1
            owners = [sorted(i for i in found[windows[k]] if i is not None) for k in order]
            self.by_length.append((n, factors, hashes[order], matrix[order], owners))

    def hits(self, ids: np.ndarray):
        """(length, first positions, window numbers, owners by window) of all verified occurrences."""
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for n, factors, hashes, matrix, owners in self.by_length:
            at = np.flatnonzero(known[n:] - known[:-n] == n) if len(ids) >= n else np.empty(0, np.int64)
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h += ids[at + j].astype(np.uint64) * factors[j]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[k] == h
            at, k = at[same], k[same]
            exact = (ids[at[:, None] + np.arange(n)] == matrix[k]).all(axis=1)
            yield n, at[exact], k[exact], owners


def _scanner(shared, earlier: bool):
    def run(batches):
        windows: Windows = shared.value
        get, none = windows.ids.get, repeat(-1)
        for batch in batches:
            parts, lengths = [], []
            for text in as_bytes(batch.column("__text")):
                listed = words(text)
                # A separator after each document: no window spans two of them.
                parts.append(np.fromiter(map(get, listed, none), np.int32, len(listed)))
                parts.append(np.array([-1], np.int32))
                lengths.append(len(listed))
            ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
            starts = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64) + 1)))[:-1]
            marks = np.zeros(len(ids) + 1, np.int64)
            items: dict[int, set[str]] = {}
            before = zip(batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist()) if earlier else ()
            for row, (spans, listed) in enumerate(before):
                items.setdefault(row, set()).update(listed)
                for s in spans:
                    marks[starts[row] + s["first"]] += 1
                    marks[starts[row] + s["last"] + 1] -= 1
            for n, at, k, owners in windows.hits(ids):
                np.add.at(marks, at, 1)
                np.add.at(marks, at + n, -1)
                rows = np.searchsorted(starts, at, side="right") - 1
                for row, window in set(zip(rows.tolist(), k.tolist())):
                    items.setdefault(row, set()).update(owners[window])
            covered = np.concatenate(([0], (np.cumsum(marks) > 0).astype(np.int8)))
            edge = np.diff(covered)
            first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            rows = np.searchsorted(starts, first, side="right") - 1
            spans: list[list[dict]] = [[] for _ in lengths]
            for row, a, b in zip(rows.tolist(), first.tolist(), after.tolist()):
                spans[row].append({"first": a - int(starts[row]), "last": b - 1 - int(starts[row])})
            yield [
                lengths,
                [sum(s["last"] - s["first"] + 1 for s in own) for own in spans],
                [sorted(items.get(i, ())) for i in range(len(lengths))],
                spans,
            ]

    return run


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = 10,
    slice_bytes: int = 32 << 20,
) -> DataFrame:
    """Documents with ``n_words``, ``n_hit``, ``item_ids`` (sorted) and ``spans`` of hit words."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-total // slice_bytes) or 1
    found = docs.withColumn("__text", F.col(text))
    for i in range(slices):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == i).distinct()
        rows = [(r["item"], r["text"].encode() if r["text"] is not None else None) for r in part.collect()]
        shared = spark.sparkContext.broadcast(Windows(rows, size))
        found = extended(found, ADDED, _scanner(shared, earlier=i > 0))
    return found.drop("__text")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without any hit; columns as given."""
    return scan(docs.select("*", F.struct("*").alias("__row")), benchmark, **options).filter("n_hit = 0").select("__row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, the text from the first to the last word of each hit span cut out."""
    marked = scan(docs.select("*", F.struct("*").alias("__row")), benchmark, text=text, **options).select("__row.*", F.col("spans").alias("__spans"))

    def cut(batches):
        for batch in batches:
            out = []
            for body, spans in zip(as_bytes(batch.column(text)), batch.column("__spans").to_pylist()):
                if spans:
                    at = [m.span() for m in _WORD.finditer(body)]
                    keep, last = [], 0
                    for s in spans:
                        keep.append(body[last : at[s["first"]][0]])
                        last = at[s["last"]][1]
                    body = b"".join(keep) + body[last:]
                out.append(None if body is None else body.decode())
            yield [out]

    return extended(marked, f"`{text}` string", cut, keep=others(marked, ["__spans"])).select(*docs.columns)
