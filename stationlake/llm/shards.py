"""Shards of equal bytes by a histogram sort.

Documents are ordered by a 64-bit key: the upper half from the text, the lower
from the document's id. Equal texts follow each other, a text with very many
copies still spreads over many keys, and the order says nothing else. A round
counts rows and bytes between candidate keys in every partition at once; the
next round puts new candidates into the intervals that hold a wanted splitter,
until each is within the tolerance or its interval holds no other key. Cells
between the splitters bound what one task sorts. With the counts below each
cell known, one exchange gives every row its shard and its slot in the shard.

Law: bytes. A splitter that falls among equal texts moves to the nearer end of
their group if it then misses its target by ``group_tolerance`` of an even shard
at most; so a group of up to twice that weight meets in one shard, and only
heavier ones may be split. Elsewhere shards differ by the tolerance and one row
at most at either end.

Defined results: a null text has no bytes, an empty one none either; both count
the fixed size per row. Rows that repeat id and text share a key and a shard,
and take neighbouring slots. An empty table gives an empty table. Added columns
replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.llm.frames import others, stored

_LOWEST, _HIGHEST = -(2**63), 2**63 - 1


def order_key(key: str, text: Column) -> Column:
    upper = F.xxhash64(text).bitwiseAND(F.lit(-(1 << 32)))
    return upper.bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col(key)), 32))


def counts_between(rows: DataFrame, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bytes with a key below each edge, in one pass; a batch sends one row per interval."""
    bounds = np.array(edges, np.int64)

    def run(batches):
        for batch in batches:
            at = np.searchsorted(bounds, batch.column("order").to_numpy(), side="right")
            n = np.bincount(at, minlength=len(bounds) + 1)
            size = np.zeros(len(bounds) + 1, np.int64)
            np.add.at(size, at, batch.column("size").to_numpy())
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), pa.array(size[full])], names=["at", "n", "size"])

    found = rows.select("order", "size").mapInArrow(run, "at long, n long, size long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    n, size = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for r in found.collect():
        n[r["at"]], size[r["at"]] = r["n"], r["size"]
    return np.cumsum(n)[:-1], np.cumsum(size)[:-1]


def splitters(rows: DataFrame, wanted: list[tuple[str, float, float]], total: dict[str, int], probes: int = 16) -> list[int]:
    """A key for each (measure, target, tolerance) with about the target below it; ``probes`` candidates a round."""
    known: dict[str, dict[int, int]] = {m: {_LOWEST: 0, _HIGHEST: total[m]} for m in total}
    chosen: list[int | None] = [None] * len(wanted)
    while True:
        edges = sorted(known["rows"])
        values = {m: np.array([known[m][e] for e in edges]) for m in total}
        asked: set[int] = set()
        for i, (measure, target, tolerance) in enumerate(wanted):
            if chosen[i] is not None:
                continue
            at = int(np.searchsorted(values[measure], target, side="left"))
            lo, hi = edges[max(at - 1, 0)], edges[min(max(at, 1), len(edges) - 1)]
            below, above = known[measure][lo], known[measure][hi]
            near = lo if target - below <= above - target else hi
            if abs(known[measure][near] - target) <= tolerance or hi - lo <= 1 or known["rows"][hi] - known["rows"][lo] <= 1:
                chosen[i] = near
                continue
            # Half of the candidates evenly, half close to where the target should lie.
            guess = lo + int((hi - lo) * ((target - below) / max(above - below, 1)))
            step = max((hi - lo) // (probes // 2 + 1), 1)
            close = max((hi - lo) // (probes * probes), 1)
            asked |= {e for k in range(1, probes // 2 + 1) for e in (lo + k * step, guess + (k - probes // 4) * close) if lo < e < hi}
        if not asked:
            return [c for c in chosen if c is not None]
        new = sorted(asked)
        below_rows, below_bytes = counts_between(rows, new)
        known["rows"].update(zip(new, below_rows.tolist()))
        known["bytes"].update(zip(new, below_bytes.tolist()))


def at_group_edges(rows: DataFrame, bounds: list[int], even: float, allowed: float) -> list[int]:
    """The splitters, each moved to the nearer edge of its group where this misses the target by ``allowed`` at most.

    A group shares the upper half of its keys. One more pass counts at all edges.
    """
    starts = [b >> 32 << 32 for b in bounds]
    edges = sorted({e for s in starts for e in (s, s + (1 << 32)) if _LOWEST <= e <= _HIGHEST})
    size = dict(zip(edges, counts_between(rows, edges)[1].tolist()))
    moved = []
    for i, (bound, start) in enumerate(zip(bounds, starts), 1):
        near = min((e for e in (start, start + (1 << 32)) if e in size), key=lambda e: abs(size[e] - even * i))
        moved.append(near if abs(size[near] - even * i) <= allowed else bound)
    return sorted(moved)


def shard(
    docs: DataFrame,
    shards: int = 40,
    key: str = "doc_id",
    text: str = "text",
    per_row: int = 16,
    tolerance: float = 0.0005,
    cell_rows: int = 50_000,
    group_tolerance: float = 0.05,
    most_cells: int = 20_000,
) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot`` (from 0, without gaps in a shard).

    ``tolerance`` is the share of an even shard by which a splitter may miss;
    ``cell_rows`` is about the number of rows one task sorts, more where this
    needs over ``most_cells`` cells: the counts a round sends to the driver are
    16 for each cell at most, whatever the data.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(
        *[F.col(c) for c in others(docs, ["size", "text_crc32", "shard", "slot"])],
        (F.octet_length(body) + per_row).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        order_key(key, body).alias("__order"),
    )
    rows = stored(sized.select(F.col("__order").alias("order"), "size"), "sizes")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    total = {"rows": sums["n"], "bytes": sums["size"]}
    even = total["bytes"] / shards
    wanted = [("bytes", even * i, even * tolerance) for i in range(1, shards)]
    cells = min(-(-total["rows"] // cell_rows), most_cells)
    inner = [("rows", total["rows"] * i / cells, total["rows"] / cells / 2) for i in range(1, cells)]
    found = splitters(rows, wanted + inner, total) if total["rows"] else [_HIGHEST] * (shards - 1)
    bounds = sorted(found[: shards - 1])
    if total["rows"] and bounds:
        bounds = at_group_edges(rows, bounds, even, even * group_tolerance)
    edges = sorted(set(bounds) | set(found[shards - 1 :]))
    below = counts_between(rows, edges)[0]
    starts = np.concatenate(([0], below))  # rows before each cell
    first = np.searchsorted(np.array(edges, np.int64), np.array(bounds, np.int64))
    of_shard = np.concatenate(([0], starts[first + 1]))  # rows before each shard
    cell_shard = np.searchsorted(np.array(bounds, np.int64), np.array([_LOWEST, *edges], np.int64), side="right")
    offset = starts - of_shard[cell_shard]
    edge_array = np.array(edges, np.int64)

    @F.pandas_udf("struct<cell: int, shard: int, offset: long>")
    def place(order: pd.Series) -> pd.DataFrame:
        cell = np.searchsorted(edge_array, order.to_numpy(), side="right")
        return pd.DataFrame({"cell": cell.astype(np.int32), "shard": cell_shard[cell].astype(np.int32), "offset": offset[cell]})

    within = Window.partitionBy("__at").orderBy("__order", key, "text_crc32", "size")
    placed = sized.withColumn("__at", place("__order"))
    return placed.select(
        *sized.columns[:-1],
        F.col("__at.shard").alias("shard"),
        (F.col("__at.offset") + F.row_number().over(within) - 1).alias("slot"),
    )
