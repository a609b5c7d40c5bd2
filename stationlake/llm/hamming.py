"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes are the signs of vectors under rotations learned on a bounded sample so
that the signs lose little (alternating between codes and rotation); several
rotations give ``bits`` bits. Each batch of the index is bucketed by every
8-bit piece of its codes. A code within Hamming radius r of a query agrees with
it to floor(r / pieces) bits in some piece, so probing these buckets retrieves
every code within r; the whole code is then checked, and Euclidean distances of
the original vectors, in double precision, rank what is left.

The radius of a query holds ``share`` of the sample, or enough for
``least`` rows of the index. A query that still finds fewer than k rows is
searched again without a radius. Queries go out in blocks of ``block`` rows
(the only thing broadcast); the index is never shuffled, and a task returns
k rows a query.

Defined results: vectors that are null, zero, of another length than the
sample's most frequent, or with null or non-finite components take no part;
neither do rows without id. Rows with the query's id are its own. A query id
that repeats is searched once (its greatest vector); candidates that repeat are
all returned. Equal distances come in order of ids.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationlake.llm.frames import stored

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_APART = _ONES[np.arange(256)[:, None] ^ np.arange(256)]


def learned_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Rotation under which centred vectors lie close to the corners of a cube."""
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(x @ rotation > 0, 1.0, -1.0).T @ x)
        rotation = (u @ v).T
    return rotation


@dataclass
class Coder:
    mean: np.ndarray
    matrix: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, bits: int) -> Coder:
        mean = sample.mean(axis=0)
        x = sample - mean
        if x.shape[1] > bits:  # the directions that vary most
            axes = np.linalg.svd(x, full_matrices=False)[2][:bits].T
            return cls(mean, axes @ learned_rotation(x @ axes, 0))
        turns = [learned_rotation(x, s) for s in range(-(-bits // x.shape[1]))]
        return cls(mean, np.concatenate(turns, axis=1)[:, :bits])

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.matrix > 0, axis=1)


def apart(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Hamming distances of codes to one."""
    return _ONES[codes ^ query].sum(axis=1, dtype=np.int64)


def within(buckets: list[tuple[np.ndarray, np.ndarray]], codes: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """Rows with a code within the radius: probe the buckets of every piece, then check whole codes."""
    near = radius // len(buckets)
    found = np.zeros(len(codes), bool)
    for (order, starts), piece in zip(buckets, query):
        for value in np.flatnonzero(_APART[piece] <= near) if near < 8 else ():
            found[order[starts[value] : starts[value + 1]]] = True
        if near >= 8:
            found[:] = True
            break
    rows = np.flatnonzero(found)
    return rows[apart(codes[rows], query) <= radius]


def bucketed(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each 8-bit piece the rows in order of its value, and where each value starts."""
    out = []
    for t in range(codes.shape[1]):
        order = np.argsort(codes[:, t], kind="stable")
        out.append((order, np.searchsorted(codes[order, t], np.arange(257))))
    return out


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Valid rows of a list column, and their vectors as doubles."""
    listed = column.cast(pa.list_(pa.float64()))
    size = listed.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(np.nan_to_num(size.astype(float), nan=-1) == dim)
    flat = listed.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)  # a null component is NaN here
    x = flat.reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[good], x[good]


def _searcher(shared, dim: int, k: int, most: int = 8192):
    def run(batches):
        coder, ids, vectors, codes, radii = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        for batch in batches:
            rows, matrix = _matrix(batch.column("vector"), dim)
            names = batch.column("id").to_numpy(zero_copy_only=False)[rows]
            for at in range(0, len(rows), most):
                x, own = matrix[at : at + most], names[at : at + most]
                index = coder.codes(x)
                buckets = bucketed(index)
                for q in range(len(ids)):
                    near = within(buckets, index, codes[q], radii[q])
                    near = near[own[near] != ids[q]]
                    if len(near):
                        score = np.sqrt(((x[near] - vectors[q]) ** 2).sum(axis=1))
                        score, name = np.concatenate((best[q][0], score)), np.concatenate((best[q][1], own[near]))
                        if len(score) > k:  # all ties with the k-th stay until ids decide
                            keep = score <= np.partition(score, k - 1)[k - 1]
                            score, name = score[keep], name[keep]
                        order = np.lexsort((name, score))[:k]
                        best[q] = (score[order], name[order])
        counts = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(ids, counts)),
                pa.array(np.concatenate([b[1] for b in best]) if best else np.empty(0, np.int64)),
                pa.array(np.concatenate([b[0] for b in best]) if best else np.empty(0)),
            ],
            names=["query_id", "id", "score"],
        )

    return run


def search(
    vectors: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    bits: int = 256,
    sample: int = 20_000,
    share: float = 0.03,
    least: int = 300,
    block: int = 4096,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k nearest found of each query."""
    spark = vectors.sparkSession
    named = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    asked = (
        queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
        .filter("id IS NOT NULL AND vector IS NOT NULL")
        .groupBy("id")
        .agg(F.max("vector").alias("vector"))
    )
    schema = f"query_id long, rank int, {key} long, score double"
    drawn = named.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column(0).combine_chunks()
    lengths = Counter(n for n in drawn.value_lengths().to_pylist() if n)
    dim = lengths.most_common(1)[0][0] if lengths else 0
    known = np.unique(_matrix(drawn, dim)[1], axis=0) if dim else np.empty((0, 0))
    if not len(known):
        return spark.createDataFrame([], schema)
    coder = Coder.fit(known, bits)
    codes = coder.codes(known)
    n = named.count()
    place = min(max(int(len(codes) * max(share, least / n)), 1), len(codes)) - 1

    def searched(rows: pa.Table, radius: int | None) -> DataFrame:
        good, x = _matrix(rows.column("vector").combine_chunks(), dim)
        ids = rows.column("id").to_numpy()[good]
        own = coder.codes(x) if len(x) else np.empty((0, bits // 8), np.uint8)
        radii = [radius if radius is not None else int(np.partition(apart(codes, c), place)[place]) for c in own]
        shared = spark.sparkContext.broadcast((coder, ids, x, own, radii))
        found = named.mapInArrow(_searcher(shared, dim, k), "query_id long, id long, score double")
        # In two steps, as a query has k rows from each task.
        first = Window.partitionBy("query_id", "__part").orderBy("score", "id")
        some = found.withColumn("__part", F.spark_partition_id() % 64).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        last = Window.partitionBy("query_id").orderBy("score", "id")
        return some.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")

    blocks = max(-(-asked.count() // block), 1)
    parts = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if rows.num_rows:
            parts.append(stored(searched(rows, None), "neighbours"))
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = asked.join(full, "id", "left_anti")
    again = 0
    while (rows := short.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == again).toArrow()) is not None:
        if rows.num_rows:
            done = spark.createDataFrame([(i,) for i in rows.column("id").to_pylist()], "query_id long")
            found = found.join(F.broadcast(done), "query_id", "left_anti").unionByName(stored(searched(rows, bits), "neighbours"))
        again += 1
        if again == blocks:
            break
    return found
