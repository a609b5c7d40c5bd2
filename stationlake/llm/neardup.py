"""MinHash near-duplicates by tensored banding, with links confirmed on whole shingle sets.

Two small collections of ``bands`` keys, each of two minhash values, are made
per document. Table (i, j) has the key (first_i, second_j): ``bands ** 2``
tables from ``4 * bands`` minhashes. At similarity 0.75 a key of two values
agrees with probability 0.56, so a pair meets in no table with probability
4e-6 at 16 bands. A table key can be shared only if both its halves are, so
halves that one document holds alone are dropped before pairs are formed.

Documents with equal sets are one node. In two turns, every node whose bucket
holds several components is compared with a few leaders of other components.
Nodes that then still share a bucket but no component are compared across
components, each pair once. So copies are never expanded into all pairs, and no
link between different texts is lost. Before whole sets are fetched, a pair must
pass two tests that no linked pair fails: its sizes, and the number of odd bits
(see ``_odd_bits``) in which it differs, which bounds the members it differs in
from below.

Defined results: null and empty texts have no shingles and are linked with
nothing; rows with the same doc_id count as one document; rows without doc_id
get no component and are kept. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.llm.frames import as_bytes, extended, stored
from stationlake.llm.graph import components
from stationlake.llm.hashing import mixed, shingle_sets

_BITS = 23
_ODD = 16


def _odd_bits(sets: list[np.ndarray]) -> np.ndarray:
    """For each set a bit per hash value modulo 1024: whether an odd number of members has it.

    Two of these differ in at most as many bits as the sets differ in members.
    """
    size = 64 * _ODD
    flat = np.concatenate([(s % np.uint64(size)).astype(np.int64) + i * size for i, s in enumerate(sets)]) if sets else np.empty(0, np.int64)
    odd = np.bincount(flat, minlength=len(sets) * size).reshape(len(sets), size) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def _sketcher(size: int, bands: int):
    draw = np.random.default_rng(7)
    factors = draw.integers(0, 2**63, 4 * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 2**63, 4 * bands, dtype=np.uint64)
    index = mixed(np.arange(1, 2 * bands + 1, dtype=np.uint64))

    def keys(sets: list[np.ndarray]) -> np.ndarray:
        """A row of 2 * bands keys for each set; rows of empty sets are zero."""
        out = np.zeros((len(sets), 2 * bands), np.uint64)
        filled = [i for i, s in enumerate(sets) if len(s)]
        if filled:
            values = np.concatenate([sets[i] for i in filled])
            starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in filled])[:-1]))
            for band in range(2 * bands):
                low = [np.minimum.reduceat(values * factors[k] + shifts[k], starts) for k in (2 * band, 2 * band + 1)]
                out[filled, band] = mixed((low[0] ^ index[band]) + low[1] * factors[0])
        return out

    def run(batches):
        for batch in batches:
            n, first, second, a, b, odd = [], [], [], [], [], []
            held: list[np.ndarray] = []

            def flush():
                made = keys(held).view(np.int64)
                a.extend(made[:, :bands])
                b.extend(made[:, bands:])
                odd.extend(_odd_bits(held))
                held.clear()

            for s in shingle_sets(as_bytes(batch.column("__text")), size):
                n.append(len(s))
                data = s.tobytes()
                first.append(xxhash.xxh3_64_intdigest(data, 1))
                second.append(xxhash.xxh3_64_intdigest(data, 2))
                held.append(s)
                if len(held) >= 256:
                    flush()
            flush()
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (first, second)]
            lists = [
                pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * size, pa.array(np.concatenate(x) if x else np.empty(0, np.int64)))
                for x, size in ((a, bands), (b, bands), (odd, _ODD))
            ]
            yield [pa.array(n, pa.int64()), *longs, *lists]

    return run


def _sets(size: int, wanted):
    """Sorted shingle hashes as bytes, for the rows whose id may be wanted."""

    def run(batches):
        bits = wanted.value
        for batch in batches:
            places = batch.column("__place").to_numpy(zero_copy_only=False)
            take = np.flatnonzero((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1)
            batch = batch.take(pa.array(take))
            texts = as_bytes(batch.column("__text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array([s.tobytes() for s in shingle_sets(texts, size)], pa.binary())], names=["rep", "shingles"]
            )

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("__x").to_pylist(), batch.column("__y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    return run


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each id: 1 MB, whatever their number. Only a first filter."""
    place = _place("rep")
    rows = (
        ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    bits = np.zeros((1 << _BITS) // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        bits[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _place(key: str) -> Column:
    """A number from 1 for a key: bit n - 1 of the bitmap."""
    return F.pmod(F.xxhash64(key), F.lit(1 << _BITS)) + 1


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, bands: int = 16
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest linked key) and ``kept`` per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("__text"))
    sketch = stored(
        extended(rows, "n long, h1 long, h2 long, a array<long>, b array<long>, odd array<long>", _sketcher(size, bands), keep=["doc"]), "sketch"
    )
    known = sketch.filter("n > 0 AND doc IS NOT NULL")
    nodes = stored(
        known.groupBy("n", "h1", "h2").agg(F.min("doc").alias("rep"), *[F.first(c).alias(c) for c in ("a", "b", "odd")]), "nodes"
    )
    every = nodes.select("rep", F.posexplode(F.concat("a", "b")).alias("band", "half"))
    shared = every.groupBy("half").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("half")
    halves = every.join(shared, "half", "left_semi")
    # A table key needs a half from either collection.
    meeting = halves.groupBy("rep").agg(F.min("band").alias("lo"), F.max("band").alias("hi")).filter((F.col("lo") < bands) & (F.col("hi") >= bands))
    halves = stored(halves.join(meeting, "rep", "left_semi"), "halves")
    nodes_met = stored(nodes.join(meeting, "rep", "left_semi"), "met")
    sets = _shingles(rows, meeting.select("rep"), size)
    labelled, links = halves.withColumn("c", F.col("rep")), None
    for turn in range(2):
        pairs = _keep_near(_leaders(labelled, turn), nodes_met, percent)
        new = stored(_linked(pairs, sets, percent), "links")
        links = new if links is None else links.unionByName(new)
        labels = components(links)
        labelled = _labelled(halves, labels)
    # What still lies apart although it shares a key: every pair across components, once.
    apart = labelled.join(_open(labelled), "half", "left_semi")
    left = nodes_met.join(apart.filter(F.col("band") < bands).select("rep", "c", "half"), "rep")
    left = left.join(apart.filter(F.col("band") >= bands).select("rep"), "rep", "left_semi")
    left = stored(left, "left")
    p, q = left.alias("p"), left.alias("q")
    across = p.join(
        q,
        (F.col("p.half") == F.col("q.half"))
        & (F.col("p.c") < F.col("q.c"))
        & _near("p.", "q.", percent)
        & (F.array_intersect("p.a", "q.a")[0] == F.col("p.half")),
    ).select(F.col("p.rep").alias("u"), F.col("q.rep").alias("v"))
    more = stored(_linked(across, sets, percent), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    of_node = nodes.select("n", "h1", "h2", "rep").join(labels, "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    found = sketch.select("doc", "n", "h1", "h2").join(of_node, ["n", "h1", "h2"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return found.select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept")
    )


def _labelled(halves: DataFrame, labels: DataFrame) -> DataFrame:
    return halves.join(labels, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")


def _open(labelled: DataFrame, *more: Column) -> DataFrame:
    """Halves whose nodes lie in several components."""
    return labelled.groupBy("half").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), *more).filter("lo < hi").drop("lo", "hi")


def _leaders(labelled: DataFrame, turn: int, most: int = 4) -> DataFrame:
    """Each node with up to ``most`` leaders of other components, those it shares most halves with.

    Every open half has two leaders, others in every turn. No node gets more
    pairs than ``most``, however many nodes share a half; this only saves work,
    as what lies apart in the end is compared in full.
    """
    rank = F.struct(F.xxhash64("rep", F.lit(turn)).alias("order"), "rep", "c") if turn else F.struct("rep", "c")
    leaders = _open(labelled, F.min(rank).alias("p"), F.max(rank).alias("q"))
    leaders = leaders.select("half", F.explode(F.array("p", "q")).alias("leader")).select("half", F.col("leader.rep").alias("v"), F.col("leader.c").alias("of"))
    met = labelled.join(leaders, "half").filter("c <> of").groupBy(F.col("rep").alias("u"), "v").agg(F.count(F.lit(1)).alias("n"))
    # At most two leaders for each half: the list is bounded.
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "v"))), 1, most)
    return met.groupBy("u").agg(best.alias("best")).select("u", F.explode("best.v").alias("v"))


def _near(p: str, q: str, percent: int) -> Column:
    """Both share a table key, and neither their sizes nor their odd bits rule the similarity out.

    Sets of similarity p % differ in (100 - p) / (100 + p) of their sizes' sum at most.
    """
    n = [F.col(f"{x}n") for x in (p, q)]
    apart = sum((F.bit_count(F.col(f"{p}odd")[i].bitwiseXOR(F.col(f"{q}odd")[i])) for i in range(_ODD)), F.lit(0))
    near = (100 * F.least(*n) >= percent * F.greatest(*n)) & ((100 + percent) * apart <= (100 - percent) * (n[0] + n[1]))
    return near & F.arrays_overlap(f"{p}a", f"{q}a") & F.arrays_overlap(f"{p}b", f"{q}b")


def _keep_near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    for side in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("rep").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "a", "b", "odd")]), side)
    return pairs.filter(_near("u_", "v_", percent)).select("u", "v")


def _shingles(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Shingle sets of the nodes wanted. The bitmap keeps other texts out of the join."""
    wanted = stored(wanted, "wanted")
    bits = rows.sparkSession.sparkContext.broadcast(_bitmap(wanted))
    place = _place("doc") - 1
    texts = rows.filter("doc IS NOT NULL").select(F.col("doc").alias("rep"), "__text", place.alias("__place"))
    sets = texts.mapInArrow(_sets(size, bits), "rep long, shingles binary")
    return stored(sets.join(wanted, "rep", "left_semi"), "sets")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("__x")), "u")
    both = both.join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("__y")), "v")
    return both.select("u", "v", "__x", "__y").mapInArrow(_confirm(percent), "u long, v long")


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are the smallest key of their component; columns as given.

    Rows without key stay. Rows that repeat a key and text stay together.
    """
    dropped = classes(docs, key, text, **options).filter(~F.col("kept")).select(F.col(key).alias("__gone")).distinct()
    return docs.join(dropped, F.col(key).cast("long") == F.col("__gone"), "left_anti")
