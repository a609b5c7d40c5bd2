"""Token counts of documents in flat token files, found by their separators.

A file holds little-endian ids and nothing else: ``width`` bytes each, every
document followed by the separator id 0 (other ids are one higher than the
tokenizer's). There is no index. Files are read and cut into blocks of
``block_bytes``; each block is searched on its own, in one vectorised pass, for
its separators. A prefix scan over the blocks of a file stitches documents that
cross blocks: a block adds to what its predecessors left open since the last
separator. A second scan, over one row per file, numbers documents and ids
through all files.

Defined results: an empty document has 0 tokens; tokens after the last
separator of a file are a document with ``ended`` false; an empty file has none;
a file whose length is no multiple of the width is refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationlake.llm.tokenfiles import encoder

_TYPES = {2: "<u2", 4: "<u4"}


def write_flat(docs: DataFrame, path: str, tokenizer_file: str, text: str = "text", width: int = 2, file_docs: int = 2000) -> None:
    """Ids of all texts, in the order of the table, as flat files of up to ``file_docs`` documents.

    Null and empty texts leave a separator only. Spark's own writer makes the
    files, with the separator as the end of its lines.
    """
    kind = np.dtype(_TYPES[width])

    def run(batches):
        encode = encoder(tokenizer_file)
        if encode.vocabulary >= np.iinfo(kind).max:
            raise ValueError(f"ids do not fit into {width} bytes")
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                ids, n = encode([t or "" for t in batch.column(0).slice(at, 250).to_pylist()], -1)
                data, ends = (ids + 1).astype(kind).tobytes(), np.cumsum(n) * width
                rows = [data[e - k * width : e - width] for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    flat = docs.select(F.col(text).alias("text")).mapInArrow(run, "ids binary")
    flat.select(F.col("ids").cast("string").alias("ids")).write.option("lineSep", "\0" * width).option("maxRecordsPerFile", file_docs).text(path)


def _found(width: int):
    def run(batches):
        for batch in batches:
            n, places = [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer(), _TYPES[width])
                n.append(len(ids))
                places.append(np.flatnonzero(ids == 0))
            at = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int32)
            flat = np.concatenate(places) if places else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat.astype(np.int64)))],
                names=["file", "block", "n", "ends"],
            )

    return run


def documents(spark: SparkSession, path: str, width: int = 2, block_bytes: int = 1 << 20) -> DataFrame:
    """``file``, ``doc`` (number in all files), ``start``, ``n_tokens``, ``first_block``, ``last_block`` and ``ended``.

    ``start`` counts ids before the document, separators included. Files follow
    each other in the order of their names.
    """
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0")
    whole = F.when(F.col("length") % width == 0, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("no whole ids in "), F.col("path"))))
    at = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))
    cut = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), whole.alias("content"), F.explode(at).alias("block")).select(
        "file", "block", F.substring("content", (F.col("block") * block_bytes + 1).cast("int"), F.lit(block_bytes)).alias("data")
    )
    found = cut.mapInArrow(_found(width), "file string, block long, n long, ends array<long>")
    return stitched(found)


def stitched(found: DataFrame) -> DataFrame:
    """Documents from the separators of each block: ``file``, ``block``, ``n`` ids and ``ends`` (places of separators)."""
    cut = F.size("ends") > 0
    tail = F.when(cut, F.col("n") - 1 - F.element_at("ends", -1)).otherwise(F.col("n"))
    by_block = Window.partitionBy("file").orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    marked = found.select(
        "*",
        tail.alias("tail"),
        F.coalesce(F.sum(F.size("ends").cast("long")).over(earlier), zero).alias("docs_before"),
        F.coalesce(F.sum("n").over(earlier), zero).alias("ids_before"),
        F.coalesce(F.sum(cut.cast("long")).over(earlier), zero).alias("cuts"),
        F.max("block").over(Window.partitionBy("file")).alias("final"),
    )
    # What is open before a block: tails since, and with, the last block that has a separator.
    run = Window.partitionBy("file", "cuts").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.lag("tail").over(by_block)
    starts = F.lag("cuts").over(by_block) < F.col("cuts")
    opened = marked.withColumn("carried", F.when(starts, before).otherwise(zero))
    base = F.first("carried").over(Window.partitionBy("file", "cuts").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    base_block = F.first("block").over(Window.partitionBy("file", "cuts").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    open_ids = (base + F.coalesce(F.sum("n").over(run), zero)).alias("open")
    opening = F.when(base > 0, base_block - 1).otherwise(base_block).alias("open_block")
    linked = opened.select("file", "block", "n", "ends", "tail", "docs_before", "ids_before", "final", open_ids, opening)
    # One row for each file.
    sums = linked.filter("block = final").select(
        "file",
        (F.col("docs_before") + F.size("ends") + F.when(F.when(cut, F.col("tail")).otherwise(F.col("open") + F.col("n")) > 0, 1).otherwise(0)).alias("docs"),
        (F.col("ids_before") + F.col("n")).alias("ids"),
    )
    files = Window.orderBy("file")
    bases = sums.select("file", (F.sum("docs").over(files) - F.col("docs")).alias("docs_base"), (F.sum("ids").over(files) - F.col("ids")).alias("ids_base"))

    def entry(end, i):
        first = i == 0
        begin = F.when(first, F.col("ids_before") - F.col("open")).otherwise(F.col("ids_before") + F.get("ends", i - 1) + 1)
        stop = F.col("ids_before") + end
        return F.struct(
            (F.col("docs_before") + i).alias("doc"),
            begin.alias("start"),
            (stop - begin).alias("n_tokens"),
            F.when(first & (F.col("open") > 0), F.col("open_block")).otherwise(F.col("block")).alias("first_block"),
            F.col("block").alias("last_block"),
            F.lit(True).alias("ended"),
        )

    left = F.when(cut, F.col("tail")).otherwise(F.col("open") + F.col("n"))
    unended = F.struct(
        (F.col("docs_before") + F.size("ends")).alias("doc"),
        (F.col("ids_before") + F.col("n") - left).alias("start"),
        left.alias("n_tokens"),
        F.when(cut | (F.col("open") == 0), F.col("block")).otherwise(F.col("open_block")).alias("first_block"),
        F.col("block").alias("last_block"),
        F.lit(False).alias("ended"),
    )
    entries = F.transform("ends", entry)
    listed = linked.select(
        "file", F.explode(F.when((F.col("block") == F.col("final")) & (left > 0), F.concat(entries, F.array(unended))).otherwise(entries)).alias("d")
    )
    return listed.join(bases, "file").select(
        "file",
        (F.col("docs_base") + F.col("d.doc")).alias("doc"),
        (F.col("ids_base") + F.col("d.start")).alias("start"),
        "d.n_tokens",
        "d.first_block",
        "d.last_block",
        "d.ended",
    )
