"""Spelling variants of a corpus' words by a trie kept as an edge table.

Words are counted over all documents. Two words are near if one inserted,
deleted or replaced code point parts them. A near word at least ten times as
frequent is the word's form; the last of a chain of forms is its root.

The trie is a table of edges, one trie for each length of words and direction
of reading: (reversed, length, node, char), a node being the prefix read so far.
A frontier of states (word, position, node, edits) is joined with it level by
level. One edit lies in the first or the second half of a word, so states start
without edits at the node of half a word, and words read backwards find the edits
in front: no state ever stands near the root, where a node has all letters. An
edge knows what letters follow it, so a state that cannot go on is not written.
An edge with one word below ends the walk: the rest is compared at once. A level
is a join on the node; a node has at most as many edges as letters exist, so a
node with very many states may be split by the engine, and is.

Words longer than ``longest`` are too deep for a trie. Their pairs are joined on
a rolling hash of the word without one code point, at most one row for each code
point, and compared exactly.

Defined results: null and empty texts have no words. A row without key counts
as if its key were the empty text. Repeated rows are counted as often as they
occur. Other columns, of whatever name, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.llm.frames import stored

#: Fixed values of the contract.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGED = 31


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 7, least: int = 2) -> DataFrame:
    """``word`` and ``n`` of the runs of letters, after the fixed damage, that are long and frequent enough.

    A run too short to give such a word is not even extracted: the pattern is
    greedy, so it finds whole runs only.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    h, length = F.crc32(F.concat_ws(":", "key", "run").cast("binary")), F.length("run")
    at = (h % length).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, length))
    spelled = found.select(F.when(h % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))
    return (
        spelled.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    )


def _sides() -> Column:
    """A word as it is and read backwards, with the depth at which edits begin."""
    length = F.length("word")
    half = F.floor(length / 2).cast("int")
    return F.inline(
        F.array(
            F.struct(F.lit(False).alias("reversed"), F.col("word").alias("w"), half.alias("half")),
            F.struct(F.lit(True).alias("reversed"), F.reverse("word").alias("w"), (length - half).alias("half")),
        )
    )


def edges(listed: DataFrame) -> DataFrame:
    """The edge table: from ``node`` by ``char``, the words below, one of them, and the letters that follow.

    Nodes nearer to the root than the frontier of any state are left out. A
    word read for a deletion starts half a letter earlier in the trie of the
    words shorter by one, hence the one less.
    """
    read = listed.select("n", _sides()).withColumn("length", F.length("w"))
    depth = F.explode(F.sequence(F.col("half"), F.col("length") - 1)).alias("depth")
    steps = read.select("reversed", "length", "w", "n", depth).select(
        "reversed",
        "length",
        F.substring("w", F.lit(1), F.col("depth")).alias("node"),
        F.substring("w", F.col("depth") + 1, F.lit(1)).alias("char"),
        F.substring("w", F.col("depth") + 2, F.lit(1)).alias("next"),
        F.struct("w", "n").alias("leaf"),
    )
    return steps.groupBy("reversed", "length", "node", "char").agg(
        F.count(F.lit(1)).alias("below"), F.min("leaf").alias("leaf"), F.array_join(F.collect_set("next"), "").alias("follow")
    )


def _start(listed: DataFrame) -> DataFrame:
    """States without edits: each word before its second half, for a replacement and for a deletion."""
    read = listed.select("n", _sides()).withColumn("size", F.length("w"))
    shorter = F.explode(F.array(F.lit(0), F.lit(1)))
    return read.withColumn("shorter", shorter).select(
        "reversed",
        (F.col("size") - F.col("shorter")).alias("length"),
        F.substring("w", F.lit(1), F.col("half")).alias("node"),
        F.col("half").alias("position"),
        F.lit(0).alias("edits"),
        F.col("shorter") == 1,
        "w",
        "n",
    ).toDF(*STATE)


STATE = ["reversed", "length", "node", "position", "edits", "deletes", "w", "n"]


def _level(states: DataFrame, trie: DataFrame) -> DataFrame:
    """One step of all states along the edges of their nodes: states that go on, and words met (``met``).

    ``position`` is where the word is read next. Of two words that differ by a
    replacement only the one with the smaller letter walks, and a deletion is
    taken at the first letter in which the words differ, so a pair is met once.
    """
    own, after = F.substring("w", F.col("position") + 1, F.lit(1)), F.substring("w", F.col("position") + 2, F.lit(1))
    ready = states.withColumns({"own": own, "after": after})
    joined = ready.join(trie, ["reversed", "length", "node"])
    char, own, after = F.col("char"), F.col("own"), F.col("after")
    fresh = F.col("edits") == 0
    same = char == own
    replaced = fresh & ~F.col("deletes") & (char > own) & (own != "")
    deleted = fresh & F.col("deletes") & (char == after) & (after != own)
    moved = joined.filter(same | replaced | deleted).withColumns(
        {
            "node": F.concat("node", "char"),
            "position": F.col("position") + F.when(same, 1).when(deleted, 2).otherwise(1),
            "edits": F.when(same, F.col("edits")).otherwise(F.lit(1)),
        }
    )
    leaf, alone = F.col("leaf.w"), F.col("below") == 1
    rest = F.substring("w", F.col("position") + 1, F.length("w")) == F.substring(leaf, F.length("node") + 1, F.length(leaf))
    # A word without edits yet that meets the only word below: the last place for the deletion is inside the rest.
    last = F.col("deletes") & (F.levenshtein("w", leaf, 1) == 1)
    near = F.when(F.col("edits") == 1, rest).otherwise(last)
    follows = F.substring("w", F.col("position") + 1, F.lit(1))
    goes_on = (F.col("edits") == 0) | F.col("follow").contains(follows)
    met = alone & near
    return moved.filter(F.when(alone, near).otherwise(goes_on)).select(
        *STATE, F.when(met, F.col("leaf")).alias("met")
    )


def _from_trie(listed: DataFrame) -> DataFrame:
    """All near pairs of the words, each once: ``a``, ``a_n``, ``b``, ``b_n``."""
    trie = stored(edges(listed), "edges")
    levels = []
    states = _start(listed)
    while not levels or not states.isEmpty():
        levels.append(stored(_level(states, trie), "states"))
        states = levels[-1].filter("met IS NULL").select(*STATE)
    met = levels[0]
    for level in levels[1:]:
        met = met.unionByName(level)
    turned = lambda c: F.when(F.col("reversed"), F.reverse(c)).otherwise(F.col(c))
    pairs = met.filter("met IS NOT NULL").select(
        "reversed", "w", "n", F.col("met.w").alias("v"), F.col("met.n").alias("v_n")
    ).select("reversed", turned("w").alias("a"), F.col("n").alias("a_n"), turned("v").alias("b"), F.col("v_n").alias("b_n"))
    # A deletion in a row of equal letters may be seen from both ends: the forward reading has it.
    half = F.floor(F.length("a") / 2).cast("int")
    seen = F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half)
    return pairs.filter(~F.col("reversed") | ~seen).drop("reversed")


_BASE = 0x9E3779B97F4A7C15 | 1


def _signatures(batches):
    """Hashes of each long word, and of the word without each of its code points."""
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    for batch in batches:
        for word, name in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist()):
            codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
            powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes) - 1, base))))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes ^ (codes >> np.uint64(29))) * powers)))
            without = sums[:-1] + (sums[-1] - sums[1:]) * inverse
            # Equal letters in a row give the same word: a deletion is taken at the last of them.
            first = np.append(codes[:-1] != codes[1:], True)
            hashes = np.append(without, sums[-1:]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(hashes), name)),
                    pa.array(hashes),
                    pa.array(np.append(np.arange(len(codes)), -1)),
                    pa.array(np.append(first, False)),
                ],
                names=["id", "hash", "at", "last"],
            )


def _from_hashes(listed: DataFrame) -> DataFrame:
    """All near pairs of long words: those that share the rest around one code point, compared exactly."""
    named = stored(listed.withColumn("id", F.xxhash64("word")), "long")
    marks = stored(named.select("word", "id").mapInArrow(_signatures, "id long, hash long, at long, last boolean"), "marks")
    cut = marks.filter("at >= 0")
    other = marks.select(F.col("id").alias("other"), "hash", "at")
    replaced = cut.join(other, ["hash", "at"]).filter("id < other").select("id", "other")
    deleted = cut.filter("last").select("id", "hash").join(other.filter("at = -1").drop("at"), "hash").select("id", "other")
    pairs = replaced.unionByName(deleted).distinct()
    a = named.select("id", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = named.select(F.col("id").alias("other"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    return pairs.join(a, "id").join(b, "other").filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def near_pairs(listed: DataFrame, longest: int = 64) -> DataFrame:
    """Every pair of near words once, with their counts. Words are distinct, of three code points or more."""
    size = F.length("word")
    short, long = listed.filter(size <= longest), listed.filter(size >= longest)
    pairs = _from_trie(short)
    if long.filter(size > longest).isEmpty():
        return pairs
    return pairs.unionByName(_from_hashes(long).filter(F.greatest(F.length("a"), F.length("b")) > longest))


def variants(listed: DataFrame, factor: int = 10, longest: int = 64) -> DataFrame:
    """``word``, ``n``, ``form``, ``root``, ``n_near`` and ``form_n`` of all words.

    A form is at least ``factor`` times as frequent as its word, so chains are
    no longer than the logarithm of the largest count: following them takes the
    logarithm of that in joins, each doubling the steps.
    """
    pairs = near_pairs(listed, longest)
    both = F.inline(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
            F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
        )
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = pairs.select(both).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    near_n = -F.col("best.less")
    enough = near_n >= factor * F.col("n")
    table = stored(
        listed.join(found, "word", "left").select(
            "word",
            "n",
            F.when(enough, F.col("best.near")).alias("form"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, near_n).alias("form_n"),
        ),
        "variants",
    )
    most = table.agg(F.max("n")).first()[0] or 1
    steps = math.floor(math.log(most, factor)) + 1
    chain = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(steps - 1, 0).bit_length()):
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("__root"))
        chain = chain.join(further, "root", "left").select("word", F.coalesce("__root", "root").alias("root"))
    return table.join(chain, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
