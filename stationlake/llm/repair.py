"""Repair of conversations by lightest derivations.

A conversation's rows, damaged in a fixed way and in order of turn, are to read
``(s?(ua)+)?`` by the initials of their roles. Keeping a row costs 0, giving it
another role 2, deleting it 3, a new empty row 2; a truncated row that stays adds
1; blank rows and duplicates must go. The cheapest edits are found as lightest
derivations: an item says that the rows up to a place have led from one state of
the pattern to another, a rule adds an edit, and the agenda gives up items in
order of (cost, audit), so the first derivation of an item is its lightest.

The order is a superior one. An edit appends a letter and never lowers the cost;
and of two audits of the same rows and cost none begins with the other, as one
that has more letters has more new rows and so costs more. So appending keeps
their order, also where whole segments are appended.

Conversations of any length: rows are sorted over the whole table by
(conversation, turn, role, text) and each task cuts its rows into segments of at
most ``segment`` rows. A segment's items lead from every state to every state;
joining the items of neighbouring segments is the same deduction with two
premises. So no conversation is held in one task: only its audit, a letter for
each row, is built in one place, and its SHA-256, which is sequential by
definition, streams through its sorted rows.

Defined results: a null role or text is one space, and a null in the text that
decides the damage as well. Null turns come first and have no part in gaps; a
null conversation id is an id like others. Rows of one turn are ordered by role,
then text. Equal rows stand side by side; all but the first are duplicates.
Gaps beyond the long range are null. Other columns, of whatever name, are
ignored. An empty table gives no rows; a conversation without rows after the
damage has zeros, an empty audit and the hash of the empty text.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import groupby
from operator import and_

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from stationlake.llm.frames import stored

#: Fixed values of the contract.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")

#: States of the pattern: nothing yet, after s, after u, after a; and what follows a letter.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = (0, 1, 2, 3), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: A row as the agenda sees it: its initial if the pattern has it, in upper case if truncated; - if it must go.
MUST_GO, OTHER, OTHER_TRUNCATED = "-", "o", "O"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``copies`` after the fixed damage."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.withColumn("kind", kind).filter("kind <> 0").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(and_, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with their ``copies``, and ``fault``: blank, duplicate, truncated or null.

    Equal rows are counted before they are shuffled. A row is a duplicate if its
    role and text occur at an earlier turn; further copies are duplicates anyway.
    """
    distinct = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    digest = F.sha2("text", 256)
    seen = distinct.withColumn("digest", digest)
    # Nulls first: a null turn is the earliest.
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = (
        seen.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first")).select(
            "conv_id", "role", "digest", "first"
        )
    )
    joined = seen.alias("l").join(first.alias("r"), _same("l", "r", ["conv_id", "role", "digest"]))
    visible = F.regexp_replace(F.col("l.text"), r"[\x20\x09-\x0D]+$", "")
    fault = (
        F.when(visible == "", "blank")
        .when(~order_of("l").eqNullSafe(F.col("r.first")), "duplicate")
        .when(~F.substring(visible, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return joined.select("l.conv_id", "l.turn", "l.role", "l.text", "l.copies", fault.alias("fault"))


def order_of(side: str) -> Column:
    return F.struct(F.col(f"{side}.turn").isNotNull().alias("known"), F.col(f"{side}.turn"))


def symbol(initial: str, fault: str | None) -> str:
    """What the agenda has to know of a row."""
    if fault in ("blank", "duplicate"):
        return MUST_GO
    known = initial if initial in ("s", "u", "a") else OTHER
    return known.upper() if fault == "truncated" else known


@lru_cache(maxsize=4_000)
def lightest(symbols: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Cost and audit of the lightest derivation of every item (from, to) over the rows of a segment.

    An item of the agenda is (from, place, state). Axioms are the items at place 0.
    """
    done: dict[tuple[int, int, int], tuple[int, str]] = {}
    agenda = [(0, "", s, 0, s) for s in STATES]
    heapq.heapify(agenda)
    while agenda:
        cost, audit, origin, place, state = heapq.heappop(agenda)
        if (origin, place, state) in done:
            continue
        done[origin, place, state] = cost, audit
        for letter in ROLES:
            if (to := NEXT.get((state, letter))) is not None:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", origin, place, to))
        if place == len(symbols):
            continue
        row = symbols[place]
        heapq.heappush(agenda, (cost + DELETE, audit + "D", origin, place + 1, state))
        if row == MUST_GO:
            continue
        stays = cost + (TRUNCATED if row.isupper() else 0)
        if (to := NEXT.get((state, row.lower()))) is not None:
            heapq.heappush(agenda, (stays + KEEP, audit + "K", origin, place + 1, to))
        for letter in ROLES:
            if (to := NEXT.get((state, letter))) is not None:
                heapq.heappush(agenda, (stays + REROLE, audit + "R", origin, place + 1, to))
    return {(a, b): done[a, len(symbols), b] for a in STATES for b in STATES if (a, len(symbols), b) in done}


def extended_by(prefix: dict[int, tuple[int, str]], segment: dict[tuple[int, int], tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """Deduction with two premises: what led to a state, and a segment's way on from it."""
    out: dict[int, tuple[int, str]] = {}
    for (a, b), (cost, audit) in segment.items():
        if a in prefix:
            found = (prefix[a][0] + cost, prefix[a][1] + audit)
            if b not in out or found < out[b]:
                out[b] = found
    return out


_LONG, _TEXT = pa.int64(), pa.string()
_WAYS = pa.list_(pa.struct([("origin", pa.int32()), ("state", pa.int32()), ("cost", _LONG), ("audit", _TEXT)]))
_SUMS = ["blank", "duplicate", "truncated", "illegal"]
SEGMENTS = pa.schema(
    [("conv_id", _LONG), ("part", pa.int32()), ("number", pa.int32()), ("ways", _WAYS), ("first", _TEXT), ("last", _TEXT)]
    + [(c, _LONG) for c in [*_SUMS, "low", "high", "turns"]]
)
REPORT = pa.schema([("conv_id", _LONG), ("gaps", _LONG), *[(c, _LONG) for c in _SUMS], ("cost", _LONG), ("audit", _TEXT)])
HASHES = pa.schema([("conv_id", _LONG), ("repaired_sha256", _TEXT)])


def _segments(segment: int):
    """Segments of the sorted rows of a task, with what their conversation's sums need."""

    def run(batches):
        part, number, held = TaskContext.get().partitionId(), 0, None

        def closed(h):
            ways = [{"origin": a, "state": b, "cost": c, "audit": t} for (a, b), (c, t) in lightest("".join(h["symbols"])).items()]
            known = h["turns"]
            return {
                "conv_id": h["conv_id"], "part": part, "number": h["number"], "ways": ways, "first": h["first"], "last": h["last"],
                **{k: h[k] for k in _SUMS},
                "low": known[0] if known else None, "high": known[1] if known else None, "turns": known[2] if known else 0,
            }

        for batch in batches:
            out = []
            for conv, turn, initial, fault, copies in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "copies")]):
                for copy in range(copies):
                    if held is not None and (held["conv_id"] != conv or len(held["symbols"]) == segment):
                        out.append(closed(held))
                        held = None
                    if held is None:
                        held = {"conv_id": conv, "number": number, "symbols": [], "first": initial, "last": None, "turns": None}
                        held |= dict.fromkeys(_SUMS, 0)
                        number += 1
                    kind = "duplicate" if copy and fault != "blank" else fault
                    held["symbols"].append(symbol(initial, kind))
                    if kind:
                        held[kind] += 1
                    if held["last"] is not None and held["last"] + initial not in LEGAL:
                        held["illegal"] += 1
                    held["last"] = initial
                    if turn is not None:
                        low, high, n = held["turns"] or (turn, None, 0)
                        held["turns"] = (low, turn, n + (high != turn))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=SEGMENTS)
        if held is not None:
            yield pa.RecordBatch.from_pylist([closed(held)], schema=SEGMENTS)

    return run


def _derived(batches):
    """Joins the segments of each conversation, which come in order."""
    held, out = None, []

    def closed(h):
        cost, audit = min(h["ways"][s] for s in FINAL if s in h["ways"])
        gaps = 0 if h["low"] is None else h["high"] - h["low"] + 1 - h["turns"]
        row = {k: h[k] for k in ["conv_id", *_SUMS]}
        return row | {"gaps": gaps if gaps < 1 << 63 else None, "cost": cost, "audit": audit}

    for batch in batches:
        for row in batch.to_pylist():
            ways = {(w["origin"], w["state"]): (w["cost"], w["audit"]) for w in row["ways"]}
            if held is None or held["conv_id"] != row["conv_id"]:
                if held is not None:
                    out.append(closed(held))
                held = row | {"ways": extended_by({0: (0, "")}, ways)}
                continue
            held["ways"] = extended_by(held["ways"], ways)
            for name in _SUMS:
                held[name] += row[name]
            held["illegal"] += held["last"] + row["first"] not in LEGAL
            held["last"] = row["last"]
            if row["low"] is not None:
                held["turns"] += row["turns"] - (held["high"] == row["low"])
                held["low"] = row["low"] if held["low"] is None else held["low"]
                held["high"] = row["high"]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=REPORT)
            out = []
    if held is not None:
        yield pa.RecordBatch.from_pylist([closed(held)], schema=REPORT)


def edited(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of rows (role, text), which are read as the audit needs them.

    The letters fix the roles: after an optional first s, u and a take turns.
    """
    rows, state = iter(rows), 0
    for letter in audit:
        role, text = next(rows) if letter != "I" else (None, "")
        if letter == "D":
            continue
        if letter == "K":
            state = NEXT[state, role[:1]]
        else:
            state = 3 if state == 2 else 2
            role = ROLES["a" if state == 3 else "u"]
        yield role, text


def _hashed(batches):
    """SHA-256 of each repaired conversation: its audit comes first, then its rows in order."""

    def rows():
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies")])

    def flat(group):
        for _, _, role, text, copies in group:
            for _ in range(copies):
                yield role, text

    names, hashes = [], []
    for conv, group in groupby(rows(), key=lambda r: r[0]):
        _, audit, *_ = next(group)
        total, between = hashlib.sha256(), b""
        for role, text in edited(audit, flat(group)):
            total.update(between + f"{role}:{text}".encode())
            between = b"\n"
        names.append(conv)
        hashes.append(total.hexdigest())
        if len(names) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(hashes)], schema=HASHES)
            names, hashes = [], []
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(hashes)], schema=HASHES)


def repair(rows: DataFrame, segment: int = 256) -> DataFrame:
    """One row for each conversation: gaps, faults, illegal neighbours, cost, audit and the hash of the repaired text."""
    faulty = stored(judged(damaged(rows)), "judged")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    initial = F.substring("role", 1, 1).alias("initial")
    sorted_rows = faulty.repartitionByRange(*order).sortWithinPartitions(*order)
    segments = stored(sorted_rows.select("conv_id", "turn", initial, "fault", "copies").mapInArrow(_segments(segment), from_arrow_schema(SEGMENTS)), "segments")
    report = stored(
        segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(_derived, from_arrow_schema(REPORT)), "derived"
    )
    audits = report.select("conv_id", F.lit(0).alias("later"), "audit", *[F.lit(None).cast(t).alias(c) for c, t in faulty.select("turn", "role", "text", "copies").dtypes])
    lines = faulty.select("conv_id", F.lit(1).alias("later"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies")
    hashed = (
        audits.unionByName(lines)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "later", F.col("turn").asc_nulls_first(), "role", "text")
        .select("conv_id", "audit", "role", "text", "copies")
        .mapInArrow(_hashed, from_arrow_schema(HASHES))
    )
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    with_report = ids.alias("l").join(report.alias("r"), _same("l", "r", ["conv_id"]), "left").select("l.conv_id", *[f"r.{c}" for c in report.columns[1:]], F.col("r.cost").isNull().alias("__none"))
    whole = with_report.alias("l").join(hashed.alias("r"), _same("l", "r", ["conv_id"]), "left")
    none = F.col("l.__none")
    zero = lambda c: F.when(none, F.lit(0)).otherwise(F.col(f"l.{c}")).cast("long").alias(c)
    return whole.select(
        "l.conv_id",
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("l.audit", F.lit("")).alias("audit"),
        F.coalesce("r.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
