"""Conversation repair against all edit scripts, and against a plain table of states."""

import hashlib
import random
import re
import zlib

import pytest

from stationlake.llm import repair

SPACE = " \t\n\v\f\r"
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def all_scripts(rows):
    """The best of all edit scripts with up to four new rows."""
    best = None

    def go(i, out, cost, audit, new):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
            best = cost, audit
        if new < 4:
            for c in "ua":
                go(i, out + c, cost + 2, audit + "I", new + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, out, cost + 3, audit + "D", new)
            if fault not in ("blank", "duplicate"):
                stays = cost + (fault == "truncated")
                go(i + 1, out + (initial or "?"), stays, audit + "K", new)
                for c in "ua":
                    go(i + 1, out + c, stays + 2, audit + "R", new)

    go(0, "", 0, "", 0)
    return best


def with_new_rows(ways):
    found = {s: list(listed) for s, listed in ways.items()}
    last = ways
    for _ in range(2):
        step = {}
        for s, listed in last.items():
            for c in "ua":
                if (s, c) in MOVES:
                    step.setdefault(MOVES[s, c], []).extend((cost + 2, audit + "I") for cost, audit in listed)
        for s, listed in step.items():
            found.setdefault(s, []).extend(listed)
        last = step
    return {s: min(listed) for s, listed in found.items()}


def plain_cheapest(rows):
    ways = with_new_rows({0: [(0, "")]})
    for initial, fault in rows:
        step = {}
        for s, (cost, audit) in ways.items():
            step.setdefault(s, []).append((cost + 3, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            stays = cost + (fault == "truncated")
            if (s, initial) in MOVES:
                step.setdefault(MOVES[s, initial], []).append((stays, audit + "K"))
            for c in "ua":
                if (s, c) in MOVES:
                    step.setdefault(MOVES[s, c], []).append((stays + 2, audit + "R"))
        ways = with_new_rows({s: [min(listed)] for s, listed in step.items()})
    return min(ways[s] for s in (0, 3) if s in ways)


def plain_repair(rows):
    left, out = list(plain_damage(rows)), []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        seen, judged = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role[:1], fault))
        cost, audit = plain_cheapest(judged) if judged else (0, "")
        kept, given = [], iter(own)
        for letter in audit:
            row = next(given) if letter != "I" else None
            if letter == "K":
                kept.append((row[2], row[3]))
            elif letter != "D":
                role = "assistant" if kept and kept[-1][0][:1] == "u" else "user"
                kept.append((role, row[3] if row else ""))
        counts = [sum(f == k for _, f in judged) for k in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def repaired(df, **options):
    return sorted(map(tuple, repair.repair(df, **options).collect()), key=repr)


def test_agenda_against_all_scripts():
    rng = random.Random(5)
    for _ in range(800):
        rows = [
            (rng.choice("ssuuaax") if rng.random() < 0.95 else "", rng.choice([None, None, "blank", "duplicate", "truncated"]))
            for _ in range(rng.randrange(5))
        ]
        ways = repair.lightest("".join(repair.symbol(*r) for r in rows))
        found = min(ways[0, s] for s in repair.FINAL if (0, s) in ways)
        assert found == all_scripts(rows) == plain_cheapest(rows)


@pytest.mark.parametrize("segment", [256, 1, 3])
def test_given_conversations(spark, segment):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert repaired(df, segment=segment) == plain_repair([tuple(r) for r in df.collect()])


def test_odd_rows(spark):
    rng = random.Random(8)
    given = [
        (rng.choice([None, 1, 2]), rng.choice([None, 0, 1, 2, 5, 9]), rng.choice([None, "", "user", "assistant", "system", "tool", "ask"]), text)
        for text in [None, "", " \t", "Yes.", "yes", "é!", "a" * 200_000 + "?", "Yes. ", "\u00a0", "No."] * 4
    ]
    # A conversation whose only row falls away, long ones, equal rows, turns far apart.
    dropped = next(c for c in range(10, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    given.append((dropped, 0, "user", "x."))
    given += [(4, t, rng.choice(["user", "assistant"]), f"{t % 50}.") for t in range(700)]
    given += [(5, 7, "user", "Same.")] * 30 + [(6, -(1 << 62), "user", "a."), (6, (1 << 61), "assistant", "b.")]
    df = spark.createDataFrame([(*g, 1, "x") for g in given], "conv_id long, turn long, role string, text string, copies int, Fault string")
    expected = plain_repair(given)
    for segment in (256, 5):
        assert repaired(df, segment=segment) == expected
    assert [r[0] for r in expected if r[7] == "" and r[6] == 0] == [dropped]
    assert repaired(df.limit(0)) == []
    far = spark.createDataFrame([(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    assert len(repaired(far)) == 1
