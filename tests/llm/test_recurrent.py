"""The recurrent model: counts against plain code, gradients, sums of probabilities, gain over the base."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from stationlake.llm import recurrent
from stationlake.llm.hashing import Lookup

SMALL = recurrent.Shape(hidden=6, head=20, classes=4, shared=3, inputs=5, window=5, lanes=4, listed=10)


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lowered).split(" ") if w] + [None]


def base_scores(docs):
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    counts = Counter(w for d, t in docs if not held[d] for w in split(t))
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for d, t in docs:
        words = split(t)
        score = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        out.append((d, held[d], len(words), sum(counts[w] > 0 for w in words), total, score))
    return out


def test_counts_and_base_equal_plain_code(spark):
    docs = [(i, t) for i, t in enumerate(["a b c", "A  b\tD", None, "", "z" * 50_000, "b b b é É", "x y", "x y z a q r s t u v w"] * 6)] + [(3, None), (None, "a b"), (7, "x y"), (7, "x y")]
    df = spark.createDataFrame([(*d, 1.5, "n") for d in docs], "doc_id long, text string, score double, n_tokens string")
    got = recurrent.score(df, shape=SMALL).collect()
    plain = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    assert sorted(plain(tuple(r)) for r in got) == sorted(plain(r) for r in base_scores(docs))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert recurrent.score(df.limit(0), shape=SMALL).collect() == []
    only_held = df.filter("crc32(CAST(doc_id AS STRING)) % 5 = 1")
    assert {r["train_tokens"] for r in recurrent.score(only_held, shape=SMALL).collect()} == {0}


def test_held_out_texts_are_not_learned_from(spark):
    listed = [(i, f"common words {i % 7} in a row") for i in range(60)]
    other = [(d, "entirely other text" if zlib.crc32(str(d).encode()) % 5 == 1 else t) for d, t in listed]
    score = lambda rows: {r["doc_id"]: r["score"] for r in recurrent.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shape=SMALL).collect()}
    a, b = score(listed), score(other)
    assert all(a[d] == pytest.approx(b[d], rel=1e-6) for d, _ in listed if zlib.crc32(str(d).encode()) % 5 != 1)


def network():
    draw = np.random.default_rng(0)
    return recurrent.Network.start(SMALL, draw.integers(1, 90, SMALL.head).astype(float), draw.integers(1, 90, SMALL.shared).astype(float))


def test_gradients_equal_differences():
    net, draw = network(), np.random.default_rng(1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    steps, lanes = 5, 3
    inputs = draw.integers(0, len(net.weights["input"]), (steps, lanes))
    begins = draw.random((steps, lanes)) < 0.3
    state = draw.normal(size=(lanes, SMALL.hidden)).astype(np.float32)
    there = np.flatnonzero(draw.random(steps * lanes) < 0.8)
    kind = draw.integers(0, SMALL.classes + SMALL.shared, len(there))
    word = np.where(kind < SMALL.classes, draw.integers(0, SMALL.per_class, len(there)), 0)
    loss = lambda: net.gradients(inputs, begins, state, kind, word, there)[2] / len(there)
    grads = net.gradients(inputs, begins, state, kind, word, there)[0]
    rows, g = grads.pop("input")
    grads["input"] = np.zeros_like(net.weights["input"])
    grads["input"][rows] = g
    for name, w in net.weights.items():
        for at in draw.integers(0, w.size, 6):
            at = np.unravel_index(at, w.shape)
            old = w[at]
            w[at] = old + 1e-2
            up = loss()
            w[at] = old - 1e-2
            down = loss()
            w[at] = old
            assert grads[name][at] == pytest.approx((up - down) / 2e-2, rel=0.02, abs=2e-4), (name, at)


def test_probabilities_of_all_words_sum_to_one():
    net = network()
    states = np.random.default_rng(3).normal(size=(4, SMALL.hidden)).astype(np.float32)
    total = np.zeros(4)
    for k in range(SMALL.classes + SMALL.shared):
        for w in range(SMALL.per_class if k < SMALL.classes else 1):
            total += np.exp(net.logs(states, np.full(4, k), np.full(4, w))[0])
    assert total == pytest.approx(np.ones(4), abs=1e-4)


@pytest.mark.parametrize("least", [0, 20])
def test_lanes_hold_every_token_once_and_carry_the_state(least):
    starts = np.concatenate(([0], np.cumsum([7, 1, 30, 2, 2, 19])))
    seen, net = [], network()
    inputs = np.random.default_rng(5).integers(0, 20, int(starts[-1]))
    whole, got = np.zeros((int(starts[-1]), SMALL.hidden)), np.zeros((int(starts[-1]), SMALL.hidden))
    for a, b in zip(starts[:-1], starts[1:]):
        begins = np.zeros((b - a, 1), bool)
        whole[a:b] = net.forward(inputs[a:b, None], begins, np.zeros((1, SMALL.hidden), np.float32))[0][:, 0]
    state = None
    for places, begins in recurrent.windows(starts, SMALL, least):
        live = places.shape[1]
        state = np.zeros((live, SMALL.hidden), np.float32) if state is None else state[:live]
        out = net.forward(inputs[places], begins, state)[0]
        state = out[-1]
        there = places >= 0
        got[places[there]] = out[there]
        seen += places[there].tolist()
    assert sorted(seen) == list(range(int(starts[-1])))
    assert got == pytest.approx(whole, abs=1e-6)


def test_shared_class_of_spark_equals_numpy(spark):
    values = np.random.default_rng(9).integers(0, 2**64, 300, dtype=np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "initial long")
    got = [r[0] for r in df.select(recurrent._modulo("initial", 40)).collect()]
    assert got == (values % np.uint64(40)).astype(int).tolist()


def test_gain_over_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(4)
    rows = [r for r in recurrent.score(docs).collect() if r["held_out"]]
    score, base, n = (sum(r[c] for r in rows) for c in ("score", "base_score", "n_tokens"))
    print(score / n, base / n)
    assert score / n > base / n + 0.05


def test_lookup():
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    keys = np.unique(keys)
    table = Lookup(keys)
    assert table.find(keys).tolist() == list(range(len(keys)))
    assert (table.find(keys[:100] ^ np.uint64(1)) == len(keys)).all()
    assert Lookup(keys[:0]).find(keys[:3]).tolist() == [0, 0, 0]
