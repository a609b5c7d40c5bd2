"""Neighbours against brute force: exact scores, order, and recall."""

import numpy as np
import pytest

from stationlake.llm import hamming


def brute(rows, queries, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i, v in queries:
        d = np.sqrt(((x - np.array(v, np.float64)) ** 2).sum(axis=1))
        d[ids == i] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in order if np.isfinite(d[j])]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = [tuple(r) for r in df.collect()]
    asked = [r for r in rows if r[0] % 100 == 0]
    got = found(hamming.search(df, df.filter("vec_id % 100 = 0"), block=7))
    truth = brute(rows, asked, 10)
    assert got.keys() == truth.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert hits / sum(map(len, truth.values())) >= 0.9
    vector = dict(rows)
    for q, listed in got.items():
        assert listed == sorted(listed, key=lambda p: (p[1], p[0]))
        for i, s in listed:
            assert s == pytest.approx(np.linalg.norm(np.array(vector[i], float) - np.array(vector[q], float)), rel=1e-12)


def test_probing_retrieves_every_code_within_the_radius():
    draw = np.random.default_rng(1)
    codes = draw.integers(0, 256, (500, 4), dtype=np.uint8)
    codes[::5] = codes[0] ^ draw.integers(0, 4, (100, 4), dtype=np.uint8)
    buckets = hamming.bucketed(codes)
    for radius in (0, 1, 3, 6, 12, 20, 32):
        for q in codes[:20]:
            assert hamming.within(buckets, codes, q, radius).tolist() == np.flatnonzero(hamming.apart(codes, q) <= radius).tolist()


def test_odd_vectors_ties_and_repeats(spark):
    same = [0.5, 0.25, -1.0]
    rows = [(100, same), (200, same), (200, same)] + [(i, same) for i in range(1, 40)]
    rows += [(300, None), (400, [0.0, 0.0, 0.0]), (500, [1.0, None, 2.0]), (600, [float("nan"), 1.0, 1.0]), (700, [1.0, 2.0]), (None, same), (41, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, rank string, score double")
    got = found(hamming.search(df, df.filter("vec_id % 100 = 0")))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {100: list(range(1, 11)), 200: list(range(1, 11))}
    assert all(s == 0.0 for v in got.values() for _, s in v)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [4.0, 2.0])], "vec_id long, embedding array<double>")
    assert {q: [i for i, _ in v] for q, v in found(hamming.search(df, df.filter("vec_id = 0"))).items()} == {0: [1, 2]}
    assert hamming.search(df.limit(0), df).collect() == []
    assert hamming.search(df, df.limit(0)).collect() == []
