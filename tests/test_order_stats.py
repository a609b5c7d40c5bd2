import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from stationlake.operators.order_stats import average_ranks, positions, quantiles, spearman, value_counts, with_value_parts
from stationlake.plans.profiles import describe

SCHEMA = "g string, x double, y double"


def frame(seed: int) -> pd.DataFrame:
    rng = random.Random(seed)
    rows = []
    for g, n in (("a", 400), ("b", 7), ("c", 1)):
        for _ in range(n):
            x = rng.choice([0.0, 0.0, -3.5, rng.uniform(-50, 50), rng.uniform(0, 1e6), 1e-9, None])
            y = rng.choice([0.0, rng.gauss(0, 5), rng.randrange(4) * 1.0, None])
            rows.append((g, x, y))
    return pd.DataFrame(rows, columns=["g", "x", "y"])


def spark_frame(spark, df):
    listed = [tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False)]
    return spark.createDataFrame(listed, SCHEMA)


@pytest.mark.parametrize("rescan", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles(spark, seed, rescan):
    df = frame(seed)
    probs = {"x": {"lo": 0.1, "mid": 0.5, "third": 2 / 3}, "y": {"top": 0.99}}
    got = quantiles(spark_frame(spark, df), ["g"], probs, rescan).toPandas().set_index("g")
    for g, part in df.groupby("g"):
        for column, named in probs.items():
            for name, q in named.items():
                expected = part[column].quantile(q)
                if pd.isna(expected):
                    assert g not in got.index or pd.isna(got.loc[g, name])
                else:
                    assert got.loc[g, name] == pytest.approx(expected)


def test_quantiles_of_the_whole_table(spark):
    df = frame(4)
    got = quantiles(spark_frame(spark, df), [], {"x": {"q": 0.25}}).collect()
    assert got[0].q == pytest.approx(df["x"].quantile(0.25))


@pytest.mark.parametrize("seed", [1, 2])
def test_average_ranks(spark, seed):
    df = frame(seed)
    got = average_ranks(spark_frame(spark, df), ["g"], "x").toPandas()
    for g, part in df.groupby("g"):
        expected = dict(zip(part["x"], part["x"].rank()))
        mine = got[got["g"] == g]
        for value, rank in zip(mine["value"], mine["rank"]):
            assert rank == pytest.approx(expected[value])


def test_spearman_is_pairwise_complete(spark):
    df = frame(5)
    got = spearman(spark_frame(spark, df), ["g"], [("x", "y")]).toPandas().set_index("g")
    for g, part in df.groupby("g"):
        both = part.dropna()
        if len(both) == 0:
            assert g not in got.index
            continue
        assert got.loc[g, "n"] == len(both)
        rho = both["x"].rank().corr(both["y"].rank()) if len(both) > 1 else np.nan
        if pd.isna(rho):
            assert pd.isna(got.loc[g, "rho"])
        else:
            assert got.loc[g, "rho"] == pytest.approx(rho)


def test_spearman_of_many_columns_with_patterns_of_missing_values(spark):
    rng = random.Random(11)
    columns = ["a", "b", "c", "d"]
    data = []
    for i in range(500):
        base = rng.gauss(0, 1)
        row = [rng.choice([base, float(round(base)), 0.0]), base + rng.gauss(0, 1), float(rng.randrange(3)), -base]
        data.append((rng.choice(["u", None]), *[None if rng.random() < 0.2 * (k > 0) else v for k, v in enumerate(row)]))
    df = spark.createDataFrame(data, "g string, " + ", ".join(f"{c} double" for c in columns))
    pairs = [(x, y) for k, x in enumerate(columns) for y in columns[:k]]
    out = spearman(df, ["g"], pairs)
    got = {(r["g"], r["var1"], r["var2"]): r for r in out.collect()}
    assert len(got) == 12
    for (g, x, y), r in got.items():
        part = pd.DataFrame([d[1:] for d in data if d[0] == g], columns=columns)[[x, y]].dropna()
        assert r["n"] == len(part)
        assert r["rho"] == pytest.approx(part[x].rank().corr(part[y].rank()))


def test_parts_follow_the_order_of_any_doubles(spark):
    draw = np.random.default_rng(8)
    bits = draw.integers(0, 2**64, 4000, dtype=np.uint64).view(np.float64)
    near = [x for k in range(-1040, 1020, 37) for x in (2.0**k, np.nextafter(2.0**k, 0), np.nextafter(2.0**k, 9e307))]
    values = [*bits[~np.isnan(bits)].tolist(), *near, *[-x for x in near], 0.0, -0.0, 5e-324, 1.797e308, 9e307, 1.7976931348623157e308, -1.797e308, -9e307, float("inf"), float("-inf"), 1.7e308, 1.7e9, 1.7e9 + 1e-6]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = sorted(with_value_parts(df, "a", "b", "v").collect(), key=lambda r: r["v"])
    parts = [(r["a"], r["b"]) for r in got]
    assert parts == sorted(parts)
    assert with_value_parts(spark.range(1).select(F.lit(float("nan")).alias("value"))).first()["high"] > max(p[0] for p in parts)


@pytest.mark.parametrize("value", ["1.7e9 + id", "1013 + id / 200000", "id * 1e-300", "1e15 + id"])
def test_no_window_holds_more_than_its_bound(spark, value):
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.expr(f"CAST({value} AS DOUBLE)").alias("x"))
    parts = with_value_parts(df.select("x"), "a", "b", "x").distinct()
    inner = parts.groupBy("a", "b").count().agg(F.max("count")).first()[0]
    middle = parts.select("a", "b").distinct().groupBy("a").count().agg(F.max("count")).first()[0]
    assert inner <= 1 << 21 and middle <= 1 << 21 and (inner < 100 or middle < 100)
    placed = positions(value_counts(df, ["g"], ["x"]), ["g"])
    plain = Window.partitionBy("g").orderBy("value")
    wrong = placed.withColumn("plain", F.sum("n").over(plain) - F.col("n")).filter("plain <> before OR total <> 200000")
    assert placed.count() == df.distinct().count() and wrong.count() == 0


def test_groups_without_name_or_values_stay(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 2.0), ("y", None)], "g string, v double")
    got = {r["g"]: r for r in describe(df, ["g"], "v", [0.5]).collect()}
    assert got[None]["p50"] == 2.0 and got["x"]["p50"] == 2.0
    assert got["y"]["p50"] is None and got["y"]["count"] == 0
    for rescan in (False, True):
        assert {r["g"]: r["q"] for r in quantiles(df, ["g"], {"v": {"q": 0.5}}, rescan).collect()} == {None: 2.0, "x": 2.0, "y": None}
    assert quantiles(df.limit(0), ["g"], {"v": {"q": 0.5}}).collect() == []
    assert [r["q"] for r in quantiles(df.limit(0), [], {"v": {"q": 0.5}}).collect()] == [None]


@pytest.mark.parametrize("rescan", [False, True])
def test_quantiles_of_any_doubles(spark, rescan):
    draw = np.random.default_rng(3)
    far = [float("inf"), float("-inf"), 5e-324, -5e-324, 0.0, -0.0, 1.7976931348623157e308]
    close = [1.0 + k * 2.0**-52 for k in range(40)]
    values = [*far, *close, *close, *draw.normal(0, 1e-3, 200).tolist(), *[7.0] * 300]
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", float("nan")), ("h", 1.0), ("h", 2.0)], "g string, v double")
    wanted = {f"q{i}": i / (len(values) - 1) for i in (0, 1, 5, 100, 250, 280, 330, len(values) - 2, len(values) - 1)}
    got = {r["g"]: r for r in quantiles(df, ["g"], {"v": wanted}, rescan).collect()}
    ordered = sorted(values)
    for name, q in wanted.items():
        at = (len(values) - 1) * q
        lo, hi = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        assert got["g"][name] == pytest.approx(lo + (hi - lo) * (at - np.floor(at)), nan_ok=True) or lo == hi == got["g"][name]
    assert got["h"]["q0"] == 1.0


def test_only_counts_are_sorted(spark):
    """Selection joins and numbers counts of parts; with rescan no exchange carries the values themselves."""
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    text = quantiles(df, ["g"], {"v": {"q": 0.5}}, rescan=True)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert len(windows) == 4 and sum("value" in w.split("windowspecdefinition")[1].split("ASC")[0] for w in windows) == 1
