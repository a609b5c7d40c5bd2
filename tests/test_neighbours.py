import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stationlake.operators.neighbours import neighbours_where, rolling_mean, rolling_mean_hours, with_neighbours
from stationlake.operators.runs import as_ranges, first_run, run_ends, top_rows
from tests.helpers import rows

SCHEMA = "site string, t timestamp_ntz, v double"


def series(seed: int, sites=("a", "b"), n=120, gap=40.0):
    """Irregular series: many buckets hold fewer rows than the look-back."""
    rng = random.Random(seed)
    out = []
    for site in sites:
        t = dt.datetime(2023, 12, 20)
        for _ in range(n):
            t += dt.timedelta(hours=1 + int(rng.expovariate(1 / gap)))
            out.append((site, t, None if rng.random() < 0.1 else float(rng.randrange(40))))
    rng.shuffle(out)
    return out


def by_site(data):
    for site in sorted({r[0] for r in data}):
        yield site, sorted(r for r in data if r[0] == site)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("before,after", [(7, 0), (1, 7), (2, 3)])
@pytest.mark.parametrize("bucket", ["month", "day"])
def test_neighbours_equal_the_plain_series(spark, seed, before, after, bucket):
    data = series(seed)
    got = with_neighbours(
        spark.createDataFrame(data, SCHEMA), ["site"], "t", ["t", "v"], before, after,
        bucket=F.date_trunc(bucket, "t"),
    )
    found = {
        (r.site, r.t): ([tuple(x) for x in r.prev], [tuple(x) for x in r.next]) for r in got.collect()
    }
    assert len(found) == len(data)
    for _, line in by_site(data):
        for i, (site, t, _) in enumerate(line):
            prev = [r[1:] for r in line[max(0, i - before) : i]] if before else []
            following = [r[1:] for r in line[i + 1 : i + 1 + after]]
            assert found[site, t] == (prev, following)


@pytest.mark.parametrize("before,after", [(1, 7), (3, 0)])
@pytest.mark.parametrize("bucket", ["month", "day"])
def test_neighbours_of_wanted_rows_only(spark, before, after, bucket):
    data = series(3) + [("lone", dt.datetime(2024, 1, 1), 9.0)]
    df = spark.createDataFrame(data, SCHEMA)

    def rising(row, earlier):
        return (row["v"] > earlier["v"]) | (earlier["v"].isNull() & (row["v"] > 5))

    cut = F.date_trunc(bucket, "t")
    every = with_neighbours(df, ["site"], "t", ["v"], before, after, bucket=cut)
    wanted = every.filter(rising(F.struct("v"), F.get("prev", F.size("prev") - 1)))
    got = neighbours_where(df, ["site"], "t", ["v"], rising, before, after, bucket=cut)
    assert got.columns == ["site", "t", "v", "prev", "next"]
    expected = rows(wanted.select(*got.columns), "site", "t")
    assert rows(got, "site", "t") == expected and 0 < len(expected) < len(data)
    with pytest.raises(ValueError):
        neighbours_where(df, ["site"], "t", ["v"], rising, 0, 1)


def test_short_series_need_no_buckets(spark):
    data = series(5, n=30)
    df = spark.createDataFrame(data, SCHEMA)
    plain = with_neighbours(df, ["site"], "t", ["v"], 2, 2, short=True)
    cut = with_neighbours(df, ["site"], "t", ["v"], 2, 2)
    assert rows(plain, "site", "t") == rows(cut, "site", "t")


@pytest.mark.parametrize("gap", [0.0, 30.0])
def test_rolling_mean(spark, gap):
    data = series(3, gap=gap or 0.001)
    got = {
        (r.site, r.t): r.rolling
        for r in rolling_mean(spark.createDataFrame(data, SCHEMA), ["site"], "t", "v").collect()
    }
    for _, line in by_site(data):
        for i, (site, t, _) in enumerate(line):
            values = [v for _, _, v in line[max(0, i - 7) : i + 1] if v is not None]
            expected = sum(values) / len(values) if values else None
            assert got[site, t] == (pytest.approx(expected) if values else None)


def test_rolling_mean_by_clock_does_not_bridge_gaps(spark):
    t = dt.datetime(2024, 1, 31, 22)
    data = [("a", t, 10.0), ("a", t + dt.timedelta(hours=1), 20.0), ("a", t + dt.timedelta(hours=9), 30.0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert [r[-1] for r in rows(rolling_mean_hours(df, ["site"], "t", "v"), "t")] == [10.0, 15.0, 30.0]
    assert [r[-1] for r in rows(rolling_mean(df, ["site"], "t", "v"), "t")] == [10.0, 15.0, 20.0]


@pytest.mark.parametrize("length", [1, 3])
def test_runs_equal_a_loop(spark, length):
    data = series(7)
    df = spark.createDataFrame(data, SCHEMA)
    ends = {
        (r.site, r.t, r.run_start)
        for r in run_ends(df, ["site"], "t", F.col("v") >= 10, length).collect()
    }
    expected, first = set(), {}
    for site, line in by_site(data):
        hits = [v is not None and v >= 10 for _, _, v in line]
        for i in range(length - 1, len(line)):
            if all(hits[i - length + 1 : i + 1]):
                expected.add((site, line[i][1], line[i - length + 1][1]))
                first.setdefault(site, line[i - length + 1][1])
    assert ends == expected
    starts = first_run(df, ["site"], "t", F.col("v") >= 10, length)
    assert dict(rows(starts)) == first


def test_one_site_with_most_rows_is_spread(spark):
    """The window over a site alone must not see its rows, only one row per bucket."""
    df = spark.createDataFrame(series(1), SCHEMA)
    plan = with_neighbours(df, ["site"], "t", ["v"], 7)._jdf.queryExecution().executedPlan().toString()
    sorted_by_site_only = [l for l in plan.splitlines() if "Window" in l and "[site" in l]
    assert all("__bucket" in l for l in sorted_by_site_only)


def test_week_ranges(spark):
    weeks = [("a", w) for w in (14, 20, 21, 22, 22, 30)] + [("b", 5)]
    df = spark.createDataFrame(weeks, "city string, week int")
    assert dict(rows(as_ranges(df, ["city"], "week"))) == {"a": "14, 20–22, 30", "b": "5"}


def test_top_rows_break_ties_by_the_given_order(spark):
    df = spark.createDataFrame([("a", w, 0.5) for w in (3, 1, 2, 4)], "city string, week int, s double")
    top = top_rows(df, ["city"], [F.col("s"), F.col("week")], 3)
    assert [r[1] for r in rows(top, "rank")] == [1, 2, 3]


@pytest.mark.parametrize("short", [True, False])
def test_rows_without_key_or_time_are_in_no_series(spark, short):
    from stationlake.operators.neighbours import with_neighbours

    t = dt.datetime(2024, 5, 1)
    df = spark.createDataFrame([("a", t, 1.0), (None, t, 2.0), ("a", None, 3.0)], "city string, time timestamp_ntz, v double")
    got = with_neighbours(df, ["city"], "time", ["v"], before=1, short=short)
    assert [(r["city"], r["v"], list(r["prev"])) for r in got.collect()] == [("a", 1.0, [])]
