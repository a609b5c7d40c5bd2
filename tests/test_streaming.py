import datetime as dt

import pytest
from pyspark.sql import functions as F

from stationlake.operators.runs import run_ends
from stationlake.sources import tables, versions
from stationlake.streaming import jobs, state
from tests.helpers import hours, rows


class Feed:
    """A folder read as a stream, one file per batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        (folder / "in").mkdir()

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/*")

    def put(self, listed):
        self.spark.createDataFrame(listed, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/{self.n:03d}")
        self.n += 1

    def run(self, writer):
        query = writer.option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    def to_parquet(self, df):
        out = f"{self.folder}/out"
        self.run(df.writeStream.outputMode("append").format("parquet").option("path", out))
        return self.spark.read.schema(df.schema).parquet(out)


VALUES = "city string, pollen_type string, time timestamp_ntz, value double"


def series(values, start="2026-05-01T10:00", city="a"):
    return [(city, "Birch", t, v) for t, v in zip(hours(start, len(values)), values)]


FAR = ("z", "Birch", dt.datetime(2026, 6, 1), 0.0)


def alerts(spark, folder, files, **options):
    """Alerts of a stream that gets the files one by one, called as the stream would."""
    state = folder / "checkpoint"
    state.mkdir(exist_ok=True)
    (state / "metadata").write_text('{"id":"s"}')
    sink = jobs.persistence_alerts(str(folder / "runs"), str(state), 10.0, **options)
    for i, listed in enumerate(files):
        sink(spark.createDataFrame(listed, VALUES), i)
    found = spark.read.schema("city string, pollen_type string, run_start timestamp_ntz, alert_time timestamp_ntz").parquet(f"{folder}/runs/s/alerts/*")
    return sink, rows(found.select("city", "run_start", "alert_time"), "city", "alert_time")


def batch_alerts(spark, listed):
    df = spark.createDataFrame(listed, VALUES)
    ends = run_ends(df, ["city"], "time", F.col("value") >= 10.0, 3, short=True).select("city", "run_start", "time")
    return [r for r in rows(ends, "city", "time") if r[1] - dt.timedelta(hours=1) not in [t for c, _, t, v in listed if c == r[0] and v and v >= 10]]


LINE = series([25.0, 25.0, 25.0, 5.0, 12.0, 11.0])


@pytest.mark.parametrize("second", [m for m in range(1, 63) if bin(m).count("1") in (2, 3)][::3])
def test_any_split_into_files_gives_the_runs_of_the_whole(spark, tmp_path, second):
    files = [[r for i, r in enumerate(LINE) if (second >> i & 1) == part] for part in (1, 0)]
    _, got = alerts(spark, tmp_path, [*files, [FAR]])
    assert got == batch_alerts(spark, LINE) == [("a", dt.datetime(2026, 5, 1, 10), dt.datetime(2026, 5, 1, 12))]


def test_runs_interruptions_and_rows_that_come_too_late(spark, tmp_path):
    line = series([12.0, 15.0, 3.0, 25.0]) + series([12.0, None, 12.0, 12.0], city="b") + series([10.0] * 7, city="c")
    files = [line[::2], line[1::2], [FAR], series([99.0], start="2026-05-01T09:00"), [("c", "Birch", dt.datetime(2026, 6, 2), 10.0)], [("z", "Birch", dt.datetime(2026, 7, 1), 0.0)]]
    sink, got = alerts(spark, tmp_path, files)
    assert got == [("c", dt.datetime(2026, 5, 1, 10), dt.datetime(2026, 5, 1, 12))]
    late = spark.read.parquet(f"{tmp_path}/runs/s/late/*")
    assert rows(late.select("city", "value")) == [("a", 99.0)]
    sink(spark.createDataFrame(files[-1], VALUES), len(files) - 1)
    found = spark.read.parquet(f"{tmp_path}/runs/s/alerts/*")
    assert found.count() == 1
    assert len(list((tmp_path / "runs/s/state").iterdir())) <= 3


def test_a_run_of_one_row(spark, tmp_path):
    _, got = alerts(spark, tmp_path, [series([12.0, 15.0, 3.0, 25.0]), [FAR]], length=1)
    assert [r[2].hour for r in got] == [10, 13]


def test_repeated_batches_change_nothing(spark, tmp_path):
    schema = "city string, time timestamp_ntz, v double, loaded_at timestamp_ntz"
    feed = Feed(spark, tmp_path, schema)
    t, load = dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 2)
    feed.put([("a", t, 1.0, load)])
    feed.put([("a", t, 2.0, load + dt.timedelta(days=1)), ("b", t, 5.0, load)])
    path = str(tmp_path / "table")
    sink = jobs.upsert_batches(path)
    feed.run(feed.stream().writeStream.foreachBatch(sink))
    expected = [("a", 2.0), ("b", 5.0)]
    assert rows(tables.read_upserted(spark, path).select("city", "v"), "city") == expected
    sink(spark.read.parquet(f"{tmp_path}/in/001"), 1)
    assert rows(tables.read_upserted(spark, path).select("city", "v"), "city") == expected


def test_daily_windows_accept_late_hours(spark, tmp_path):
    schema = "city string, t timestamp_ntz, v double"
    feed = Feed(spark, tmp_path, schema)
    feed.put([("a", t, 1.0) for t in hours("2024-05-01", 24)])
    feed.put([("a", t, 3.0) for t in hours("2024-05-02", 24)] + [("b", dt.datetime(2024, 5, 1, 5), 7.0)])
    feed.put([("a", dt.datetime(2024, 5, 9), 0.0)])
    feed.put([("a", dt.datetime(2024, 5, 9, 1), 0.0)])
    feed.put([("a", dt.datetime(2024, 5, 1, 3), 99.0), ("a", dt.datetime(2024, 5, 10), 0.0)])
    got = feed.to_parquet(jobs.daily_windows(feed.stream(), "t", {"v": "v"}))
    assert rows(got, "city", "day") == [
        ("a", dt.date(2024, 5, 1), 1.0, 1.0, 24), ("a", dt.date(2024, 5, 2), 3.0, 3.0, 24),
        ("b", dt.date(2024, 5, 1), 7.0, 7.0, 1),
    ]


def test_each_alert_is_passed_on_once(spark, tmp_path):
    schema = "alert_key string, alert_time timestamp"
    feed = Feed(spark, tmp_path, schema)
    t = dt.datetime(2024, 5, 1)
    feed.put([("x", t), ("x", t + dt.timedelta(hours=1))])
    feed.put([("x", t + dt.timedelta(hours=2)), ("y", t)])
    got = feed.to_parquet(jobs.deduplicated(feed.stream()))
    assert sorted(r.alert_key for r in got.collect()) == ["x", "y"]


@pytest.mark.parametrize("day", [None, "day"])
def test_the_ledger_survives_repeated_batches_and_a_new_checkpoint(spark, tmp_path, day):
    ledger, out = str(tmp_path / "ledger"), str(tmp_path / "out")

    def stream(name):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata").write_text(f'{{"id":"{name}"}}')
        return jobs.new_alerts(ledger, out, str(tmp_path / name), day)

    def keys(*listed):
        return spark.createDataFrame([(k, dt.date(2024, 5, int(k[1]))) for k in listed], "alert_key string, day date")

    first, second = stream("one"), stream("two")
    first(keys("k1", "k1"), 0)
    second(keys("k2"), 0)
    second(keys("k1"), 1)
    second(keys("k1", "k3"), 2)
    second(keys("k1", "k3"), 2)
    assert rows(spark.read.parquet(out).select("alert_key", "run", "batch"), "alert_key") == [("k1", "one", 0), ("k2", "two", 0), ("k3", "two", 2)]
    assert rows(jobs.read_ledger(spark, ledger).select("alert_key", "run"), "alert_key") == [("k1", "one"), ("k2", "two"), ("k3", "two")]


def test_the_ledger_is_compact_and_forgets(spark, tmp_path, monkeypatch):
    ledger, out = str(tmp_path / "ledger"), str(tmp_path / "out")
    (tmp_path / "one").mkdir()
    (tmp_path / "one/metadata").write_text('{"id":"one"}')
    sink = jobs.new_alerts(ledger, out, str(tmp_path / "one"), "day", remember=10)

    def send(batch, *listed):
        sink(spark.createDataFrame([(f"k{i}", dt.date(2024, m, d)) for i, m, d in listed], "alert_key string, day date"), batch)

    for batch in range(3):
        send(batch, (batch, 5, 1), (0, 5, 1))
    # Three batches of one day leave one file of the day.
    assert len(jobs.read_ledger(spark, ledger).inputFiles()) == 1
    send(3, (7, 5, 20))
    assert rows(jobs.read_ledger(spark, ledger).select("alert_key"), "alert_key") == [("k7",)]
    # Another stream comes first: the batch is judged again.
    commit, raced = versions.commit, []

    def overtaken(spark_, path_, new):
        if not raced:
            raced.append(1)
            (tmp_path / "two").mkdir()
            (tmp_path / "two/metadata").write_text('{"id":"two"}')
            monkeypatch.setattr(versions, "commit", commit)
            jobs.new_alerts(ledger, out, str(tmp_path / "two"), "day")(spark.createDataFrame([("k8", dt.date(2024, 5, 20))], "alert_key string, day date"), 0)
        commit(spark_, path_, new)

    monkeypatch.setattr(versions, "commit", overtaken)
    send(4, (8, 5, 20), (9, 5, 20))
    passed_on = spark.read.parquet(out).select("alert_key", "run").filter("alert_key IN ('k8', 'k9')")
    assert rows(passed_on, "alert_key") == [("k8", "two"), ("k9", "one")]


@pytest.fixture
def keyed(spark):
    before = {name: spark.conf.get(name, None) for name in state.STORE}
    for name, value in state.STORE.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def keyed_alerts(spark, folder, files, **options):
    """Alerts of the files, one a batch, and the state rows each batch wrote."""
    for i, listed in enumerate(files):
        spark.createDataFrame(listed, VALUES).coalesce(1).write.parquet(f"{folder}/in/{i:02d}")
    stream = spark.readStream.schema(VALUES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    out = state.run_alerts(stream, 10.0, **options).writeStream.format("parquet").option("path", f"{folder}/out")
    query = out.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema("city string, pollen_type string, run_start timestamp_ntz, alert_time timestamp_ntz").parquet(f"{folder}/out")
    return rows(found.select("city", "run_start", "alert_time"), "city", "alert_time"), query.recentProgress


@pytest.mark.parametrize("second", [19, 42])
def test_keyed_state_gives_the_runs_of_the_whole(keyed, tmp_path, second):
    files = [[r for i, r in enumerate(LINE) if (second >> i & 1) == part] for part in (1, 0)]
    got, _ = keyed_alerts(keyed, tmp_path, [*files, [FAR]])
    assert got == batch_alerts(keyed, LINE)


def test_keyed_state_of_interruptions_and_untouched_series(keyed, tmp_path):
    line = series([12.0, 15.0, 3.0, 25.0]) + series([12.0, None, 12.0, 12.0], city="b") + series([10.0] * 7, city="c")
    files = [line[::2], line[1::2], [FAR], [(None, None, dt.datetime(2026, 6, 1), 50.0)] * 3, [("z", "Birch", dt.datetime(2026, 7, 1), 0.0)]]
    got, progress = keyed_alerts(keyed, tmp_path, files)
    june = dt.datetime(2026, 6, 1)
    assert sorted(got, key=repr) == sorted([("c", dt.datetime(2026, 5, 1, 10), dt.datetime(2026, 5, 1, 12)), (None, june, june)], key=repr)
    # Later batches write the state of the series they bring, not of all.
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["numInputRows"]]
    assert written[-1] < written[0]
