import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from stationlake.model import LOAD_LOG_SCHEMA, ZONE, raw_schema, site_dimension
from stationlake.sources import landing, tables, versions
from tests.helpers import hours, rows

VARIABLES = ["alder_pollen", "birch_pollen"]
BODY = json.dumps(
    {
        "hourly": {
            "time": ["2025-03-08T22:00", "2025-03-08T23:00", "2025-03-09T00:00", "2025-03-09T01:00"],
            "alder_pollen": [1.5, None, 7.0, None],
            "birch_pollen": [0.0, 2.5, 0.5, None],
        },
    }
)


def payloads(spark, *bodies):
    listed = [(c, b, dt.date(2026, 5, 1)) for c, b in bodies]
    return spark.createDataFrame(listed, "city string, body string, start date")


def test_payload_rows(spark):
    got = rows(landing.payload_rows(payloads(spark, ("a", BODY)), VARIABLES), "time")
    assert got == [
        ("a", dt.datetime(2025, 3, 8, 22), 1.5, 0.0),
        ("a", dt.datetime(2025, 3, 8, 23), None, 2.5),
        ("a", dt.datetime(2025, 3, 9, 0), 7.0, 0.5),
    ]


def test_not_a_number_becomes_unknown(spark):
    body = '{"hourly": {"time": ["2026-05-01T09:00"], "alder_pollen": [NaN], "birch_pollen": [1.0]}}'
    assert landing.payload_rows(payloads(spark, ("a", body)), VARIABLES).first().alder_pollen is None


def test_files_below_site_folders(spark, tmp_path):
    for city in ("Malmö", "Luleå"):
        folder = tmp_path / f"city={city}"
        folder.mkdir()
        (folder / "2026.json").write_text(BODY)
    read = landing.read_payloads(spark, str(tmp_path))
    got = landing.payload_rows(read, VARIABLES).groupBy("city").count()
    assert dict(rows(got)) == {"Malmö": 3, "Luleå": 3}


def test_files_are_loaded_once_and_bad_ones_set_aside(spark, tmp_path):
    for city, name, body in (("Malmö", "a", BODY), ("Malmö", "b", "no json"), ("007", "a", BODY), ("__HIVE_DEFAULT_PARTITION__", "a", BODY)):
        folder = tmp_path / f"city={city}"
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.json").write_text(body)
        os.utime(folder / f"{name}.json", (1.7e9, 1.7e9))
    first = landing.read_payloads(spark, str(tmp_path))
    loaded, rejects = landing.loaded_files(first, VARIABLES, dt.datetime(2026, 5, 2))
    assert loaded.schema.simpleString() == raw_schema(VARIABLES).simpleString()
    assert dict(rows(loaded.groupBy("city").count())) == {"Malmö": 3, "007": 3}
    assert sorted((str(r.city), r.problem, r.body) for r in rejects.collect()) == [("Malmö", "unreadable", "no json"), ("None", "no site", BODY)]
    seen = spark.createDataFrame(first.select("file", "modified").collect(), "file string, modified timestamp")
    assert landing.read_payloads(spark, str(tmp_path), seen).count() == 0
    # A file that is mended is read again, an empty one gives nothing, the others are not read.
    (tmp_path / "city=Malmö" / "b.json").write_text(BODY)
    (tmp_path / "city=007" / "c.json").write_text("")
    again = landing.read_payloads(spark, str(tmp_path), seen)
    assert sorted(r.file.rsplit("/", 1)[1] for r in again.collect()) == ["b.json"]
    newer = landing.read_payloads(spark, str(tmp_path), after=dt.datetime(2025, 1, 1))
    assert {r.file.rsplit("/", 1)[1] for r in newer.collect()} == {"b.json"}


def test_a_bad_payload_does_not_stop_the_others(spark):
    late = BODY.replace("2025-03-08T23:00", "yesterday")
    short = BODY.replace('"2025-03-08T22:00", ', "")
    landed = payloads(
        spark, ("a", BODY), ("b", "no json"), ("b", BODY), ("c", "{}"), ("d", late), ("d", BODY), ("e", short), ("f", None), ("f", short), ("f", late)
    )
    loaded = landing.payload_rows(landed, VARIABLES)
    log = landing.load_log(
        landed, loaded, "air_quality", dt.date(2026, 5, 1), dt.datetime(2026, 5, 2, 4), VARIABLES
    )
    assert log.schema.simpleString() == LOAD_LOG_SCHEMA.simpleString()
    got = rows(log.select("city", "rows_loaded", "status", "error"), "city")
    assert got == [
        ("a", 3, "ok", None),
        ("b", 3, "error", "1 unreadable payload(s)"),
        ("c", 0, "error", "1 unreadable payload(s)"),
        ("d", 3, "error", "1 bad time payload(s)"),
        ("e", 0, "error", "1 uneven arrays payload(s)"),
        ("f", 0, "error", "1 unreadable, 1 uneven arrays, 1 bad time payload(s)"),
    ]
    assert landing.last_run(log, ZONE).first().last_run_local == dt.datetime(2026, 5, 2, 6)


def test_lineage_time(spark):
    stamped = landing.with_lineage(spark.range(1), dt.datetime(2026, 5, 1)).first()
    assert stamped.loaded_at == dt.datetime(2026, 5, 1)
    now = landing.with_lineage(spark.range(1)).first().loaded_at
    assert abs(now - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) < dt.timedelta(minutes=5)


def test_next_start(spark):
    target = spark.createDataFrame(
        [("Malmö", dt.datetime(2026, 5, 1, 13)), ("Malmö", dt.datetime(2026, 4, 1))],
        "city string, time timestamp_ntz",
    )
    got = landing.next_start(target, site_dimension(spark).select("city"), dt.date(2021, 1, 1))
    starts = dict(rows(got))
    assert starts["Malmö"] == dt.date(2026, 5, 1) and starts["Luleå"] == dt.date(2021, 1, 1)


@pytest.mark.parametrize(
    "start,end,chunks",
    [
        ("2021-01-01", "2021-01-01", [("2021-01-01", "2021-01-01")]),
        ("2021-11-30", "2023-02-01", [("2021-11-30", "2021-12-31"), ("2022-01-01", "2022-12-31"), ("2023-01-01", "2023-02-01")]),
        ("2023-02-01", "2021-01-01", []),
    ],
)
def test_year_chunks(spark, start, end, chunks):
    d = dt.date.fromisoformat
    df = spark.createDataFrame([("a", d(start), d(end))], "city string, start date, end date")
    got = rows(landing.year_chunks(df), "chunk_start")
    assert got == [("a", d(a), d(b)) for a, b in chunks]


RAW = "city string, time timestamp_ntz, v double, loaded_at timestamp_ntz"
T0, L0 = dt.datetime(2024, 12, 31, 23), dt.datetime(2025, 1, 1)


def test_merge_replaces_and_never_duplicates(spark):
    old = spark.createDataFrame([("a", T0, 1.0, L0), ("b", T0, 2.0, L0)], RAW)
    new = spark.createDataFrame(
        [("x", "a", T0, L0), (None, "c", T0, L0)], "extra string, city string, time timestamp_ntz, loaded_at timestamp_ntz"
    )
    got = rows(tables.merged(old, new, ["city", "time"]).select("city", "v", "extra"), "city")
    assert got == [("a", None, "x"), ("b", 2.0, None), ("c", None, None)]


def test_many_copies_of_one_key_are_reduced_before_the_shuffle(spark):
    copies = spark.range(2000).select(
        F.lit("a").alias("city"), F.lit(T0).cast("timestamp_ntz").alias("time"), F.col("id").cast("double").alias("v"),
        F.timestamp_add("SECOND", F.col("id"), F.lit(L0).cast("timestamp_ntz")).alias("loaded_at"),
    )
    newest = tables.latest_per_key(copies, ["city", "time"], ["loaded_at"])
    assert "partial_max" in newest._jdf.queryExecution().executedPlan().toString()
    assert [r.v for r in newest.collect()] == [1999.0]


@pytest.mark.parametrize("by", ["month", "day"])
def test_upsert_touches_only_its_periods(spark, tmp_path, by):
    path, shared = str(tmp_path / "raw"), spark.conf.get("spark.checkpoint.dir")
    times = [dt.datetime(2024, m, 1) for m in (5, 6, 7)]
    left = set(os.listdir(shared))
    tables.upsert(spark, path, spark.createDataFrame([("a", t, 1.0, L0) for t in times], RAW), by=by)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "raw").glob("data/*/period=*/*.parquet")}
    later = L0 + dt.timedelta(days=1)
    tables.upsert(spark, path, spark.createDataFrame([("a", times[1], 2.0, later), ("b", times[1], 3.0, later)], RAW), by=by, keep=1)
    got = rows(tables.read_upserted(spark, path).select("city", "time", "v"), "time", "city")
    assert got == [("a", times[0], 1.0), ("a", times[1], 2.0), ("b", times[1], 3.0), ("a", times[2], 1.0)]
    day = "01" if by == "day" else ""
    assert sorted(p.parent.name for p in before if p.exists()) == [f"period=202405{day}", f"period=202407{day}"]
    assert all(p.stat().st_mtime_ns == t for p, t in before.items() if p.exists())
    assert len(list((tmp_path / "raw").glob("data/*/period=*/*.parquet"))) == 3
    in_june = tables.read_upserted(spark, path, start=dt.date(2024, 6, 1), end=dt.date(2024, 6, 30))
    assert rows(in_june.select("city", "v"), "city") == [("a", 2.0), ("b", 3.0)]
    assert len(in_june.inputFiles()) == 1
    assert set(os.listdir(shared)) == left


def test_upsert_keeps_every_column_of_every_load(spark, tmp_path):
    path = str(tmp_path / "raw")
    tables.upsert(spark, path, spark.createDataFrame([("a", T0, 1.0, L0), ("b", None, 2.0, L0)], RAW))
    more = spark.createDataFrame([("a", T0, 5.0, L0, True)], RAW + ", checked boolean")
    tables.upsert(spark, path, more)
    other = T0 + dt.timedelta(days=90)
    tables.upsert(spark, path, spark.createDataFrame([("c", other, 3.0, L0), ("b", None, 4.0, L0)], RAW))
    got = tables.read_upserted(spark, path)
    assert got.columns == ["city", "time", "v", "loaded_at", "checked"]
    assert rows(got.select("city", "v", "checked"), "city") == [("a", 5.0, True), ("b", 4.0, None), ("c", 3.0, None)]


def test_upsert_widens_types(spark, tmp_path):
    """Narrower files stay as they are; what no type holds is refused and changes nothing."""
    path = str(tmp_path / "raw")
    months = [dt.datetime(2024, m, 1) for m in (1, 2, 3, 4)]

    def load(kind, value, times):
        schema = f"city string, time timestamp_ntz, v {kind}, loaded_at timestamp_ntz"
        tables.upsert(spark, path, spark.createDataFrame([("a", t, value, L0) for t in times], schema))
        return tables.read_upserted(spark, path)

    load("int", 7, months)
    got = load("bigint", 1 << 40, months[1:3])
    assert dict(got.dtypes)["v"] == "bigint"
    assert [r.v for r in got.orderBy("time").collect()] == [7, 1 << 40, 1 << 40, 7]
    got = load("double", 0.5, months[2:3])
    assert [r.v for r in got.orderBy("time").collect()] == [7.0, float(1 << 40), 0.5, 7.0]
    assert [r.v for r in load("tinyint", 1, months[:1]).orderBy("time").collect()] == [1.0, float(1 << 40), 0.5, 7.0]
    with pytest.raises(ValueError, match="column v was double and is string"):
        load("string", "x", months[:1])
    assert [r.v for r in tables.read_upserted(spark, path).orderBy("time").collect()] == [1.0, float(1 << 40), 0.5, 7.0]


def test_upsert_refuses_keys_without_time(spark, tmp_path):
    batch = spark.createDataFrame([("a", T0, 1.0, L0)], RAW)
    with pytest.raises(ValueError, match="lack the time"):
        tables.upsert(spark, str(tmp_path / "raw"), batch, keys=("city",))


def test_readers_see_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "raw")
    times = [dt.datetime(2024, m, 1) for m in (5, 6, 7)]

    def batch(v):
        return spark.createDataFrame([("a", t, v, L0) for t in times], RAW)

    tables.upsert(spark, path, batch(1.0))
    opened = tables.read_upserted(spark, path)
    seen = []
    commit = versions.commit

    def watched(spark_, path_, new):
        # All files of the new version are there, but it is not the table yet.
        seen.append([r.v for r in tables.read_upserted(spark, path).collect()])
        commit(spark_, path_, new)

    monkeypatch.setattr(versions, "commit", watched)
    tables.upsert(spark, path, batch(2.0))
    monkeypatch.undo()
    assert seen == [[1.0] * 3]
    assert [r.v for r in opened.collect()] == [1.0] * 3
    assert [r.v for r in tables.read_upserted(spark, path).collect()] == [2.0] * 3
    assert [r.v for r in tables.read_upserted(spark, path, number=1).collect()] == [1.0] * 3
    tables.upsert(spark, path, batch(3.0))
    assert versions.numbers(spark, path) == [2, 3]
    assert len(list((tmp_path / "raw").glob("data/*"))) == 2


def test_a_failed_or_overtaken_load_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "raw")
    tables.upsert(spark, path, spark.createDataFrame([("a", T0, 1.0, L0)], RAW))
    commit = versions.commit

    def overtaken(spark_, path_, new):
        commit(spark_, path_, versions.version(spark_, path_).__class__(new.number, new.columns, versions.version(spark_, path_).periods))
        commit(spark_, path_, new)

    monkeypatch.setattr(versions, "commit", overtaken)
    with pytest.raises(versions.VersionTaken):
        tables.upsert(spark, path, spark.createDataFrame([("a", T0, 2.0, L0)], RAW))
    monkeypatch.undo()
    assert rows(tables.read_upserted(spark, path).select("v")) == [(1.0,)]
    assert len(list((tmp_path / "raw").glob("data/*"))) == 1
    assert not list((tmp_path / "raw/versions").glob(".0*-*"))


def test_snapshot_and_views(spark, tmp_path):
    days = spark.createDataFrame([("a", 1)], "city string, n int")
    tables.export_snapshot({"daily": days}, str(tmp_path))
    read = tables.read_snapshot(spark, str(tmp_path), ["daily"])
    assert rows(read["daily"]) == [("a", 1)] and "daily" in tables.list_tables(spark)
    assert list(tmp_path.glob("daily/*.zstd.parquet"))


def test_log_is_appended(spark, tmp_path):
    log = spark.createDataFrame([("a",)], "city string")
    tables.append(log, str(tmp_path / "log"))
    tables.append(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_latest_forecast(spark):
    def snap(city, fetched, first, n):
        f, t = dt.datetime.fromisoformat(fetched), dt.datetime.fromisoformat(first)
        return [(city, f, t + dt.timedelta(hours=i), None if i == 1 else 1.0) for i in range(n)]

    df = spark.createDataFrame(
        snap("a", "2026-05-01T10:20", "2026-04-28T23:00", 200) + snap("a", "2026-04-30T10:00", "2026-04-30T00:00", 5),
        "city string, fetched_at timestamp_ntz, time timestamp_ntz, v double",
    )
    got = tables.latest_forecast(df, ["v"]).agg(F.min("time"), F.max("time"), F.count("*"), F.max("current_time")).first()
    assert tuple(got) == (
        dt.datetime(2026, 4, 29, 1), dt.datetime(2026, 5, 4, 23), 143, dt.datetime(2026, 5, 1, 10)
    )
    older = tables.latest_forecast(df, ["v"], as_of=dt.datetime(2026, 4, 30, 12))
    assert older.count() == 4


def test_a_stored_mart_is_pruned_by_year(spark, tmp_path):
    from stationlake.plans.hours import hour_window

    path = str(tmp_path / "hourly")
    listed = [("a", t, t.date(), 1.0) for y in (2022, 2023, 2024) for t in hours(f"{y}-12-31T20:00", 8)]
    df = spark.createDataFrame(listed, "city string, time_local timestamp_ntz, date_local date, v double")
    tables.store_mart(df, path, "time_local")
    window = hour_window(
        spark.read.parquet(path), dt.date(2023, 12, 31), dt.date(2024, 1, 1), columns=["v"]
    )
    assert window.count() == 4
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_typical_window_reads_only_its_months(spark, tmp_path):
    from stationlake.plans.hours import typical_window

    path = str(tmp_path / "hourly")
    listed = [("a", t, t.date(), 1.0) for y in (2021, 2022) for m in (3, 5, 9) for t in hours(f"{y}-{m:02d}-10T00:00", 30)]
    df = spark.createDataFrame(listed, "city string, time_local timestamp_ntz, date_local date, v double")
    tables.store_mart(df, path, "time_local")
    days = spark.createDataFrame([(dt.date(2021, 1, 1),), (dt.date(2022, 12, 31),)], "date_local date")
    window = typical_window(spark.read.parquet(path), days, dt.date(2024, 5, 10), dt.date(2024, 5, 12), columns=["v"])
    assert window.count() == 30
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert any("month" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
