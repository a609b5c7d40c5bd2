"""Tables whose readers see one whole version: files are added, then one small file makes them the table.

``<path>/data/<load>/period=<p>/`` holds the rows one load wrote for a period
and is never changed. ``<path>/versions/<n>.json`` names the folder of every
period and the columns it was written with. A version is complete once its file
has its name: the file is renamed into place, which fails if another load took
the number first. So a load that fails or loses leaves the table as it was, and
a reader keeps the version it opened until that is expired.

The list of periods is bounded by the calendar, not by the rows.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionTaken(RuntimeError):
    """Another load wrote the next version first: read the table again and repeat."""


@dataclass(frozen=True)
class Version:
    """What a table consists of: its columns, and for each period the load and the columns written."""

    number: int
    columns: T.StructType
    periods: Mapping[str, tuple[str, T.StructType]] = field(default_factory=dict)

    def loads(self) -> set[str]:
        return {load for load, _ in self.periods.values()}

    def to_json(self) -> str:
        written = sorted({s.json() for _, s in self.periods.values()})
        periods = {p: [load, written.index(s.json())] for p, (load, s) in self.periods.items()}
        return json.dumps({"number": self.number, "columns": self.columns.json(), "written": written, "periods": periods})

    @staticmethod
    def from_json(text: str) -> Version:
        found = json.loads(text)
        written = [T.StructType.fromJson(json.loads(s)) for s in found["written"]]
        columns = T.StructType.fromJson(json.loads(found["columns"]))
        return Version(found["number"], columns, {p: (load, written[i]) for p, (load, i) in found["periods"].items()})


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that can be read, in order."""
    files, folder = _files(spark, f"{path}/versions")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The newest version, or the one of a number; None where there is no table yet."""
    if number is None:
        known = numbers(spark, path)
        if not known:
            return None
        number = known[-1]
    files, place = _files(spark, f"{path}/versions/{number:012d}.json")
    stream = files.open(place)
    try:
        return Version.from_json(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, new: Version) -> None:
    """Make ``new`` the newest version, unless another has its number."""
    target = f"{path}/versions/{new.number:012d}.json"
    files, draft = _files(spark, f"{path}/versions/.{new.number:012d}-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(new.to_json(), "utf-8"))
    out.close()
    place = _files(spark, target)[1]
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        # Without options a rename never replaces a file.
        context.rename(files.makeQualified(draft), files.makeQualified(place), spark.sparkContext._gateway.new_array(rename, 0))
    except Exception as error:
        files.delete(draft, False)
        if files.exists(place):
            raise VersionTaken(f"version {new.number} of {path} was written meanwhile") from error
        raise


def read(spark: SparkSession, path: str, at: Version, periods: set[str] | None = None) -> DataFrame:
    """The rows of a version (of some periods) with all its columns.

    Folders written with the same columns are one scan; those written with
    others are cast, so files of an older, narrower type stay as they are.
    """
    scans: dict[str, list[str]] = defaultdict(list)
    for period, (load, written) in sorted(at.periods.items()):
        if periods is None or period in periods:
            scans[written.json()].append(f"{path}/data/{load}/period={period}")
    parts = []
    for written, folders in sorted(scans.items()):
        rows = spark.read.schema(T.StructType.fromJson(json.loads(written))).parquet(*folders)
        has = {c.lower(): c for c in rows.columns}
        parts.append(
            rows.select(
                *[
                    (F.col(f"`{has[c.name.lower()]}`") if c.name.lower() in has else F.lit(None)).cast(c.dataType).alias(c.name)
                    for c in at.columns
                ]
            )
        )
    whole = spark.createDataFrame([], at.columns)
    for part in parts:
        whole = whole.unionByName(part) if part is not parts[0] else part
    return whole


def replace(
    spark: SparkSession, path: str, before: Version | None, rows: DataFrame, columns: T.StructType, period: str, gone: Collection[str] = ()
) -> Version:
    """The version after ``before`` in which ``rows`` take the place of all rows of their periods.

    ``period`` names the column that holds them. ``gone`` are periods that the
    new version lacks, and that are written again only if rows have them. Fails
    with ``VersionTaken``, and leaves no files, if another version came first.
    """
    load = uuid.uuid4().hex
    folder = f"{path}/data/{load}"
    try:
        (
            rows.select(*[F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) for c in columns], F.col(period).alias("period"))
            .hint("rebalance", F.col("period"))
            .write.option("compression", "zstd")
            .partitionBy("period")
            .parquet(folder)
        )
        files, place = _files(spark, folder)
        found = {s.getPath().getName().removeprefix("period=") for s in files.listStatus(place) if s.isDirectory()}
        kept = {p: v for p, v in (before.periods if before else {}).items() if p not in gone}
        new = Version(before.number + 1 if before else 1, columns, kept | dict.fromkeys(found, (load, columns)))
        commit(spark, path, new)
    except Exception:
        files, place = _files(spark, folder)
        files.delete(place, True)
        raise
    return new


def widened(spark: SparkSession, old: T.StructType, new: T.StructType) -> T.StructType:
    """Columns of both, each of the narrowest type that holds its values in both, as a union has them.

    Text is never read as another type or the other way round.
    """
    before = {c.name.lower(): c.dataType for c in old}
    for column in new:
        known = before.get(column.name.lower(), column.dataType)
        kinds = [isinstance(t, T.StringType) for t in (known, column.dataType) if not isinstance(t, T.NullType)]
        if len(set(kinds)) > 1:
            raise ValueError(f"column {column.name} was {known.simpleString()} and is {column.dataType.simpleString()} now")
    both = spark.createDataFrame([], old).unionByName(spark.createDataFrame([], new), allowMissingColumns=True)
    return T.StructType([T.StructField(c.name, c.dataType, True) for c in both.schema])


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Forget all but the newest ``keep`` versions, and the files that only they have."""
    known = numbers(spark, path)
    if keep < 1 or len(known) <= keep:
        return
    old, stay = ([version(spark, path, n) for n in part] for part in (known[:-keep], known[-keep:]))
    for gone in old:
        files, place = _files(spark, f"{path}/versions/{gone.number:012d}.json")
        files.delete(place, False)
    places = lambda found: {f"{load}/period={p}" for v in found for p, (load, _) in v.periods.items()}
    loads = lambda found: set().union(*(v.loads() for v in found))
    for folder in [*(places(old) - places(stay)), *(loads(old) - loads(stay))]:
        files, place = _files(spark, f"{path}/data/{folder}")
        files.delete(place, True)
