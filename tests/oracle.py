"""Runs a query on Spark and its check SQL on DuckDB and compares rows, names and types.

    python -m tests.oracle <sf> [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "array<int>": "INTEGER[]",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted((DATA / sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(rows: list[tuple]) -> list[tuple]:
    return sorted(
        (tuple(list(v) if isinstance(v, (list, tuple)) else v for v in r) for r in rows), key=repr
    )


def compare(spark, con, name: str, function, sql: str, sf: str) -> list[str]:
    """Differences between both results; empty when they are equal."""
    df = function(spark, str(DATA / sf))
    names = sorted(df.columns)
    types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    got = canonical([tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()])
    relation = con.sql(sql)
    problems = []
    if sorted(relation.columns) != names:
        return [f"columns {names} != {sorted(relation.columns)}"]
    expected_types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    for n in names:
        if types[n] != expected_types[n]:
            problems.append(f"type of {n}: {types[n]} != {expected_types[n]}")
    expected = canonical(con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})").fetchall())
    if got != expected:
        problems.append(f"{len(got)} rows != {len(expected)} rows" if len(got) != len(expected) else "values differ")
        for label, a, b in (("only in Spark", got, expected), ("only in SQL", expected, got)):
            other = set(map(repr, b))
            extra = [r for r in a if repr(r) not in other]
            if extra:
                problems.append(f"{label}: {len(extra)} e.g. {extra[:2]}")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from stationlake.session import local_session

    sf, wanted = argv[0], argv[1:]
    spark = local_session()
    con = connect(sf)
    queries, checks = entry.queries(), entry.oracle_sql()
    failed = []
    for name, function in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in checks:
                problems = compare(spark, con, name, function, checks[name], sf)
                rows = con.sql(f"SELECT count(*) FROM ({checks[name]})").fetchall()[0][0]
            else:
                rows, problems = function(spark, str(DATA / sf)).count(), []
        except Exception as error:  # noqa: BLE001
            problems, rows = [f"{type(error).__name__}: {str(error)[:300]}"], -1
        state = "ok  " if not problems else "FAIL"
        print(f"{state} {name} rows={rows} {time.time() - start:.1f}s{'' if name in checks else ' (rows only)'}", flush=True)
        for p in problems:
            print(f"       {p[:700]}", flush=True)
        if problems:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
