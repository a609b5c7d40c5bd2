"""Arrow batches in and out of the operators, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stationlake.session import work_path


def others(df: DataFrame, added: Sequence[str]) -> list[str]:
    """Columns of ``df`` that no added column replaces; names count without case."""
    taken = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in taken]


def extended(
    df: DataFrame, schema: str, function: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], keep: Sequence[str] | None = None
) -> DataFrame:
    """The rows of ``df`` with new columns, computed batch by batch.

    ``function`` gets the batches and gives one list of new columns for each, in
    the order of ``schema``. A new column replaces one of the same name.
    ``keep`` lists the columns to return besides, by default all others.
    """
    new = T._parse_datatype_string(schema)
    kept = others(df, new.names) if keep is None else others(df.select(*keep), new.names)
    arrow = to_arrow_schema(new)
    whole = T.StructType([df.schema[c] for c in kept] + new.fields)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def source():
            for batch in batches:
                held.append(batch)
                yield batch

        for columns in function(source()):
            batch = held.pop(0)
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept] + arrays, names=whole.names
            )

    return df.mapInArrow(run, whole)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from files."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
