"""The rows just before and after each row of an ordered series.

Look-back and look-ahead operators need the order of a whole series (a site's
history). A window over the series alone puts all of it into one task, which
fails for a site that holds a large part of the data. Here a series is cut into
time buckets: each bucket is ordered on its own, and a bucket receives the few
missing rows at its edges from a summary that holds only edge rows. The result
is the same as that of the plain window, for any spacing of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET, _FIRST, _LAST = "__bucket", "__first", "__last"
_HEAD, _TAIL = "__head", "__tail"


def month_of(time: str) -> Column:
    """Default bucket: at most 744 hours."""
    return F.date_trunc("month", F.col(time))


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    before: int = 0,
    after: int = 0,
    bucket: Column | None = None,
    short: bool = False,
) -> DataFrame:
    """Add ``prev`` and ``next``: arrays of the neighbouring rows' ``values``, in row order.

    ``prev`` holds up to ``before`` rows and ``next`` up to ``after`` rows; they
    are shorter only at the ends of the series. ``keys`` and ``order`` are the
    table's primary key: unique, never null. Rows without them are in no series
    and left out, whatever the form; ``quality.not_null`` reports them. ``bucket`` must not decrease along
    the order. ``short`` says that a series is small by construction (a site's
    year of days); it is then ordered in one piece.

    One shuffle of the rows by (keys, bucket). The window over ``keys`` alone
    sees one row per bucket, a number bounded by the time span. The join back
    finds the rows partitioned by its own keys already.
    """
    keys = list(keys)
    row = F.struct(*[F.col(v) for v in values])

    def neighbours(window) -> list[Column]:
        none = F.array().cast(_array_of(df, values))
        prev = F.collect_list(row).over(window.rowsBetween(-before, -1)) if before else none
        next_ = F.collect_list(row).over(window.rowsBetween(1, after)) if after else none
        return [prev.alias("prev"), next_.alias("next")]

    if short:
        known = df.filter(reduce(and_, [F.col(c).isNotNull() for c in (*keys, order)]))
        return known.select("*", *neighbours(Window.partitionBy(*keys).orderBy(order)))

    in_bucket = Window.partitionBy(*keys, _BUCKET).orderBy(order)
    placed = _in_buckets(df, keys, order, bucket)
    rows = placed.select(
        "*",
        *neighbours(in_bucket),
        (F.row_number().over(in_bucket) == 1).alias(_FIRST),
        F.lead(F.lit(False), 1, True).over(in_bucket).alias(_LAST),
    )

    # Edge rows: the last `before` rows up to the bucket's last row and the
    # first `after` rows from its first row.
    edges = (
        rows.filter(F.col(_FIRST) | F.col(_LAST))
        .groupBy(*keys, _BUCKET)
        .agg(
            F.first(
                F.when(F.col(_LAST), _last(F.concat("prev", F.array(row)), before)), True
            ).alias(_TAIL),
            F.first(
                F.when(F.col(_FIRST), _first(F.concat(F.array(row), "next"), after)), True
            ).alias(_HEAD),
        )
    )
    over_buckets = Window.partitionBy(*keys).orderBy(_BUCKET)
    if before:
        earlier = F.collect_list(_TAIL).over(over_buckets.rowsBetween(-before, -1))
        edges = edges.withColumn("__carry_tail", _last(F.flatten(earlier), before))
    if after:
        later = F.collect_list(_HEAD).over(over_buckets.rowsBetween(1, after))
        edges = edges.withColumn("__carry_head", _first(F.flatten(later), after))
    carried = edges.drop(_TAIL, _HEAD)

    joined = rows.join(carried, [*keys, _BUCKET])
    if before:
        missing = (F.size("prev") < before) & F.col("__carry_tail").isNotNull()
        filled = _last(F.concat("__carry_tail", "prev"), before)
        joined = joined.withColumn("prev", F.when(missing, filled).otherwise(F.col("prev")))
    if after:
        missing = (F.size("next") < after) & F.col("__carry_head").isNotNull()
        filled = _first(F.concat("next", "__carry_head"), after)
        joined = joined.withColumn("next", F.when(missing, filled).otherwise(F.col("next")))
    return joined.select(*df.columns, "prev", "next")


def neighbours_where(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    chosen: Callable[[Column, Column], Column],
    before: int = 1,
    after: int = 0,
    bucket: Column | None = None,
) -> DataFrame:
    """Rows that ``chosen`` picks, with ``prev`` and ``next`` as in ``with_neighbours``.

    ``chosen(row, earlier)`` gets a row's values and those of the row before
    it (null at the start of a series) and says whether the row is wanted; null
    counts as no. A bucket becomes one sorted list, so buckets must be small (a
    site's year of days). Only wanted rows become rows again and get their
    neighbours cut out of that list. Lists and edges come from the same shuffle;
    the window over ``keys`` sees one row of edges per bucket.

    The result has the keys, ``order``, the values, ``prev`` and ``next``.
    """
    if before < 1:
        raise ValueError("the row before is needed to choose rows")
    keys = list(keys)
    row = F.struct(F.col(order).alias("at"), F.struct(*[F.col(v) for v in values]).alias("row"))
    lists = (
        _in_buckets(df, keys, order, bucket)
        .groupBy(*keys, _BUCKET)
        .agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    )
    over_buckets = Window.partitionBy(*keys).orderBy(_BUCKET)
    earlier = F.collect_list(_TAIL).over(over_buckets.rowsBetween(-before, -1))
    later = F.collect_list(_HEAD).over(over_buckets.rowsBetween(1, max(after, 1)))
    carried = lists.select(
        *keys, _BUCKET, _last(F.col("__rows"), before).alias(_TAIL), _first(F.col("__rows"), after).alias(_HEAD)
    ).select(
        *keys,
        _BUCKET,
        _last(F.flatten(earlier), before).alias("__carry_tail"),
        _first(F.flatten(later), after).alias("__carry_head"),
    )
    around = lists.join(carried, [*keys, _BUCKET]).select(
        *keys,
        F.concat("__carry_tail", "__rows", "__carry_head").alias("__all"),
        F.size("__carry_tail").alias("__from"),
        F.size("__rows").alias("__n"),
    )

    # Positions from 0; the places of wanted rows are found first, and only these are cut out.
    def wanted(i: Column) -> Column:
        previous = F.when(i > 0, F.get("__all", i - 1)["row"])
        return F.coalesce(chosen(F.get("__all", i)["row"], previous), F.lit(False))

    places = F.filter(F.sequence(F.col("__from"), F.col("__from") + F.col("__n") - 1), wanted)
    at = F.col("__place")
    start = F.greatest(at - before, F.lit(0))
    found = around.select("*", F.explode(places).alias("__place")).select(
        *keys,
        F.get("__all", at).alias("__row"),
        F.slice("__all", start + 1, at - start)["row"].alias("prev"),
        F.slice("__all", at + 2, after)["row"].alias("next"),
    )
    plain = [F.col("__row")["row"][v].alias(v) for v in values if v not in (*keys, order)]
    return found.select(*keys, F.col("__row")["at"].alias(order), *plain, "prev", "next")


def rolling_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    rows: int = 8,
    result: str = "rolling",
    bucket: Column | None = None,
) -> DataFrame:
    """Mean over the current and the ``rows - 1`` preceding rows of a series.

    Counts rows, not hours: a gap shortens nothing. Nulls are skipped; at the
    start of the series the mean covers the rows there are.

    Pass a narrow table: all its columns travel with the neighbours, so that
    the rows and their edge summary read the same columns and share one scan
    and one shuffle.
    """
    keys, back = list(keys), rows - 1
    whole = Window.partitionBy(*keys, _BUCKET)
    window = whole.orderBy(order).rowsBetween(-back, 0)
    numbered = _in_buckets(df, keys, order, bucket).select(
        "*",
        F.row_number().over(whole.orderBy(order)).alias("__row"),
        F.count(F.lit(1)).over(whole).alias("__rows"),
        F.sum(value).over(window).alias("__sum"),
        F.count(value).over(window).alias("__n"),
    )
    # Only the first rows of a bucket miss something: the last rows before the bucket.
    travelling = F.struct("__row", *[c for c in df.columns if c not in keys])
    tails = (
        numbered.filter(F.col("__rows") - F.col("__row") < back)
        .groupBy(*keys, _BUCKET)
        .agg(F.sort_array(F.collect_list(travelling)).alias(_TAIL))
    )
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(-back, -1)
    carried = tails.select(
        *keys, _BUCKET, _last(F.flatten(F.collect_list(_TAIL).over(earlier)), back).alias("__carry")
    )
    missing = F.lit(rows) - F.col("__row")
    extra = F.filter(
        F.transform(_last(F.col("__carry"), missing), lambda r: r[value]), lambda v: v.isNotNull()
    )
    first_rows = F.col("__row") < rows
    extra_sum = F.aggregate(extra, F.lit(0.0), lambda acc, v: acc + v)
    total = F.when(first_rows, F.coalesce("__sum", F.lit(0.0)) + extra_sum).otherwise(F.col("__sum"))
    n = F.when(first_rows, F.col("__n") + F.size(extra)).otherwise(F.col("__n"))
    joined = numbered.join(carried, [*keys, _BUCKET])
    return joined.select(*df.columns, F.try_divide(total, n).alias(result))


def rolling_mean_hours(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    hours: int = 8,
    result: str = "rolling",
    bucket: Column | None = None,
) -> DataFrame:
    """Mean over the last ``hours`` hours of clock time, so that gaps are not bridged.

    Hour rows within the window number at most ``hours``, so the row form
    supplies all candidates and the clock decides which of them count.
    """
    n = with_neighbours(df, keys, time, [time, value], before=hours - 1, bucket=bucket)
    lower = F.timestamp_add("HOUR", F.lit(-(hours - 1)), F.col(time))
    near = F.filter("prev", lambda r: r[time] >= lower)
    window = F.concat(F.transform(near, lambda r: r[value]), F.array(F.col(value)))
    present = F.filter(window, lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
    return n.withColumn(result, F.try_divide(total, F.size(present))).drop("prev", "next")


def _in_buckets(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column | None
) -> DataFrame:
    """Rows with their bucket.

    A series is read twice, for its rows and for its edges. The join of both
    would push null checks into one of them and so keep them from sharing a
    shuffle; stated here, the checks are part of both.
    """
    bucketed = df.withColumn(_BUCKET, month_of(order) if bucket is None else bucket)
    return bucketed.filter(reduce(and_, [F.col(c).isNotNull() for c in (*keys, order, _BUCKET)]))


def _first(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)


def _last(array: Column, n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


def _array_of(df: DataFrame, values: Sequence[str]) -> str:
    fields = ", ".join(f"`{v}`: {df.schema[v].dataType.simpleString()}" for v in values)
    return f"array<struct<{fields}>>"
