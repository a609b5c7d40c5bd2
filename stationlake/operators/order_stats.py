"""Exact ranks, quantiles and rank correlations for groups of any size.

Spark's ``percentile`` keeps a whole group in one task. These forms first
reduce the rows to distinct values with counts, then number the values in three
levels, by parts of the number's own binary form: sign, exponent and 10 bits,
then 21 bits, then the last 21. So no window sees more than some two million
rows, however the values are distributed. Use the built-in ``median`` where a
group is small by construction (years of a site).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.operators.reshape import labelled

_MIDDLE = 1 << 21
_HIGHEST = 1 << 40


def with_value_parts(df: DataFrame, high: str = "high", middle: str = "middle", value: str = "value") -> DataFrame:
    """Add two numbers whose order is that of the value as far as they differ.

    The first holds sign, exponent and the 10 leading bits of the mantissa, the
    second the 21 bits after them; values that agree in both differ in the last
    21 bits only. Dividing by a power of two is exact. Never null. Each step is a
    column of its own, so it is computed once and the code of a row stays small.
    """
    v, size, guess, scaled, step = F.col(value), F.col("__size"), F.col("__guess"), F.col("__scaled"), F.col("__step")
    sign, bits = F.col("__sign"), F.col("__bits")
    mantissa = F.when(step == 1, scaled / 2).when(step == -1, scaled * 2).otherwise(scaled)
    infinite = size == F.lit(float("inf"))
    leading = (guess + step + 1100) * 1024 + F.shiftright(bits, 21)
    placed = F.when(F.isnan(v), F.lit(2 * _HIGHEST)).when(infinite, sign * F.lit(_HIGHEST)).otherwise(sign * leading)
    inner = F.when(F.isnan(v) | infinite, F.lit(0)).otherwise(sign * bits.bitwiseAND(F.lit(_MIDDLE - 1)))
    return (
        # The logarithm may be off by one close to a power of two; the largest doubles must not reach 2 to the 1024th.
        df.withColumn("__size", F.abs(v))
        .withColumn("__guess", F.least(F.floor(F.log2(size)), F.lit(1023)))
        .withColumn("__scaled", size / F.pow(F.lit(2.0), guess))
        .withColumns({"__step": F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0), "__sign": F.when(v > 0, 1).when(v < 0, -1)})
        .withColumn("__bits", F.floor((mantissa - 1) * F.lit(float(1 << 31))))
        .withColumns({n: F.coalesce(p.cast("long"), F.lit(0).cast("long")) for n, p in ((high, placed), (middle, inner))})
        .drop("__size", "__guess", "__scaled", "__step", "__sign", "__bits")
    )


def value_counts(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct values per group and column as ``column``, ``value`` and ``n``.

    A null counts 0 times: a group without values keeps a row.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    return (
        df.select(*groups, labelled(values, "column", "value"))
        .groupBy(*groups, "column", "value")
        .agg(F.count("value").alias("n"))
    )


def positions(counts: DataFrame, groups: Sequence[str], numbers: Sequence[str] = ("n",)) -> DataFrame:
    """Add ``before`` (rows with a smaller value) and ``total`` (rows) per group.

    The window over the group alone sees one row for each leading part of its
    values, that over a leading part one row for each middle part. ``numbers``
    are several counts of the same values: all are summed in the same windows,
    into ``before_<name>`` and ``total_<name>``.
    """
    groups = list(groups)
    inner = Window.partitionBy(*groups, "__high", "__middle")
    of_high, of_group = Window.partitionBy(*groups, "__high"), Window.partitionBy(*groups)

    def placed(window: Window, by: str, of: str, before: str, total: str) -> list[Column]:
        """Running sums without the row itself, and whole sums, of every count."""
        found = []
        for c in numbers:
            value = F.col(of.format(c))
            found += [(F.sum(value).over(window.orderBy(by)) - value).alias(before.format(c)), F.sum(value).over(window).alias(total.format(c))]
        return found

    numbered = with_value_parts(counts, "__high", "__middle").select(
        "*", *placed(inner, "value", "{}", "__inside_{}", "__size_{}"), F.row_number().over(inner.orderBy("value")).alias("__row")
    )
    middles = numbered.filter(F.col("__row") == 1).select(
        *groups,
        "__high",
        "__middle",
        *placed(of_high, "__middle", "__size_{}", "__offset_{}", "__high_size_{}"),
        F.row_number().over(of_high.orderBy("__middle")).alias("__row"),
    )
    highs = middles.filter(F.col("__row") == 1).select(
        *groups, "__high", *placed(of_group, "__high", "__high_size_{}", "__base_{}", "__total_{}")
    )
    offsets = _joined(middles.drop("__row", *[f"__high_size_{c}" for c in numbers]), highs, [*groups, "__high"])
    single = len(numbers) == 1
    ends = []
    for c in numbers:
        suffix = "" if single else f"_{c}"
        before = F.col(f"__base_{c}") + F.col(f"__offset_{c}") + F.col(f"__inside_{c}")
        ends += [before.alias(f"before{suffix}"), F.col(f"__total_{c}").alias(f"total{suffix}")]
    return _joined(numbered, offsets, [*groups, "__high", "__middle"]).select(*groups, "value", *numbers, *ends)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a null key meets a null key."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, same).drop(*[f"__r_{k}" for k in keys])


def quantiles(
    df: DataFrame, groups: Sequence[str], probs: Mapping[str, Mapping[str, float]], rescan: bool = False
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group, null where it has no values.

    ``probs`` maps each value column to the quantiles wanted of it, by result
    name. All columns go through the same shuffles. A costly input is computed
    once; ``rescan`` is for rows that come straight from a table, see ``selected``.
    """
    if rescan:
        return selected(df, groups, probs)
    placed = positions(value_counts(df, groups, list(probs)), [*groups, "column"])
    wanted = [(c, name, float(q)) for c, named in probs.items() for name, q in named.items()]
    ends = []
    for column, name, q in wanted:
        at = (F.col("total") - 1) * F.lit(q)
        for end, row in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (
                (F.col("column") == column)
                & (F.col("before") <= row)
                & (row < F.col("before") + F.col("n"))
            )
            ends.append(F.max(F.when(holds, F.col("value"))).alias(f"__{end}_{name}"))
    totals = [
        F.max(F.when(F.col("column") == c, F.col("total"))).alias(f"__total_{i}")
        for i, c in enumerate(probs)
    ]
    found = placed.groupBy(*groups).agg(*totals, *ends)
    index = {c: i for i, c in enumerate(probs)}

    def interpolated(column: str, name: str, q: float) -> Column:
        at = (F.col(f"__total_{index[column]}") - 1) * F.lit(q)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return (lo + (hi - lo) * (at - F.floor(at))).alias(name)

    return found.select(*groups, *[interpolated(*w) for w in wanted])


def selected(df: DataFrame, groups: Sequence[str], probs: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """The same as ``quantiles`` by selection: three scans instead of a shuffle of all values.

    Three rounds narrow the values by the parts of ``with_value_parts``: count the
    rows of every leading part, keep the parts that hold a wanted row, count their
    middle parts, and at last their values. Only these counts are sorted, some two
    million a group at most. The cells kept, two per quantile and group, are
    broadcast if the engine measures them as small; else rows meet them on spread keys.
    """
    groups, keys = list(groups), [*groups, "column"]
    values = {c: F.col(c).cast("double") for c in probs}
    rows = df.select(*groups, labelled(values, "column", "value")).withColumn("n", F.when(F.col("value").isNull(), 0).otherwise(1))
    wanted = F.lit(None).cast("array<double>")
    for c, named in probs.items():
        wanted = F.when(F.col("column") == c, F.array(*[F.lit(float(q)) for q in named.values()])).otherwise(wanted)
    rows, high, middle = with_value_parts(rows), F.col("high"), F.col("middle")
    wanted = F.lit(None).cast("array<double>")
    for c, named in probs.items():
        wanted = F.when(F.col("column") == c, F.array(*[F.lit(float(q)) for q in named.values()])).otherwise(wanted)

    def counted(rows: DataFrame, parts: Mapping[str, Column], carried: Sequence[Column]) -> DataFrame:
        """Rows per combination of parts, numbered by the last within the others."""
        *outer, last = parts
        cells = rows.select(*keys, *[c.alias(p) for p, c in parts.items()], "n", *carried)
        found = cells.groupBy(*keys, *parts).agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in cells.columns if c.startswith("__of_")])
        within = Window.partitionBy(*keys, *outer)
        running = F.sum("n").over(within.orderBy(last)) - F.col("n")
        if not outer:
            return found.select("*", running.alias("before"), F.sum("n").over(within).alias("total"))
        return found.select(*keys, *parts, "n", (F.col("__of_before") + running).alias("before"), F.col("__of_total").alias("total"))

    def holding(cells: DataFrame) -> DataFrame:
        """Cells with the lower or upper row of a wanted quantile."""
        holds = F.exists(wanted, lambda q: _inside(F.floor((F.col("total") - 1) * q)) | _inside(F.ceil((F.col("total") - 1) * q)))
        return cells.filter(holds)

    def narrowed(rows: DataFrame, cells: DataFrame, parts: Mapping[str, Column]) -> DataFrame:
        """Rows in one of the cells, two per wanted quantile and group, with what is known of the cell."""
        named = [F.col("before").alias("__of_before"), F.col("total").alias("__of_total")]
        known = holding(cells).select(*keys, *parts, *named)
        placed = rows.filter(F.col("value").isNotNull()).select(*keys, "value", "n", "high", "middle")
        return attached(placed, known, [*keys, *parts]).filter(F.col("__of_total").isNotNull())

    carried = [F.col("__of_before"), F.col("__of_total")]
    highs = counted(rows, {"high": high}, [])
    middles = counted(narrowed(rows, highs, {"high": high}), {"high": high, "middle": middle}, carried)
    inner = {"high": high, "middle": middle}
    singles = counted(narrowed(rows, middles, inner), {**inner, "value": F.col("value")}, carried)

    ends = []
    for column, named in probs.items():
        for name, q in named.items():
            at = (F.col("total") - 1) * F.lit(float(q))
            lo, hi = (F.max(F.when((F.col("column") == column) & _inside(row), F.col("value"))) for row in (F.floor(at), F.ceil(at)))
            part = F.max(F.when(F.col("column") == column, at - F.floor(at)))
            ends.append((lo + (hi - lo) * part).alias(name))
    names = [name for named in probs.values() for name in named]
    found = singles.groupBy(*groups).agg(*ends)
    if not groups:
        return found
    return _left(highs.select(*groups).distinct(), found, groups).select(*groups, *names)


def _inside(row: Column) -> Column:
    return (F.col("before") <= row) & (row < F.col("before") + F.col("n"))


def attached(rows: DataFrame, per_group: DataFrame, groups: Sequence[str], spread: int = 16) -> DataFrame:
    """``rows`` with the columns of their group's one row in ``per_group``; null groups meet null groups.

    A group with a third of all rows is dealt over ``spread`` keys and its row
    copied that often, so the rows that meet it come from all tasks into many.
    Sums over the groups afterwards are partial before they meet. Where the
    groups' rows are small the engine broadcasts them, by their measured size.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("__spread")
    others = [c for c in rows.columns if c not in groups]
    key = F.pmod(F.xxhash64(*others), F.lit(spread)).cast("int") if others else F.lit(0)
    joined = _left(rows.withColumn("__spread", key), per_group.select("*", copies), [*groups, "__spread"])
    return joined.drop("__spread")


def _left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which a null key meets a null key."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, same, "left").drop(*[f"__r_{k}" for k in keys])


def average_ranks(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Rank of every distinct value from 1; ties share the mean of their ranks."""
    counts = value_counts(df, groups, [value]).drop("column")
    return positions(counts, groups).filter("n > 0").select(*groups, "value", "n", "total", _mean_rank())


def _mean_rank() -> Column:
    return (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank")


def spearman(df: DataFrame, groups: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rank correlation per group and pair of columns, over rows where both have a value.

    A value's rank depends on which rows take part, and so on the other column,
    but only through what is missing there. So every column is counted and ranked
    once, with a count for each partner that has a value, in the same windows.
    Rows become one entry for each column, never for each pair: the entries fetch
    their ranks in one join, meet again as rows, and all products are summed in
    one aggregation. A value with very many rows is a hot key of that join, which
    may be split, as what follows is dealt out anew.
    """
    groups, columns = list(groups), list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: i for i, c in enumerate(columns)}
    values, numbers = [f"__v{i}" for i in range(len(columns))], [f"n{i}" for i in range(len(columns))]
    # Equal rows count together; they are told apart by their values alone.
    rows = (
        df.select(*groups, *[F.col(c).cast("double").alias(v) for c, v in zip(columns, values)])
        .groupBy(*groups, *values)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    of_column = F.array(*[F.struct(F.lit(i).alias("column"), F.col(v).alias("value")) for i, v in enumerate(values)])
    entries = rows.select("*", F.inline(of_column)).filter(F.col("value").isNotNull())
    with_partner = [F.sum(F.when(F.col(v).isNotNull(), F.col("__n")).otherwise(0)).alias(n) for v, n in zip(values, numbers)]
    counts = entries.groupBy(*groups, "column", "value").agg(*with_partner)
    suffixes = [""] if len(numbers) == 1 else [f"_{n}" for n in numbers]
    # Ranks from the middle: their mean is 0 for every partner.
    centred = [F.col(f"before{s}") + (F.col(n) - F.col(f"total{s}")) / F.lit(2.0) for n, s in zip(numbers, suffixes)]
    placed = positions(counts, [*groups, "column"], numbers).select(*groups, "column", "value", F.array(*centred).alias("__ranks"))
    ranked = _joined(entries, placed, [*groups, "column", "value"])
    whole = ranked.groupBy(*groups, *values, "__n").agg(
        *[F.max(F.when(F.col("column") == i, F.col("__ranks"))).alias(f"__r{i}") for i in range(len(columns))]
    )
    sums, found = [], []
    for p, (x, y) in enumerate(pairs):
        i, j = at[x], at[y]
        both = F.col(values[i]).isNotNull() & F.col(values[j]).isNotNull()
        dx, dy, n = F.get(f"__r{i}", F.lit(j)), F.get(f"__r{j}", F.lit(i)), F.col("__n")
        for name, product in (("xy", dx * dy), ("xx", dx * dx), ("yy", dy * dy), ("n", F.lit(1))):
            sums.append(F.sum(F.when(both, n * product)).alias(f"__{name}{p}"))
        rho = F.try_divide(F.col(f"__xy{p}"), F.sqrt(f"__xx{p}") * F.sqrt(f"__yy{p}"))
        found.append(F.struct(F.lit(x).alias("var1"), F.lit(y).alias("var2"), F.col(f"__n{p}").alias("n"), rho.alias("rho")))
    return whole.groupBy(*groups).agg(*sums).select(*groups, F.inline(F.array(*found))).filter("n > 0")
