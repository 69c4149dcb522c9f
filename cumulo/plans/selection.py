"""Exact quantiles of many columns and groups together, by histograms that are refined where a wanted rank lies.

A pass counts every column's values by bin; bins without a wanted rank are settled, the others are cut into bins again
between their own least and largest value.  Once few values are left there, they are ranked.  Tasks send counts, at most
``BINS`` a column, group and open interval; no value list, no sort of a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.plans.shared import materialize

BINS = 1024
#: Values of an interval that are ranked in one task.
FEW = 4096
MAX_ROUNDS = 90


def _values(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, column, v): a row for each value that is not null."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(c).cast("double").alias("v")) for n, c in enumerate(columns)]))
    return df.select(*by, each.alias("_x")).select(*by, F.col("_x.column").alias("column"), F.col("_x.v").alias("v")).where("v IS NOT NULL")


def select_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], by: list[str] | None = None, bins: int = BINS, few: int = FEW) -> DataFrame:
    """``by`` and, for each name in ``wanted``, the linear-interpolated quantile of a column at a level, as ``percentile`` gives it.

    One row a group that has any value in any of the columns, one row without groups (nulls where there is no value).  Null
    values don't count; values must be finite.  ``df`` is read once a round, and values spread evenly or repeated much need one or two.
    """
    by, columns = by or [], sorted({c for c, _ in wanted.values()})
    names = [f"_g{n}" for n in range(len(by))]  # null-safe, and free of names in the way
    values = _values(df.select(*[F.col(b).alias(g) for b, g in zip(by, names)], *columns), names, columns)
    key = [*names, "column"]
    whole = values.groupBy(*key).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))

    def ranks(column: int) -> Column:
        levels = sorted({q for c, q in wanted.values() if c == columns[column]})
        at = [F.lit(float(q)) * (F.col("n") - 1) for q in levels]
        return F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))

    every = reduce(lambda out, n: F.when(F.col("column") == n, ranks(n)).otherwise(out), range(len(columns)), F.lit(None).cast("array<bigint>"))
    state = materialize(whole.withColumn("ranks", every).withColumn("total", F.col("n")).withColumn("before", F.lit(0).cast("long")), "intervals")
    totals, done = state.select(*key, "total"), []

    def met(state: DataFrame) -> DataFrame:
        same = [values[k].eqNullSafe(state[k]) for k in key]
        inside = reduce(lambda a, b: a & b, [*same, values["v"].between(state["lo"], state["hi"])])
        return values.join(state, inside).select(*[state[c] for c in state.columns], "v")

    for _ in range(MAX_ROUNDS):
        done.append(state.where("lo = hi").select(*key, F.col("lo").alias("v"), F.explode("ranks").alias("rank")))
        short = met(state.where(f"lo < hi AND n <= {few}"))
        place = F.col("before") + F.row_number().over(Window.partitionBy(*key, "lo").orderBy("v")) - 1
        done.append(short.withColumn("rank", place).where(F.array_contains("ranks", F.col("rank"))).select(*key, "v", "rank"))
        left = state.where(f"lo < hi AND n > {few}")
        if left.isEmpty():
            break
        number = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
        cut = met(left).groupBy(*key, F.col("lo").alias("from"), number.alias("bin"), "before", "ranks").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        sooner = F.coalesce(F.sum("n").over(Window.partitionBy(*key, "from").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = cut.withColumn("before", F.col("before") + sooner)
        state = materialize(cut.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).where("size(ranks) > 0").select(*key, "n", "lo", "hi", "ranks", "before"), "intervals")
    else:
        raise RuntimeError("intervals don't shrink")
    found = materialize(reduce(DataFrame.union, done), "found")
    placed = found.join(totals, reduce(lambda a, b: a & b, [found[k].eqNullSafe(totals[k]) for k in key])).select(*[found[c] for c in found.columns], "total")

    def value(column: str, q: float) -> Column:
        own = F.col("column") == columns.index(column)
        at = F.lit(float(q)) * (F.col("total") - 1)
        low, high = F.max(F.when(own & (F.col("rank") == F.floor(at)), F.col("v"))), F.max(F.when(own & (F.col("rank") == F.ceil(at)), F.col("v")))
        place = F.max(F.when(own, at))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    out = placed.groupBy(*names).agg(*[value(c, q).alias(name) for name, (c, q) in wanted.items()])
    return out.select(*[F.col(g).alias(b) for b, g in zip(by, names)], *wanted)
