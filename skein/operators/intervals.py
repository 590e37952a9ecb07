"""Interval containment, carry-forward, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(lo: Column, hi: Column, width: int) -> Column:
    return F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long"))


def dealt(df: DataFrame) -> DataFrame:
    """A side with rows of every unit: joined by shuffle. Sizes guessed from files do not see what exploding or lists multiply, and would send it through the driver."""
    return df.hint("merge")


def contain_join(left: DataFrame, right: DataFrame, keys: list[str], point: tuple[str, str], span: tuple[str, str], how: str = "left", width: int | None = None) -> DataFrame:
    """Rows of ``left`` whose [lo, hi] lies in a right [start, end], by equal ``keys``.

    Without ``width`` the equi-keys alone deal the rows out. Where a key's rows are many, ``width`` files each
    right interval under every bin it touches and each left one under the bin of its start, so the join stays an
    equi-join of bounded groups instead of a loop over the key's rows.
    """
    lo, hi = point
    start, end = span
    on = list(keys)
    if width is not None:
        left = left.withColumn("_bin", F.floor(F.col(lo) / width).cast("long"))
        right = right.withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), width)))
        on.append("_bin")
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_r_{k}") for k in on] + [F.col(start) <= F.col(lo), F.col(hi) <= F.col(end)])
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in on], "_bin")


def exactly_one(matches: DataFrame, row: list[str], value: str, found: str) -> DataFrame:
    """One row for each ``row`` key: ``value`` where exactly one match was ``found`` (a non-null column), else null."""
    n = F.count(found)
    return matches.groupBy(*row).agg(n.alias("n_hits"), F.when(n == 1, F.max(value)).alias(value))


def innermost(matches: DataFrame, row: list[str], value: str, length: Column, order: Column) -> DataFrame:
    """For each ``row`` the value of its shortest match, the first by ``order`` among equals."""
    return matches.groupBy(*row).agg(F.min_by(value, F.struct(length, order)).alias(value))


def carry(value: Column, by: list[str], order: list[Column], current: bool = True) -> Column:
    """The last non-null value up to this row (or, without ``current``, before it)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    return F.last(value, ignorenulls=True).over(w)


def islands(df: DataFrame, key: Column, by: list[str], order: list[Column], name: str = "island") -> DataFrame:
    """Numbers stretches of consecutive rows with equal ``key`` from 1 within ``by``."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("_key", key)
    change = F.when(F.lag("_key").over(w).eqNullSafe(F.col("_key")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    df = df.withColumn("_change", change)
    return df.withColumn(name, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_key", "_change")


def runs(df: DataFrame, by: list[str], key: str, island: str, lo: str, hi: str, order: str) -> DataFrame:
    """Run-length encodes islands: first ``lo`` and last ``hi`` of each."""
    return df.groupBy(*by, island).agg(F.first(key).alias(key), F.min_by(lo, order).alias("run_start"), F.max_by(hi, order).alias("run_end"), F.count(F.lit(1)).alias("n"))


def partition_problems(scenes: DataFrame, unit: list[str], start: str, end: str, total: DataFrame) -> DataFrame:
    """(unit, problem, at): reversed ranges, gaps and overlaps against the running end, wrong coverage."""
    w = Window.partitionBy(*unit).orderBy(start, end)
    seen = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(1))
    s = scenes.withColumn("_expected", F.greatest(seen, F.lit(1)))
    each = s.select(
        *unit,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col(end) < F.col(start), F.struct(F.lit("reversed").alias("problem"), F.col(start).cast("long").alias("at"))),
                    F.when(F.col(start) > F.col("_expected"), F.struct(F.lit("gap").alias("problem"), F.col("_expected").cast("long").alias("at"))),
                    F.when(F.col(start) < F.col("_expected"), F.struct(F.lit("overlap").alias("problem"), F.col(start).cast("long").alias("at"))),
                )
            )
        ).alias("p"),
    ).select(*unit, "p.problem", "p.at")
    covered = scenes.groupBy(*unit).agg(F.max(end).alias("_covered"))
    wrong = covered.join(total, unit).where("_covered <> total").select(*unit, F.lit("coverage").alias("problem"), F.col("_covered").cast("long").alias("at"))
    return each.unionByName(wrong)
