"""Prefix scans in two passes, for units of any size.

Rows are range-partitioned by unit and order, so a unit that holds a third of all rows lies in many slices and a slice holds many small
units. The first pass gives each slice's own prefixes and one summary row for each unit in it; summaries are carried from slice
to slice (as many rows a unit as it has slices), and the second pass adds what came before to the slice's own prefixes. No
task sees more than a slice. ``order`` must tell the rows of a unit apart; null units are units.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

_SLICE = "_slice"


def sliced(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_slice``: consecutive stretches of the order by unit and place, written so that both passes see the same."""
    if _SLICE in df.columns:
        return df
    keys = [*by, *order]
    return cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_SLICE, F.spark_partition_id()), "slices")


def _within(by: list[str], order: list[str]):
    return Window.partitionBy(_SLICE, *by).orderBy(*order)


def _across(by: list[str]):
    return Window.partitionBy(*by).orderBy(_SLICE)


def _add(rows: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    keys = [_SLICE, *by]
    c = carried.withColumnsRenamed({k: f"_c_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys])
    return rows.join(c, same, "left").drop(*[f"_c_{k}" for k in keys])


def prefix_scan(df: DataFrame, by: list[str], order: list[str], last: dict[str, Column] | None = None, before: dict[str, Column] | None = None, total: dict[str, Column] | None = None, previous: dict[str, Column] | None = None, keep_slices: bool = False) -> DataFrame:
    """Adds columns: ``last`` non-null value up to this row, the one ``before`` it, running ``total`` (nulls count 0), value of the ``previous`` row."""
    last, before, total, previous = last or {}, before or {}, total or {}, previous or {}
    each = last | before | total | previous
    v = {n: f"_v_{n}" for n in each}
    s = sliced(df, by, order).withColumns({v[n]: c for n, c in each.items()})
    w, key = _within(by, order), F.struct(*order)
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    own, sums, carry = {}, [], {}
    back = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    for n, x in v.items():
        c = F.col(x)
        if n in total:
            own[f"_o_{n}"] = F.sum(F.coalesce(c, F.lit(0))).over(upto)
            sums.append(F.sum(c).alias(f"_s_{n}"))
            carry[f"_k_{n}"] = F.coalesce(F.sum(f"_s_{n}").over(back), F.lit(0))
        elif n in previous:
            own[f"_o_{n}"] = F.lag(F.struct(c.alias("x"))).over(w)
            sums.append(F.max_by(F.struct(c.alias("x")), key).alias(f"_s_{n}"))
            carry[f"_k_{n}"] = F.lag(f"_s_{n}").over(_across(by))
        else:
            own[f"_o_{n}"] = F.last(c, ignorenulls=True).over(upto if n in last else prior)
            sums.append(F.max_by(c, F.when(c.isNotNull(), key)).alias(f"_s_{n}"))
            carry[f"_k_{n}"] = F.last(f"_s_{n}", ignorenulls=True).over(back)
    carried = s.groupBy(_SLICE, *by).agg(*sums).withColumns(carry).select(_SLICE, *by, *carry)
    out = _add(s.withColumns(own), carried, by)
    join = {}
    for n in v:
        mine, came = F.col(f"_o_{n}"), F.col(f"_k_{n}")
        join[n] = mine + came if n in total else F.coalesce(mine, came)["x"] if n in previous else F.coalesce(mine, came)
    out = out.withColumns(join).drop(*v.values(), *own, *carry)
    return out if keep_slices else out.drop(_SLICE)


def count_opens(df: DataFrame, by: list[str], order: list[str], opens: Column, name: str, keep_slices: bool = False) -> DataFrame:
    """Adds ``name``: how many rows up to this one open something; a unit's first row always does."""
    s = sliced(df, by, order).withColumn("_f", F.coalesce(opens, F.lit(False)).cast("long"))
    own = F.sum("_f").over(_within(by, order).rowsBetween(Window.unboundedPreceding, 0))
    g = s.groupBy(_SLICE, *by).agg(F.sum("_f").alias("_s"), F.min_by("_f", F.struct(*order)).alias("_first"))
    w = _across(by)
    came = F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1 - F.first("_first").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = _add(s.withColumn("_o", own), g.withColumn("_k", came).select(_SLICE, *by, "_k"), by)
    out = out.withColumn(name, F.col("_o") + F.col("_k")).drop("_f", "_o", "_k")
    return out if keep_slices else out.drop(_SLICE)


def numbered_runs(df: DataFrame, by: list[str], order: list[str], key: Column, name: str = "island", keep_slices: bool = False) -> DataFrame:
    """Numbers stretches of equal ``key`` (null equals null) from 1 within ``by``."""
    s = sliced(df, by, order).withColumn("_key", F.struct(key.alias("x")))
    w = _within(by, order)
    turned = F.when(F.lag("_key").over(w).isNull() | F.lag("_key").over(w).eqNullSafe(F.col("_key")), 0).otherwise(1)
    s = s.withColumn("_t", turned)
    own = F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))
    place = F.struct(*order)
    g = s.groupBy(_SLICE, *by).agg(F.sum("_t").alias("_s"), F.min_by("_key", place).alias("_a"), F.max_by("_key", place).alias("_z"))
    x = _across(by)
    g = g.withColumn("_open", F.when(F.lag("_z").over(x).eqNullSafe(F.col("_a")), 0).otherwise(1))
    came = F.sum(F.col("_s") + F.col("_open")).over(x.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")
    out = _add(s.withColumn("_o", own), g.withColumn("_k", came).select(_SLICE, *by, "_k"), by)
    out = out.withColumn(name, F.col("_o") + F.col("_k")).drop("_key", "_t", "_o", "_k")
    return out if keep_slices else out.drop(_SLICE)
