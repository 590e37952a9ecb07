import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import regions, scan


def made(n=700, seed=3):
    rng = random.Random(seed)
    # one unit holds most rows, many are small, one is null
    units = ["hot"] * 80 + ["a", "b", None] + [f"u{i}" for i in range(40)]
    return [(rng.choice(units), i, rng.choice([None, "x", "x", "y"]), rng.choice([None, 1, 2])) for i in rng.sample(range(10_000), n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), "u string, at int, v string, n int").repartition(5)


@pytest.mark.parametrize("by", [["u"], []])
def test_scans_equal_windows(spark, rows, by):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        w = Window.partitionBy(*by).orderBy("at")
        upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        opens = F.col("n") == 2
        got = scan.prefix_scan(rows, by, ["at"], last={"l": F.col("v")}, before={"b": F.col("v")}, total={"t": F.col("n")}, previous={"p": F.col("v"), "q": F.col("n")}, keep_slices=True)
        assert got.select("_slice").distinct().count() == 4
        hot = got.where("u = 'hot'").select("_slice").distinct().count()
        assert hot > 1
        got = scan.numbered_runs(scan.count_opens(got, by, ["at"], opens, "o", keep_slices=True), by, ["at"], F.col("v"), "i")
        changed = F.when((F.row_number().over(w) == 1) | ~F.lag("v").over(w).eqNullSafe(F.col("v")), 1).otherwise(0)
        first = F.when((F.row_number().over(w) == 1) | F.coalesce(opens, F.lit(False)), 1).otherwise(0)
        want = rows.withColumns({"c": changed, "f": first}).select("*", F.last("v", True).over(upto).alias("l"), F.last("v", True).over(prior).alias("b"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("t"), F.lag("v").over(w).alias("p"), F.lag("n").over(w).alias("q"), F.sum("f").over(upto).alias("o"), F.sum("c").over(upto).alias("i"))
        cols = ["u", "at", "l", "b", "t", "p", "q", "o", "i"]
        key = lambda df: sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
        assert key(got) == key(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_large_unit_is_split(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("one").alias("u"), F.col("id").alias("at"), F.when(F.col("id") % 1000 == 7, F.col("id")).alias("v"))
    got = scan.prefix_scan(df, ["u"], ["at"], last={"l": F.col("v")}, total={"t": F.lit(1)}, keep_slices=True)
    share = got.groupBy("_slice").count().agg(F.max("count"), F.count("*")).first()
    assert share[1] > 1 and share[0] < n
    wrong = got.where((F.col("t") != F.col("at") + 1) | ~F.col("l").eqNullSafe(F.when(F.col("at") >= 7, F.floor((F.col("at") - 7) / 1000) * 1000 + 7)))
    assert wrong.count() == 0


def test_empty(spark, rows):
    none = rows.limit(0)
    assert scan.prefix_scan(none, ["u"], ["at"], total={"t": F.col("n")}).count() == scan.numbered_runs(none, ["u"], ["at"], F.col("v")).count() == scan.count_opens(none, ["u"], ["at"], F.lit(True), "o").count() == 0


def test_regions_by_scan(spark):
    t = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, None), ("b", 1, True)], "u string, at int, is_new boolean")
    assert sorted((r.u, r.at, r.region_key) for r in regions.region_keys(t, ["u"], ["at"]).collect()) == [("a", 1, "r1"), ("a", 2, "r2"), ("a", 3, "r2"), ("b", 1, "r1")]
    s = spark.createDataFrame([("a", 1, None, None), ("a", 2, "r1", "r2"), ("a", 3, None, None), ("a", 4, "r3", "r3")], "u string, at int, first_key string, last_key string")
    got = regions.scene_regions(s, ["u"], ["at"])
    assert [(r.at, r.region) for r in got.orderBy("at").collect()] == [(1, None), (2, "r1"), (3, "r2"), (4, "r3")]
    runs = regions.region_runs(got, ["u"], ["u"], ["at"], "at", "at")
    assert sorted((r.region, r.run_start, r.run_end) for r in runs.collect()) == [("(unstated)", 1, 1), ("r1", 2, 2), ("r2", 3, 3), ("r3", 4, 4)]
