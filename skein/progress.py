"""Progress inside a unit: an offset log of the lines accepted so far.

Accepted lines are appended as ``lines/batch=N``; ``offsets/batch=N`` (unit, upto) follows once they stand. A batch counts only with its
offsets, so a run that broke between the two writes batch N again over what it left. The work list is what lies above a unit's
offset: an equi-join with one row a unit, no look at the lines written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def batches_done(spark: SparkSession, path: str) -> int:
    n = 0
    while _exists(spark, f"{path}/offsets/batch={n}/_SUCCESS"):
        n += 1
    return n


def offsets(spark: SparkSession, path: str, unit: list[str], kinds: dict[str, str]) -> DataFrame:
    """(unit, upto): each begun unit's last accepted line; ``kinds`` names the unit columns' types."""
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in unit) + ", upto int"
    n = batches_done(spark, path)
    if not n:
        return spark.createDataFrame([], schema)
    log = spark.read.schema(schema).parquet(*[f"{path}/offsets/batch={i}" for i in range(n)])
    return log.groupBy(*unit).agg(F.max("upto").alias("upto"))


def remaining(lines: DataFrame, log: DataFrame, unit: list[str], line: str = "line") -> DataFrame:
    """Lines above their unit's offset."""
    return lines.join(log, unit, "left").where(F.col("upto").isNull() | (F.col(line) > F.col("upto"))).drop("upto")


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """All lines of whole batches."""
    n = batches_done(spark, path)
    if not n:
        raise ValueError(f"{path} holds no batch")
    return spark.read.parquet(*[f"{path}/lines/batch={i}" for i in range(n)])


def advance(lines: DataFrame, path: str, unit: list[str], make: Callable[[DataFrame], DataFrame], step: int = 50, line: str = "line") -> int:
    """One batch: the next ``step`` lines of every open unit go to ``make``, which gives them back with ``made`` and ``ok``; how many lines were accepted.

    A unit's lines are accepted up to its first one that is not ok, which comes again in the next batch. Lines are numbered in
    order, gaps allowed; a line ``make`` leaves out is not ok. What ``make`` gives is written before it is judged.
    """
    spark = lines.sparkSession
    kinds = dict(lines.dtypes)
    n = batches_done(spark, path)
    todo = remaining(lines, offsets(spark, path, unit, kinds), unit, line)
    w = Window.partitionBy(*unit).orderBy(line)
    todo = todo.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= step).drop("_r")
    draft = f"{path}/drafts/batch={n}"
    said = make(todo).select(*unit, line, "made", "ok")
    todo.select(*unit, line).join(said, [*unit, line], "left").write.mode("overwrite").parquet(draft)
    drafted = spark.read.parquet(draft)
    stop = drafted.where(~F.coalesce("ok", F.lit(False))).groupBy(*unit).agg(F.min(line).alias("_stop"))
    good = drafted.join(stop, unit, "left").where(F.col("_stop").isNull() | (F.col(line) < F.col("_stop"))).select(*unit, line, "made")
    good.write.mode("overwrite").parquet(f"{path}/lines/batch={n}")
    done = spark.read.parquet(f"{path}/lines/batch={n}")
    done.groupBy(*unit).agg(F.max(line).cast("int").alias("upto")).write.mode("overwrite").parquet(f"{path}/offsets/batch={n}")
    return done.count()


def run(lines: DataFrame, path: str, unit: list[str], make: Callable[[DataFrame], DataFrame], step: int = 50, stalls: int = 3, line: str = "line") -> bool:
    """Batches until every line is accepted (true), or ``stalls`` batches in a row accept none."""
    spark, idle = lines.sparkSession, 0
    while idle < stalls:
        if remaining(lines, offsets(spark, path, unit, dict(lines.dtypes)), unit, line).isEmpty():
            return True
        idle = 0 if advance(lines, path, unit, make, step, line) else idle + 1
    return False
