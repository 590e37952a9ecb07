"""Positional regions of a journey: same/new decisions, carried settings, runs and their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from .intervals import islands
from .scan import count_opens, numbered_runs, prefix_scan


def region_keys(terms: DataFrame, by: list[str], order: list[str], new: str = "is_new") -> DataFrame:
    """Adds region_key r1, r2, ...: a term that is new, or the first, opens one."""
    return count_opens(terms, by, order, F.col(new), "_n").withColumn("region_key", F.concat(F.lit("r"), "_n")).drop("_n")


def region_labels(terms: DataFrame, by: list[str], surface: str, order: str) -> DataFrame:
    """(by, region_key, label): the most frequent surface, ties to the earliest, numbered where names repeat."""
    c = terms.groupBy(*by, "region_key", surface).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    # one comparison: the count up, then the first appearance down
    base = c.groupBy(*by, "region_key").agg(F.min_by(surface, F.struct(-F.col("n"), F.col("first"))).alias("base"), F.min("first").alias("first"))
    k = F.row_number().over(Window.partitionBy(*by, "base").orderBy("first"))
    return base.withColumn("_k", k).select(*by, "region_key", F.when(F.col("_k") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" #"), "_k")).alias("label"))


def scene_regions(scenes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds region: a scene's own first key, else the last key named in any scene before it."""
    return prefix_scan(scenes, by, order, before={"_b": F.col("last_key")}).withColumn("region", F.coalesce("first_key", "_b")).drop("_b")


def region_runs(scenes: DataFrame, by: list[str], unit: list[str], order: list[str], lo: str, hi: str) -> DataFrame:
    """Runs of equal region within a unit; scenes before any region are unstated."""
    s = scenes.withColumn("region", F.coalesce("region", F.lit(V.UNSTATED)))
    s = numbered_runs(s, unit, order, F.col("region"))
    return s.groupBy(*unit, "island").agg(F.first("region").alias("region"), F.min(lo).alias("run_start"), F.max(hi).alias("run_end"), F.count(F.lit(1)).alias("n"))


def paragraphs(scenes: DataFrame, unit: list[str], place: str, order: list[str], longest: int = 5) -> DataFrame:
    """Adds paragraph: a change of place, or ``longest`` scenes, opens one."""
    cols = [F.col(o) for o in order]
    s = islands(scenes, F.col(place), unit, cols)
    k = F.row_number().over(Window.partitionBy(*unit, "island").orderBy(*cols))
    s = s.withColumn("_part", F.floor((k - 1) / longest))
    return islands(s, F.struct("island", "_part"), unit, cols, "paragraph").drop("_part", "island")


def term_ordinals(rows: DataFrame, by: list[str], scene: list[str], order: list[str], surface: str) -> tuple[DataFrame, DataFrame]:
    """(terms, scenes): the places that are named, numbered ``occ`` from 0 in each unit, and each scene's first place with its numbers.

    A carried setting (null surface) takes no number; a scene that names none has no row in ``scenes``.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    terms = rows.where(F.col(surface).isNotNull()).withColumn("occ", F.row_number().over(w) - 1)
    scenes = terms.groupBy(*by, *[c for c in scene if c not in by]).agg(F.min_by(surface, "occ").alias("first_named"), F.array_sort(F.collect_list("occ")).alias("occs"))
    return terms, scenes


def replay(terms: DataFrame, cache: DataFrame, unit: list[str], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(replayed, open): units all of whose terms (unit, occ, surface) the cache knows under the same surface take its region_key, others ask again.

    ``open`` has ``next_no``, the number after the last one cached for ``by``.
    """
    c = cache.select(*unit, "occ", F.col("surface").alias("_s"), "region_key")
    j = terms.join(c, [*unit, "occ"], "left").withColumn("_hit", F.coalesce(F.col("_s") == F.col("surface"), F.lit(False)))
    whole = j.groupBy(*unit).agg(F.every("_hit").alias("_whole"))
    j = j.join(whole, unit)
    last = cache.groupBy(*by).agg((F.max(F.substring("region_key", 2, 18).cast("long")) + 1).alias("next_no"))
    done = j.where("_whole").select(*terms.columns, "region_key")
    return done, j.where("not _whole").select(*terms.columns).join(last, by, "left").withColumn("next_no", F.coalesce("next_no", F.lit(1).cast("long")))
