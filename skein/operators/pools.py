"""Closed pools of a scene's figures, from what the other layers say of it; cohorts folded onto regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .checks import broken_rules
from .intervals import contain_join, dealt


def opening_scene(spans: DataFrame, scenes: DataFrame, unit: list[str], key: list[str]) -> DataFrame:
    """Adds the scene that holds a span's first line, null where none does; of overlapping scenes the first one.

    ``spans`` (unit, key, start, ..), one row a key; ``scenes`` (unit, scene, lo, hi). A span that runs on into the next scene stays with where it begins.
    """
    on = [*unit, *key]
    hit = contain_join(spans.select(*on, "start").where("start is not null"), dealt(scenes.select(*unit, "scene", "lo", "hi")), unit, ("start", "start"), ("lo", "hi"), "inner")
    first = hit.groupBy(*on).agg(F.min_by("scene", F.struct("lo", "hi", "scene")).alias("scene"))
    return spans.join(dealt(first), on, "left")


def scene_anchors(spans: DataFrame, edges: DataFrame, scenes: DataFrame, canon: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, scene, who): nodes that are present by what else is known: speakers of quotes wholly inside a scene, subjects of its literal edges.

    ``spans`` (unit, start, end, speaker), ``edges`` (unit, scene, frame, subj_node), ``scenes`` (unit, scene, lo, hi), ``canon`` (fold,
    canonical). Speakers without a node, as the unattributed, anchor nothing; so do edges whose subject is null or empty.
    """
    # each speaker once a scene before its spelling is folded
    said = contain_join(spans, dealt(scenes.select(*unit, "scene", "lo", "hi")), unit, ("start", "end"), ("lo", "hi"), "inner").select(*unit, "scene", "speaker").distinct()
    nodes = canon.where("canonical <> ''").select(F.col("fold").alias("_fold"), F.col("canonical").alias("who"))
    said = said.withColumn("_fold", T.fold_key(F.col("speaker"))).join(nodes, "_fold").select(*unit, "scene", "who")
    acted = edges.where("frame = 'literal' and subj_node <> ''").select(*unit, "scene", F.col("subj_node").alias("who"))
    return said.unionByName(acted).distinct()


def check_anchors(figures: DataFrame, anchors: DataFrame, scene: list[str]) -> DataFrame:
    """Figures (scene, who, status) only mentioned where an anchor says they are present, whatever the spelling (soft)."""
    a = anchors.select(*scene, T.fold_key(F.col("who")).alias("_fold")).distinct()
    m = figures.where("status = 'mentioned'").withColumn("_fold", T.fold_key(F.col("who"))).join(dealt(a), [*scene, "_fold"], "left_semi")
    return broken_rules(m, "presence", scene, F.col("who"), {"soft: only mentioned but anchored": F.lit(True)})


def cohort_candidates(figures: DataFrame, registry: DataFrame, scene: list[str], order: Column, reader: tuple[str, ...] = V.READER_FORMS) -> DataFrame:
    """Present figures whose very heading is a class or generic in the registry, words to the reader left out; of one fold in a scene the first in ``order``."""
    ok = registry.where(F.col("type").isin(*V.COHORT_TYPES)).select(F.col("canonical").alias("who")).distinct()
    f = figures.where("status = 'present'").join(ok, "who", "left_semi").withColumn("_fold", T.fold_key(F.col("who")))
    f = f.where(~F.coalesce(F.array_contains(F.array(*[T.fold_key(F.lit(w)) for w in reader]).cast("array<string>"), F.col("_fold")), F.lit(False)))
    rest = [c for c in figures.columns if c not in scene]
    return f.groupBy(*scene, "_fold").agg(F.min_by(F.struct(*rest), order).alias("_x")).select(*scene, "_x.*")


def cohorts_by_region(cohorts: DataFrame, runs: DataFrame, regions: DataFrame, unit: list[str], order: list[str]) -> DataFrame:
    """(region, cohort, n): how many rows of a region name a cohort, whatever the spelling; the label is the first seen of all that lie in a region.

    ``cohorts`` (unit, s, cohort, ``order``), ``runs`` (unit, ls, le, region, ord), ``regions`` (region). A scene belongs to the first run, by
    ``ord``, that holds its first line; a scene in none is left out. Regions without a cohort have one row with a null cohort and 0.
    """
    at = [*unit, "s"]
    # scenes are looked up once, not once a cohort
    hit = contain_join(cohorts.select(*at).distinct(), runs.select(*unit, "ls", "le", "region", "ord"), unit, ("s", "s"), ("ls", "le"), "inner")
    place = hit.groupBy(*at).agg(F.min_by("region", F.struct("ord", "region")).alias("region"))
    seen = F.struct(*order, "cohort")
    g = cohorts.where("cohort is not null").join(place, at).groupBy("region", T.fold_key(F.col("cohort")).alias("_fold")).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("_first"))
    label = g.groupBy("_fold").agg(F.min("_first").alias("_first")).select("_fold", F.col("_first.cohort").alias("cohort"))
    g = g.drop("_first").join(label, "_fold").select("region", "cohort", "n")
    return regions.select("region").distinct().join(g, "region", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
