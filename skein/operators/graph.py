"""The graph of figures: nodes from the registry, edges from relations with their ends, scene and asserter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from .checks import broken_rules
from .intervals import contain_join, dealt, exactly_one, innermost
from .scene import resolve_ends


def build_nodes(registry: DataFrame) -> DataFrame:
    """(id, type, members): members null where there are none."""
    return registry.select(F.col("canonical").alias("id"), "type", F.when(F.size(F.coalesce("members", F.array().cast("array<string>"))) > 0, F.col("members")).alias("members"))


def edge_scenes(relations: DataFrame, scenes: DataFrame, unit: list[str], row: list[str], width: int | None = None) -> DataFrame:
    """Relations (unit, row, start, end) with ``scene_id``, the one scene (unit, scene_id, lo, hi) that holds their lines; null if none or several do."""
    hits = contain_join(relations.select(*unit, *row, "start", "end"), dealt(scenes.select(*unit, "scene_id", "lo", "hi")), unit, ("start", "end"), ("lo", "hi"), width=width)
    one = exactly_one(hits, [*unit, *row], "scene_id", "scene_id").drop("n_hits")
    return relations.join(dealt(one), [*unit, *row], "left")


def asserters(edges: DataFrame, spans: DataFrame, unit: list[str], row: list[str], width: int | None = None) -> DataFrame:
    """Edges with ``asserter``: of reported, foretold and compared ones the speaker of the innermost span (unit, ord, lo, hi, speaker) around them.

    Of spans of one length the first counts; an unattributed speaker is null; edges told outright have none.
    """
    told = edges.where(F.col("frame").isin(*V.ASSERTING_FRAMES))
    hits = contain_join(told.select(*unit, *row, "start", "end"), dealt(spans.select(*unit, F.col("ord").alias("_ord"), "lo", "hi", "speaker")), unit, ("start", "end"), ("lo", "hi"), how="inner", width=width)
    who = innermost(hits, [*unit, *row], "speaker", F.col("hi") - F.col("lo"), F.col("_ord")).withColumn("asserter", F.nullif("speaker", F.lit(V.UNATTRIBUTED))).drop("speaker")
    return edges.join(dealt(who), [*unit, *row], "left")


def build_edges(relations: DataFrame, scenes: DataFrame, tags: DataFrame, canon: DataFrame, spans: DataFrame, unit: list[str], row: list[str], width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, problems): edges of one scene whose ends are tags of it, with names, nodes and asserter; what stands in the way of the others.

    ``tags`` (unit, scene_id, tag_no, label), ``canon`` (fold, canonical). A node that is not found is null, no problem.
    """
    placed = edge_scenes(relations, scenes, unit, row, width)
    ended = resolve_ends(placed, tags, canon, [*unit, "scene_id"])
    at = F.concat_ws("-", "start", "end")
    homeless = F.col("scene_id").isNull()
    problems = broken_rules(ended, "graph", unit, at, {
        "not in one scene": homeless,
        "subject tag missing": ~homeless & F.col("subj_name").isNull(),
        "object tag missing": ~homeless & F.col("obj_name").isNull(),
    })
    good = ended.where("scene_id is not null and subj_name is not null and obj_name is not null")
    return asserters(good, spans, unit, row, width), problems


def speech_edges(spans: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attributed spans, problems): spans with a speaker; speakers that are no node are problems."""
    said = spans.where(F.col("speaker") != V.UNATTRIBUTED)
    strange = said.join(registry.select(F.col("canonical").alias("speaker")), "speaker", "left_anti")
    return said, broken_rules(strange, "graph", ["quote_id"], F.col("speaker"), {"speaker is no node": F.lit(True)})


def recurring(regions: DataFrame, unit: list[str], key: str, island: str) -> DataFrame:
    """Keys of more than one island."""
    return regions.groupBy(*unit, key).agg(F.count_distinct(island).alias("n_islands")).where("n_islands > 1")
