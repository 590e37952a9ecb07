"""A unit's layers as text to read: one row (canticle, canto, text) a unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regions import paragraphs

UNIT = ["canticle", "canto"]
LANGUAGES = ("en", "ja")
LONGEST = 5


def _title() -> Column:
    return F.concat(F.lit("# Canto "), F.lpad(F.col("canto").cast("string"), 2, "0"), F.lit(" — "), F.coalesce("canto_title", F.lit("")))


def _page(blocks: DataFrame, order: str) -> DataFrame:
    """A unit's blocks (arrays of lines) in order under its title."""
    rows = F.array_sort(F.collect_list(F.struct(order, "block")))
    g = blocks.groupBy(*UNIT).agg(F.max("canto_title").alias("canto_title"), rows.alias("x"))
    return g.select(*UNIT, F.array_join(F.concat(F.array(_title()), F.flatten(F.transform("x", lambda x: x["block"]))), "\n").alias("text"))


def scene_view(scenes: DataFrame) -> DataFrame:
    """Scenes (canticle, canto, canto_title, s, e, scene_name, summary), each under its heading; empty summaries leave no line."""
    head = F.concat(F.lit("## Scene "), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"), F.lit(": "), F.coalesce("scene_name", F.lit("")))
    block = F.array_compact(F.array(F.lit(""), head, F.nullif(F.col("summary"), F.lit(""))))
    return _page(scenes.select(*UNIT, "canto_title", "s", block.alias("block")), "s")


def digest_view(digest: DataFrame, scenes: DataFrame, lock: DataFrame, languages: tuple[str, ...] = LANGUAGES, longest: int = LONGEST) -> DataFrame:
    """The digest as prose: a change of the lock's location, or ``longest`` scenes, opens a paragraph; its sentences in one line a language.

    ``digest`` (canticle, canto, s, e, a column a language), ``lock`` (canticle, canto, lines, location). Scenes follow ``scenes``; one without a digest
    takes its place in the count of scenes and says nothing; one without a location differs from those that have one.
    """
    key = [*UNIT, "s", "e"]
    ends = F.split("lines", "-")
    place = lock.select(*UNIT, F.get(ends, F.lit(0)).cast("int").alias("s"), F.get(ends, F.lit(1)).cast("int").alias("e"), F.col("location").alias("_at")).groupBy(*key).agg(F.max("_at").alias("_at"))
    j = scenes.select(*key, "canto_title").join(place, key, "left").join(digest.select(*key, *languages), key, "left")
    p = paragraphs(j, UNIT, "_at", ["s", "e"], longest)
    said = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col(k) != "", F.struct("s", "e", k)))), lambda x: x[k])
    g = p.groupBy(*UNIT, "paragraph").agg(F.max("canto_title").alias("canto_title"), *[F.array_join(said(k), " ").alias(k) for k in languages])
    block = F.array_compact(F.array(F.lit(""), *[F.nullif(F.col(k), F.lit("")) for k in languages]))
    return _page(g.select(*UNIT, "canto_title", "paragraph", block.alias("block")), "paragraph")
