"""Whole hybrid passes: code decides what it can, a model the rest, checks send drafts back.

``ask_open(open, attempt)`` is the model: from the open units (with ``draft`` and ``prompt``) to (keys, reply). Every pass gives (rows,
told): the layer's rows and one row a unit with attempts and ok.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import replies as RP
from .functions import text as T
from .operators import checks as C
from .operators.intervals import dealt
from .oracle import fixpoint

Ask = Callable[[DataFrame, int], DataFrame]


def _of(df: DataFrame, said: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the units that are being checked."""
    return df.join(dealt(said.select(*keys)), keys, "left_semi")


def relations_pass(scenes: DataFrame, ask_open: Ask, scene: list[str], attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Edges between the tags 1..k of each scene (scene, lo, hi, k). Scenes without tags are not asked; no edge at all is a sound reply."""

    def check(said: DataFrame) -> DataFrame:
        edges = C.check_relations(RP.parse(said, scene, "relations"), _of(scenes, said, scene), scene)
        return edges.unionByName(C.unparsed(RP.malformed(said, scene, "relations"), "relations", scene))

    told = fixpoint(scenes.where("k > 0"), scene, ask_open, check, attempts)
    return RP.parse(told, scene, "relations"), told


def presence_pass(scenes: DataFrame, roster: DataFrame, ask_open: Ask, scene: list[str], attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Each figure of a scene's roster (scene, who, ord) present or mentioned; rows come in the roster's order and spelling, a figure's first row wins."""

    def check(said: DataFrame) -> DataFrame:
        figures = C.check_presence(RP.parse(said, scene, "presence"), _of(roster, said, scene), _of(scenes, said, scene), scene)
        return figures.unionByName(C.unparsed(RP.malformed(said, scene, "presence"), "presence", scene))

    asked = scenes.join(roster.select(*scene).distinct(), scene, "left_semi")
    told = fixpoint(asked, scene, ask_open, check, attempts)
    return RP.in_roster_order(RP.parse(told, scene, "presence"), roster, scene), told


def cohort_pass(scenes: DataFrame, pool: DataFrame, ask_open: Ask, scene: list[str], attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(scene, ord, cohort, source, basis_start, basis_end): scenes of no candidate (pool: scene, who, ord, basis_start, basis_end) have no row,
    of one it by ``code``, of more what the model (``llm``) picks among them.

    A draft that stays unsound gives its sound picks, each candidate once, or the first candidate with its own basis.
    """
    folded = pool.withColumn("_fold", T.fold_key(F.col("who")))
    first = F.min_by(F.struct("who", "ord", "basis_start", "basis_end"), "ord")
    # candidates of one spelling but for case and article are one, the first
    single = folded.groupBy(*scene, "_fold").agg(first.alias("c")).select(*scene, "_fold", "c.*")
    n = single.groupBy(*scene).agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    one = n.where("_n = 1").select(*scene, F.lit(0).alias("ord"), F.col("_first.who").alias("cohort"), F.lit("code").alias("source"), "_first.basis_start", "_first.basis_end")
    open_ = scenes.join(n.where("_n > 1").select(*scene), scene, "left_semi")

    def check(said: DataFrame) -> DataFrame:
        picks = C.check_cohort(RP.parse(said, scene, "cohort"), _of(pool, said, scene), _of(scenes, said, scene), scene)
        return picks.unionByName(C.unparsed(RP.malformed(said, scene, "cohort"), "cohort", scene))

    told = fixpoint(open_, scene, ask_open, check, attempts)
    picks = RP.parse(told, scene, "cohort").withColumn("_fold", T.fold_key(F.col("cohort"))).join(scenes.select(*scene, "lo", "hi"), scene)
    picks = picks.where("lo <= basis_start and basis_start <= basis_end and basis_end <= hi")
    sound = picks.join(single.select(*scene, "_fold", "who"), [*scene, "_fold"]).groupBy(*scene, "_fold").agg(F.min_by(F.struct("ord", F.col("who").alias("cohort"), "basis_start", "basis_end"), "ord").alias("p")).select(*scene, "p.*")
    asked = sound.select(*scene, "ord", "cohort", F.lit("llm").alias("source"), "basis_start", "basis_end")
    bare = told.select(*scene).join(sound.select(*scene).distinct(), scene, "left_anti").join(n, scene)
    fallback = bare.select(*scene, F.lit(0).alias("ord"), F.col("_first.who").alias("cohort"), F.lit("llm").alias("source"), "_first.basis_start", "_first.basis_end")
    return one.unionByName(asked).unionByName(fallback), told
