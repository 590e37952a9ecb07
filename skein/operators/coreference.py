"""Scene-local identity decisions: where a label occurs, who it may be, and the overlay that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .identity import bare_targets

DISTINCT = "distinct"


def occurrences(tags: DataFrame, wanted: DataFrame, scene: list[str]) -> DataFrame:
    """(scene, label, tag_nos): the tags of each wanted label in each scene, in order."""
    w = wanted.select("label", T.norm_label(F.col("label")).alias("_norm")).distinct()
    t = tags.select(*scene, "tag_no", T.norm_label(F.col("label")).alias("_norm")).join(w, "_norm")
    return t.groupBy(*scene, "label").agg(F.array_sort(F.collect_list("tag_no")).alias("tag_nos"))


def epithets(types: DataFrame) -> DataFrame:
    """(label): individuals of ``types`` (label, type) that are neither names nor led by a demonstrative; whom they mean is decided scene by scene."""
    name, deictic = (F.coalesce(f(F.col("label")), F.lit(False)) for f in (T.is_capitalized_name, T.is_deictic))
    return types.where((F.col("type") == "individual") & ~name & ~deictic).select("label").distinct()


def named_individuals(types: DataFrame) -> DataFrame:
    """(fold, label): the named individuals of ``types`` (label, type, ord), one a fold, the last in order."""
    n = types.where((F.col("type") == "individual") & F.coalesce(T.is_capitalized_name(F.col("label")), F.lit(False)))
    return n.withColumn("fold", T.fold_key(F.col("label"))).groupBy("fold").agg(F.max_by("label", F.struct("ord", "label")).alias("label"))


def candidate_targets(types: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(bare, targets): single-token individuals with the fuller ones they head, sorted, then the seeds (bare, fuller, ord) of any type that are not among them."""
    people = types.where("type = 'individual'").select("label").distinct()
    headed = bare_targets(people).select("bare", "fuller", F.lit(-1).alias("ord"))
    if seeds is not None:
        one = people.where(~F.col("label").contains(" ") & ~F.col("label").isin(*V.EXCLUDE_BARE)).select(F.col("label").alias("bare"))
        known = types.where("type <> ''").select(F.col("label").alias("fuller")).distinct()
        headed = headed.unionByName(seeds.select("bare", "fuller", "ord").join(one, "bare", "left_semi").join(known, "fuller", "left_semi"))
    first = headed.groupBy("bare", "fuller").agg(F.min("ord").alias("ord"))
    return first.groupBy("bare").agg(F.array_sort(F.collect_list(F.struct("ord", "fuller"))).alias("_x")).select("bare", F.transform("_x", lambda x: x["fuller"]).alias("targets"))


def epithet_scenes(tags: DataFrame, epithets: DataFrame, named: DataFrame, scene: list[str]) -> DataFrame:
    """(scene, label, candidates): scenes where an epithet stands beside named figures, these sorted.

    Grouped by scene alone, so no pair of tags is ever formed. Of names of one fold the last by ``ord`` counts, where ``named`` has it.
    """
    order = F.struct(F.col("ord") if "ord" in named.columns else F.lit(0), "label")
    n = named.withColumn("_fold", T.fold_key(F.col("label"))).groupBy("_fold").agg(F.max_by("label", order).alias("_named"))
    e = epithets.select(T.norm_label(F.col("label")).alias("_norm"), F.col("label").alias("_epithet")).distinct()
    t = tags.select(*scene, T.fold_key(F.col("label")).alias("_fold"), T.norm_label(F.col("label")).alias("_norm")).distinct()
    t = t.join(n, "_fold", "left").join(e, "_norm", "left").where("_named is not null or _epithet is not null")
    g = t.groupBy(*scene).agg(F.array_sort(F.collect_set("_named")).alias("candidates"), F.collect_set("_epithet").alias("_labels"))
    return g.where(F.size("candidates") > 0).select(*scene, F.explode("_labels").alias("label"), "candidates")


def overlay_rows(decisions: DataFrame, candidates: DataFrame, occurring: DataFrame, scene: list[str]) -> DataFrame:
    """(scene, tag_no, label): a decision (scene, label, pick) on every tag of its label, if it still is a candidate."""
    d = decisions.where(F.col("pick") != DISTINCT).join(candidates, [*scene, "label"]).where(F.array_contains("candidates", F.col("pick")))
    o = d.select(*scene, "label", "pick").join(occurring, [*scene, "label"])
    return o.select(*scene, F.explode("tag_nos").alias("tag_no"), F.col("pick").alias("label"))
