"""From label occurrences to a registry of canonical nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V


def gather(tags: DataFrame, unit: str) -> DataFrame:
    """(unit, label, surface, fold): every label but the unknown one, and the loose pieces of mixed bundles."""
    t = tags.select(unit, T.norm_label(F.col("label")).alias("label"), "surface").where(F.col("label") != V.UNKNOWN)
    loose = t.select(unit, F.explode(T.mixed_bundle_pieces(F.col("label"))).alias("label"), "surface")
    return t.unionByName(loose).withColumn("fold", T.fold_key(F.col("label")))


def spellings(gathered: DataFrame) -> DataFrame:
    return gathered.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


def canonical(counts: DataFrame, fold: str = "fold", label: str = "label", n: str = "n") -> DataFrame:
    """(fold, canonical, total, n_spellings): the most frequent spelling, ties to the greatest."""
    return counts.groupBy(fold).agg(F.max_by(label, F.struct(n, label)).alias("canonical"), F.sum(n).alias("total"), F.count(F.lit(1)).alias("n_spellings"))


def apply_aliases(counts: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Re-keys the folds that have an alias and adds the counts up. ``missing_aliases`` tells beforehand what is lost."""
    a = aliases.select(T.fold_key(F.col("alias")).alias("fold"), T.fold_key(F.col("canonical")).alias("_to"))
    out = counts.join(a, "fold", "left").withColumn("fold", F.coalesce("_to", "fold")).drop("_to")
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def missing_aliases(counts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Folds that an alias names, on either side, and no node has."""
    named = aliases.select(F.explode(F.array(T.fold_key(F.col("alias")), T.fold_key(F.col("canonical")))).alias("fold")).distinct()
    return named.join(counts.select("fold").distinct(), "fold", "left_anti")


def override(tags: DataFrame, overlay: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Left-joins corrections; the correction wins."""
    o = overlay.select(*keys, F.col(value).alias("_new"))
    return tags.join(o, keys, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def set_members(labels: DataFrame, known: DataFrame, label: str = "label", fold: str = "fold") -> DataFrame:
    """(label, members): comma labels whose pieces, two at least, are all known folds or capitalised names."""
    c = labels.select(label).distinct().where(F.col(label).contains(","))
    p = c.select(label, F.posexplode(T.pieces(F.col(label))).alias("pos", "piece")).withColumn("_fold", T.fold_key(F.col("piece")))
    k = known.select(F.col(fold).alias("_fold"), F.lit(True).alias("_known")).distinct()
    p = p.join(k, "_fold", "left").withColumn("_ok", F.coalesce("_known", F.lit(False)) | T.is_capitalized_name(F.col("piece")))
    g = p.groupBy(label).agg(F.bool_and("_ok").alias("ok"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("m"))
    return g.where("ok and n >= 2").select(label, F.transform("m", lambda x: x["piece"]).alias("members"))


def raw_to_canonical(registry: DataFrame) -> DataFrame:
    """(fold, canonical): every spelling's key, or the heading's where a node has no labels; the last node wins."""
    spelt = F.when(F.size(F.coalesce("labels", F.array().cast("array<string>"))) > 0, F.col("labels")).otherwise(F.array("canonical"))
    e = registry.select("canonical", "ord", F.posexplode(spelt).alias("pos", "label")).withColumn("fold", T.fold_key(F.col("label")))
    return e.groupBy("fold").agg(F.max_by("canonical", F.struct("ord", "pos")).alias("canonical"))


def near_duplicates(labels: DataFrame, label: str = "label") -> DataFrame:
    """(shorter, longer): labels whose content tokens are a proper subset of another's.

    Joined on tokens. A token's group is as wide as the labels it occurs in, so each shorter label asks only
    under its rarest token.
    """
    t = labels.select(label).distinct().where(~F.col(label).contains(",")).withColumn("toks", T.content_tokens(F.col(label))).where(F.size("toks") > 0)
    e = t.select(label, "toks", F.explode("toks").alias("tok"))
    df = e.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    rare = e.join(df, "tok").groupBy(label).agg(F.min_by("tok", F.struct("df", "tok")).alias("tok"), F.first("toks").alias("a"))
    longer = e.select(F.col(label).alias("longer"), F.col("toks").alias("b"), "tok")
    j = rare.withColumnRenamed(label, "shorter").join(longer, "tok")
    return j.where((F.size("a") < F.size("b")) & (F.size(F.array_except("a", "b")) == 0)).select("shorter", "longer")


def bare_targets(individuals: DataFrame, label: str = "label") -> DataFrame:
    """(bare, fuller): single-token names and the multi-token names they head."""
    one = individuals.select(F.col(label).alias("bare")).where(~F.col("bare").contains(" ") & ~F.col("bare").isin(*V.EXCLUDE_BARE)).distinct()
    many = individuals.select(F.col(label).alias("fuller")).distinct().withColumn("bare", F.explode(F.array_distinct(F.split("fuller", " "))))
    return one.join(many, "bare").where((F.col("bare") != F.col("fuller")) & T.heads_name(F.col("bare"), F.col("fuller")))


def registry_lists(counts: DataFrame, unit: str) -> DataFrame:
    """(unit, ord, fold, canonical, labels, surfaces) from counts (unit, fold, label, surface, n), the most frequent node of a unit first.

    Labels: the canonical one, then by count and spelling; surfaces (form, n) by count and form; nodes by count and canonical label.
    """
    texts = counts.groupBy("fold", "label").agg(F.sum("n").alias("n"))
    head = canonical(texts).select("fold", "canonical")
    per = counts.groupBy(unit, "fold", "label").agg(F.sum("n").alias("n")).join(head, "fold")
    order = F.struct((F.col("label") != F.col("canonical")).alias("other"), (-F.col("n")).alias("m"), "label")
    labels = per.groupBy(unit, "fold", "canonical").agg(F.array_sort(F.collect_list(order)).alias("_l"), F.sum("n").alias("total"))
    forms = counts.groupBy(unit, "fold", F.col("surface").alias("form")).agg(F.sum("n").alias("n"))
    forms = forms.groupBy(unit, "fold").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "form"))).alias("_s"))
    w = Window.partitionBy(unit).orderBy(F.desc("total"), "canonical")
    out = labels.join(forms, [unit, "fold"])
    surfaces = F.transform("_s", lambda x: F.struct(x["form"].alias("form"), (-x["m"]).alias("n")))
    return out.select(unit, (F.row_number().over(w) - 1).alias("ord"), "fold", "canonical", F.transform("_l", lambda x: x["label"]).alias("labels"), surfaces.alias("surfaces"))
