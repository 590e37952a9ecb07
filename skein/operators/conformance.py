"""Is what a digest asserts licensed by its scene's lock? A dictionary of words for each scene, joined by word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .lock import licensed_names

def set_licences(locks: DataFrame, scene: list[str], unit: list[str]) -> DataFrame:
    """(scene, name): members of comma labels in a scene's cast whose pieces, two or more, are all figures of the unit's casts or names."""
    who = locks.select(*dict.fromkeys((*scene, *unit)), F.explode("cast.who").alias("label"))
    known = who.select(*unit, T.fold_key(F.col("label")).alias("_fold")).distinct().withColumn("_known", F.lit(True))
    sets = who.where(F.col("label").contains(",")).select(*unit, "label").distinct()
    pieces = sets.select(*unit, "label", F.explode(F.filter(F.transform(F.split("label", ","), F.trim), lambda p: p != "")).alias("name")).withColumn("_fold", T.fold_key(F.col("name")))
    j = pieces.join(known, [*unit, "_fold"], "left")
    ok = F.every(F.coalesce(F.col("_known"), T.is_capitalized_name(F.col("name")), F.lit(False)))
    g = j.groupBy(*unit, "label").agg(ok.alias("_ok"), F.collect_list("name").alias("_names")).where(F.col("_ok") & (F.size("_names") >= 2))
    return who.where(F.col("label").contains(",")).join(g, [*unit, "label"]).select(*scene, F.explode("_names").alias("name"))


def licences(locks: DataFrame, scene: list[str], unit: list[str], constant: tuple[str, ...] = ()) -> DataFrame:
    """(scene, word): every lower-cased word of every name that a scene's lock mentions, of set members and of the ``constant`` names, which every scene licenses."""
    names = licensed_names(locks, constant=constant).select(*scene, F.explode("names").alias("name"))
    both = names.unionByName(set_licences(locks, scene, unit))
    return both.select(*scene, F.explode(T.name_tokens(F.col("name"))).alias("word")).select(*scene, F.lower("word").alias("word")).distinct()


def assertions(digest: DataFrame, scene: list[str]) -> DataFrame:
    """(scene, lang, token, word): name-like tokens of ``digest`` (scene, lang, text).

    ``en``: capitalised tokens that neither begin a sentence nor are common openers, the possessive left off in ``word``; ``ja``: every
    Latin token. Other languages and null texts assert nothing.
    """
    en = digest.where("lang = 'en'").select(*scene, "lang", F.explode(T.sentences(F.col("text"))).alias("s"))
    en = en.select(*scene, "lang", F.posexplode(T.name_tokens(F.col("s"))).alias("pos", "token")).where((F.col("pos") > 0) & F.col("token").rlike(r"^\p{Lu}") & ~F.col("token").isin(*V.SENTENCE_OPENERS))
    ja = digest.where("lang = 'ja'").select(*scene, "lang", F.explode(T.name_tokens(F.col("text"))).alias("token"))
    en = en.select(*scene, "lang", "token", F.lower(T.strip_possessive(F.col("token"))).alias("word"))
    return en.unionByName(ja.select(*scene, "lang", "token", F.lower("token").alias("word")))


def conform(digest: DataFrame, locks: DataFrame, scene: list[str], unit: list[str], constant: tuple[str, ...] = ()) -> DataFrame:
    """(scene, lang, token, n, licensed): asserted tokens with their counts; scenes that lack a lock are left out."""
    held = digest.join(locks.select(*scene).distinct(), scene, "left_semi")
    # counted before the look-up, so a token of a scene meets the dictionary once
    n = assertions(held, scene).groupBy(*scene, "lang", "token", "word").agg(F.count(F.lit(1)).alias("n"))
    ok = licences(locks, scene, unit, constant).withColumn("_ok", F.lit(True))
    return n.join(ok, [*scene, "word"], "left").select(*scene, "lang", "token", "n", F.col("_ok").isNotNull().alias("licensed"))


def scene_figures(conformed: DataFrame, scene: list[str]) -> DataFrame:
    """(scene, asserted, in_lock, deviations): deviations as ``lang:token``, in order."""
    d = F.array_sort(F.array_distinct(F.collect_list(F.when(~F.col("licensed"), F.concat_ws(":", "lang", "token")))))
    return conformed.groupBy(*scene).agg(F.sum("n").alias("asserted"), F.sum(F.when(F.col("licensed"), F.col("n")).otherwise(0)).alias("in_lock"), d.alias("deviations"))


def totals(conformed: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, asserted, in_lock, rate) by unit and over all (nulls), the rate in percent, 100 where nothing is asserted."""
    g = conformed.rollup(*unit).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("asserted"), F.coalesce(F.sum(F.when(F.col("licensed"), F.col("n")).otherwise(0)), F.lit(0)).alias("in_lock"))
    return g.withColumn("rate", F.when(F.col("asserted") == 0, 100.0).otherwise(F.round(100 * F.col("in_lock") / F.col("asserted"), 1)))
