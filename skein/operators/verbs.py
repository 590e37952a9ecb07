"""Verbs of commentary prose against a closed list of predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

TOP, MOST_PREDICATES = 60, 40


def classes(spark: SparkSession, verbs: dict[str, tuple[str, ...]] = V.VERBS) -> DataFrame:
    """(predicate, word) of a closed list."""
    return spark.createDataFrame([(p, w) for p, ws in verbs.items() for w in ws], "predicate string, word string")


def counts(texts: DataFrame, text: str, struck: DataFrame | None = None) -> DataFrame:
    """(word, n, bucket): words of verb form in the prose lines, counted; ``struck`` (word, bucket) names nouns and words about
    the telling itself, all others are ``diegetic``. A null text, or one of headings and bullets only, has none."""
    words = texts.select(F.explode(T.prose(F.col(text))).alias("_line")).select(F.explode(T.latin_words(F.col("_line"))).alias("word"))
    n = words.where(T.is_verb_like(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if struck is None:
        return n.withColumn("bucket", F.lit("diegetic"))
    out = struck.groupBy("word").agg(F.min("bucket").alias("bucket"))
    return n.join(out, "word", "left").withColumn("bucket", F.coalesce("bucket", F.lit("diegetic")))


def head(counted: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` most frequent diegetic words, ties by word. Each task sorts its own part and sends ``top`` rows."""
    return counted.where("bucket = 'diegetic'").orderBy(F.desc("n"), "word").limit(top).select("word", "n")


def by_predicate(heads: DataFrame, listed: DataFrame) -> DataFrame:
    """(predicate, verbs, n): the words of the head that each predicate stands for, sorted; a word of several counts for each, of none for null."""
    # a head has at most ``top`` rows
    j = heads.join(listed.distinct(), "word", "left")
    return j.groupBy("predicate").agg(F.array_sort(F.collect_list("word")).alias("verbs"), F.sum("n").alias("n"))


def coverage(heads: DataFrame, listed: DataFrame, most: int = MOST_PREDICATES) -> DataFrame:
    """One row (n_words, covered, total, pct, uncovered, n_predicates, tractable): the share of the head's occurrences that the list
    has, a word once however many predicates it has; the list is tractable with at most ``most`` predicates. An empty head covers 0 of 0."""
    known = heads.join(listed.select("word").distinct().withColumn("_ok", F.lit(True)), "word", "left")
    left = F.array_sort(F.collect_list(F.when(F.col("_ok").isNull(), F.struct((-F.col("n")).alias("a"), "word"))))
    total, covered = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_ok"), F.col("n"))), F.lit(0))
    got = known.agg(F.count(F.lit(1)).alias("n_words"), covered.alias("covered"), total.alias("total"), F.transform(left, lambda x: x["word"]).alias("uncovered"))
    size = listed.agg(F.count_distinct("predicate").alias("n_predicates"))
    pct = F.when(F.col("total") > 0, F.round(100 * F.col("covered") / F.col("total"), 1)).otherwise(F.lit(0.0))
    # one row each
    return got.crossJoin(F.broadcast(size)).select("n_words", "covered", "total", pct.alias("pct"), "uncovered", "n_predicates", (F.col("n_predicates") <= most).alias("tractable"))
