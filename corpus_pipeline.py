"""The corpus pipeline: language ID, line dedup, near-duplicate texts, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import cut, drop
from skein.llm.langid import UND, identify, learn_profiles
from skein.llm.line_dedup import dedup_lines
from skein.llm.ngram_join import jaccard_components
from skein.llm.packing import pack
from skein.llm.substring_dedup import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, ``n_chars`` counted anew."""
    return df.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no text, no letter, or no n-gram that any profile has near its rank: score 0) go.

    The others' ``lang`` becomes the language found. The profiles come from all documents that name a language.
    """
    got = identify(docs, learn_profiles(docs), keep=("source", "n_chars"))
    return got.where((F.col("lang_pred") != UND) & (F.col("score") > 0)).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller doc_id holds go; every document stays."""
    return _documents(dedup_lines(docs, keep=("lang", "source")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked at five words and 0.8, the one of smallest doc_id stays; rows without a doc_id all stay.

    Where rows repeat a doc_id, each is judged by its own text, in the order of doc_id and text.
    """
    key, rows = "doc_id", docs
    if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        key = "row_id"
        rows = cut(docs.where("doc_id is not null").orderBy("doc_id", "text").withColumn(key, F.monotonically_increasing_id()), "rows")
    groups = jaccard_components(rows, NEAR_WORDS, NEAR_NUM, NEAR_DEN, id_col=key)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    kept = rows.join(first, key, "left_semi").select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of passages that a smaller doc_id holds go; every document stays."""
    return _documents(dedup_substrings(docs, keep=("lang", "source")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: language ID and packing are beyond SQL; tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
            if before is not None:
                drop(before)
            before = docs
    return docs
