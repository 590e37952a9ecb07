import numpy as np
import pytest

import corpus_pipeline as cp

from skein.llm import substring_dedup as sd

from .test_langid_lines import _brute_lines, brute_languages
from .test_ngram_join import brute
from .test_substrings_toxicity import _brute as brute_spans

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, odd_docs):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*cp.COLUMNS).withColumn("doc_id", cp.F.col("doc_id") + 100)
    odd = odd_docs.select("doc_id", "text", "lang", "source", cp.F.lit(1).cast("long").alias("n_chars"))
    return odd.unionByName(real).repartition(5).cache()


def _firsts(rows):
    """Of each group of linked rows the first by doc_id and text."""
    rows = sorted(r for r in rows if r[0] is not None)
    return sorted(rows[i] for i, _, c in brute([(i, t) for i, (_, t) in enumerate(rows)], 5, 80, 100) if i == c)


def test_rows_that_repeat_a_doc_id_are_judged_by_their_texts(spark):
    a, b = ("the one text about a thing that " * 3 + "ends here", "quite another text on some other thing " * 3 + "and more")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, b, "en", "s", 1), (3, a, "en", "s", 1), (3, "short", "en", "s", 1), (4, "", "en", "s", 1)]
    got = cp.near_dedup(spark, spark.createDataFrame(rows, KIND), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == _firsts([r[:2] for r in rows]) == [(1, b), (1, a), (3, "short"), (4, "")]


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "substring dedup", "packing"]


def test_each_stage_against_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    kept = cp.language_id(spark, docs, "")
    assert kept.columns == list(cp.COLUMNS)
    found = brute_languages([(r[1], r[2]) for r in rows], [r[1] for r in rows])
    want = sorted(((*r[:2], lang, *r[3:]) for r, (lang, near) in zip(rows, found, strict=True) if near), key=repr)
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == want

    lines = cp.line_dedup(spark, kept.cache(), "")
    got = [tuple(r) for r in lines.collect()]
    assert lines.columns == list(cp.COLUMNS) and all(r[4] == len(r[1]) for r in got)
    import hashlib

    assert sorted(((r[0], hashlib.sha256(r[1].encode()).hexdigest()) for r in got), key=repr) == sorted(((d, h) for d, _, _, h in _brute_lines([r[:2] for r in want])), key=repr)

    near = cp.near_dedup(spark, lines.cache(), "")
    groups = brute([r[:2] for r in got], 5, 80, 100)
    out = [tuple(r) for r in near.collect()]
    assert sorted((r[0], r[1]) for r in out if r[0] is not None) == _firsts([r[:2] for r in got])
    assert {d for d, _, c in groups if d is not None and d == c} == {r[0] for r in out if r[0] is not None}
    assert sum(r[0] is None for r in out) == sum(r[0] is None for r in got)

    cut = cp.substring_dedup(spark, near.cache(), "")
    assert cut.columns == list(cp.COLUMNS)
    assert sorted(((r[0], r[1]) for r in cut.collect()), key=repr) == sorted(((d, t) for d, t, _, _ in brute_spans([r[:2] for r in out], sd.RUN, sd.MIN_WORDS)), key=repr)

    pieces = cp.packing(spark, cut, "").collect()
    ids = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id is None, r.doc_id, r.sequence_id, r.offset)):
        ids[r.doc_id] = ids.get(r.doc_id, 0) + len(np.frombuffer(r.ids, "<u4"))
    assert set(ids) == {r[0] for r in cut.collect()}


def test_run(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
    assert cp.ORACLE_SQL is None


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    for _, stage in cp.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0


def test_text_unlike_all_languages_goes(spark):
    known = [(i, "the quick brown fox jumps over the lazy dog and runs away", "en", "s", 1) for i in range(20)]
    other = [(100, "\u10d0\u10d1\u10d2 \u10d3\u10d4\u10d5", None, "s", 1), (101, "the dog", None, "s", 1)]
    kept = {r.doc_id for r in cp.language_id(spark, spark.createDataFrame(known + other, KIND), "").collect()}
    assert kept == {*range(20), 101}
