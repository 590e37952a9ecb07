from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import verbs

TEXT = """# asks asks asks
* asks asks
- tells
  [tells] tells
{calls}
Virgil asks and asks; he calls, Dante's glass gives this.

He greets the souls. He notes: calls."""


def table(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")


def test_only_prose_is_counted(spark):
    got = {r.word: (r.n, r.bucket) for r in verbs.counts(table(spark, TEXT, None, "", "# asks"), "text").collect()}
    assert got == {"asks": (2, "diegetic"), "calls": (2, "diegetic"), "gives": (1, "diegetic"), "greets": (1, "diegetic"), "souls": (1, "diegetic"), "notes": (1, "diegetic")}


def test_struck_words_leave_the_head(spark):
    struck = spark.createDataFrame([("souls", "noun"), ("souls", "noun"), ("notes", "discourse")], "word string, bucket string")
    n = verbs.counts(table(spark, TEXT), "text", struck)
    assert {r.word: r.bucket for r in n.collect() if r.bucket != "diegetic"} == {"souls": "noun", "notes": "discourse"}
    assert [tuple(r) for r in verbs.head(n, 3).collect()] == [("asks", 2), ("calls", 2), ("gives", 1)]


def test_a_verb_of_two_predicates_counts_for_both_and_once_in_the_share(spark):
    listed = verbs.classes(spark)
    h = verbs.head(verbs.counts(table(spark, TEXT), "text"))
    got = {r.predicate: (r.verbs, r.n) for r in verbs.by_predicate(h, listed).collect()}
    assert got == {"asks": (["asks"], 2), "calls": (["calls"], 2), "names": (["calls"], 2), "gives": (["gives"], 1), "addresses": (["greets"], 1), "meets": (["greets"], 1), None: (["notes", "souls"], 2)}
    assert verbs.coverage(h, listed).collect()[0].asDict() == {"n_words": 6, "covered": 6, "total": 8, "pct": 75.0, "uncovered": ["notes", "souls"], "n_predicates": 31, "tractable": True}


def test_no_texts_no_head(spark):
    h = verbs.head(verbs.counts(table(spark), "text"))
    r = verbs.coverage(h, verbs.classes(spark)).collect()[0]
    assert (r.n_words, r.covered, r.total, r.pct, r.uncovered) == (0, 0, 0, 0.0, [])
    assert verbs.by_predicate(h, verbs.classes(spark)).count() == 0


def test_terms_are_marked_by_whole_words_of_any_script(spark):
    terms = ["Ida", "Élan", "Ida Élan", "(C.)", "a.b"]
    df = spark.createDataFrame([("féIda IDA élan Ida Élanx ida élan, axb (c.) A.B *Ida*", terms)], "t string, k array<string>")
    assert df.select(T.mark_terms(F.col("t"), F.col("k"))).first()[0] == "féIda *IDA élan* *Ida* Élanx *ida élan*, axb *(c.)* *A.B* *Ida*"


def test_capitalised_runs_of_whole_texts(spark):
    df = spark.createDataFrame([("il conte Ugolino della Gherardesca e Anselmuccio",), ("A" * 5 + " B" * 30000,), ("keine",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.capitalised_runs(F.col("t"))).collect()]
    assert got[0] == ["conte Ugolino", "della Gherardesca", "e Anselmuccio"]
    assert got[1] == ["A" * 5 + " B" * 30000] and got[2:] == [[], [], None]
