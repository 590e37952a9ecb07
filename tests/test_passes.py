import random

import pytest
from pyspark.sql import functions as F

from skein import oracle, passes


def test_runaway_replies():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(30)))
        piece = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        text += piece * rng.randrange(6)
        slow = any(len(p) * k >= 12 and text.endswith(p * k) for n in range(1, len(text) + 1) for p in [text[-n:]] for k in [4, 5, 6, 7, 8, 9, 10, 11, 12] if len(p) * k <= len(text))
        # an ending of whole pieces, or of some pieces and a part of one before them
        broken = any(n >= 12 and n >= 4 * p and all(text[-i] == text[-i - p] for i in range(1, n - p + 1)) for n in range(12, len(text) + 1) for p in range(1, n // 4 + 1))
        assert oracle.repeats_at_end(text, 4, 12) == broken and (broken or not slow)
    assert oracle.runaway(None) == oracle.runaway(" \n") == "empty" and oracle.runaway("x" * 10_001) == "too long"
    assert oracle.runaway("fine. " + "and so on, " * 20) == "repetition" and oracle.runaway("1. Renzo\n2. Lucia") is None


def test_ask_draws_again_after_a_runaway(spark):
    said = iter(["", "la " * 200, "yes"])
    script = list(said)

    def model(row, left=script):
        return left.pop(0)

    got = oracle.ask(spark.createDataFrame([(1,)], "id int"), model, "id int").first()
    assert (got["reply"], got["ok"]) == ("yes", True)


def scripted(spark, script):
    table = spark.createDataFrame([(u, a, r) for (u, a), r in script.items()], "u string, attempt int, reply string")
    seen = []

    def ask(open_, attempt):
        seen.append({r["u"]: r["prompt"] for r in open_.collect()})
        return table.where(F.col("attempt") == attempt).join(open_.select("u"), "u").select("u", "reply")

    return ask, seen


SCENES = [("a", 1, 10, 3), ("b", 11, 20, 3), ("c", 21, 30, 3), ("d", 31, 40, 0)]


@pytest.fixture(scope="module")
def scenes(spark):
    return spark.createDataFrame(SCENES, "u string, lo int, hi int, k int")


def test_relations(spark, scenes):
    good, bad = "- [1] sees [2] | frame: literal | lines 3-4", "- [1] sees [1] | frame: literal | lines 3"
    script = {("a", 1): good, ("b", 1): "- [1] sees 2", ("b", 2): bad, ("b", 3): "", ("c", 1): bad, ("c", 2): "- [2] eats [1] | frame: dream | lines 1", ("c", 3): bad + "\n" + good.replace("3-4", "22")}
    ask, seen = scripted(spark, script)
    rows, told = passes.relations_pass(scenes, ask, ["u"])
    assert {r["u"]: (r["attempts"], r["ok"]) for r in told.collect()} == {"a": (1, True), "b": (3, True), "c": (3, False)}
    assert [set(x) for x in seen] == [{"a", "b", "c"}, {"b", "c"}, {"b", "c"}]
    assert seen[1]["b"] == "- malformed: - [1] sees 2" and "same tag twice" in seen[1]["c"] and "lines outside the scene" in seen[1]["c"]
    assert sorted((r["u"], r["subj"], r["obj"], r["start"]) for r in rows.collect()) == [("a", 1, 2, 3), ("c", 1, 1, 3), ("c", 1, 2, 22)]


def test_presence(spark, scenes):
    roster = spark.createDataFrame([("a", "Renzo", 0), ("a", "la donna", 1), ("b", "Lucia", 0)], "u string, who string, ord int")
    line = "- who: {} | status: {} | basis: {}".format
    script = {
        ("a", 1): line("donna", "present", 2), ("a", 2): "\n".join((line("donna", "present", 2), line("RENZO", "mentioned", "1-3"))),
        ("b", 1): line("Lucia", "gone", 12), ("b", 2): line("Lucia", "present", 5), ("b", 3): line("Lucia", "present", 5),
    }
    ask, seen = scripted(spark, script)
    rows, told = passes.presence_pass(scenes, roster, ask, ["u"])
    assert {r["u"]: (r["attempts"], r["ok"]) for r in told.collect()} == {"a": (2, True), "b": (3, False)}
    assert seen[1]["a"] == "- not labelled: Renzo" and "status not in vocabulary: Lucia" in seen[1]["b"]
    assert sorted((r["u"], r["ord"], r["who"], r["status"], r["basis_start"], r["basis_end"]) for r in rows.collect()) == [("a", 0, "Renzo", "mentioned", 1, 3), ("a", 1, "la donna", "present", 2, 2), ("b", 0, "Lucia", "present", 5, 5)]


def test_cohort(spark, scenes):
    pool = [("a", "i golosi", 0, 1, 2), ("b", "gli avari", 0, 11, 12), ("b", "i prodighi", 1, 13, 14), ("c", "gli ignavi", 0, 21, 21), ("c", "le ombre", 1, 22, 22)]
    pool = spark.createDataFrame(pool, "u string, who string, ord int, basis_start int, basis_end int")
    line = "cohort: {} | basis: {}".format
    script = {("b", 1): line("Prodighi", 13) + "\n" + line("golosi", 13), ("b", 2): line("Prodighi", 13) + "\n" + line("avari", "11-20"), ("c", 1): "", ("c", 2): line("ombre", 3), ("c", 3): line("nessuno", 22)}
    ask, seen = scripted(spark, script)
    rows, told = passes.cohort_pass(scenes, pool, ask, ["u"])
    assert {r["u"]: (r["attempts"], r["ok"]) for r in told.collect()} == {"b": (2, True), "c": (3, False)}
    assert seen[1]["c"] == "- no pick"
    got = sorted((r["u"], r["cohort"], r["source"], r["basis_start"], r["basis_end"]) for r in rows.collect())
    assert got == [("a", "i golosi", "code", 1, 2), ("b", "gli avari", "llm", 11, 20), ("b", "i prodighi", "llm", 13, 13), ("c", "gli ignavi", "llm", 21, 21)]


def test_fixpoint_equals_a_loop(spark):
    rng = random.Random(9)
    units = [f"u{i}" for i in range(40)]
    script = {(u, a): rng.choice(["ok", "bad", "worse", ""]) for u in units for a in (1, 2, 3)}
    ask, _ = scripted(spark, {k: v for k, v in script.items() if v})
    df = spark.createDataFrame([(u,) for u in units], "u string")
    check = lambda said: said.where("reply <> 'ok'").select(F.lit("x").alias("layer"), F.col("u").alias("unit"), F.lit("not ok").alias("code"), F.col("reply").alias("detail")).unionByName(said.select(F.lit("x").alias("layer"), F.col("u").alias("unit"), F.lit("soft: noted").alias("code"), F.lit("").alias("detail")))
    got = {r["u"]: (r["reply"], r["attempts"], r["ok"]) for r in oracle.fixpoint(df, ["u"], ask, check).collect()}
    want = {}
    for u in units:
        for a in (1, 2, 3):
            want[u] = (script[u, a], a, script[u, a] == "ok")
            if script[u, a] == "ok":
                break
    assert got == want
