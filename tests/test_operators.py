import random

import pytest
from pyspark.sql import functions as F

from skein import oracle
from skein.operators import checks, coreference, identity, intervals, regions, scene


def test_registry(spark):
    t = spark.createDataFrame([("a", "La altra", "x"), ("a", "altra", "x"), ("b", "L'altra", "y"), ("b", "altra", "y"), ("b", "(unknown)", "z"), ("b", "Renzo, noble souls", "s")], "unit string, label string, surface string")
    g = identity.gather(t, "unit")
    c = {r.fold: (r.canonical, r.total, r.n_spellings) for r in identity.canonical(identity.spellings(g)).collect()}
    assert c == {"altra": ("altra", 4, 3), "renzo, noble souls": ("Renzo, noble souls", 1, 1), "noble souls": ("noble souls", 1, 1)}


def test_sets_and_aliases(spark):
    labels = spark.createDataFrame([("Cammilla, Turno",), ("quei che va, lento",), ("A,",), ("turno, lento",)], "label string")
    known = spark.createDataFrame([("turno",), ("lento",)], "fold string")
    got = {r.label: r.members for r in identity.set_members(labels, known).collect()}
    assert got == {"Cammilla, Turno": ["Cammilla", "Turno"], "turno, lento": ["turno", "lento"]}
    counts = spark.createDataFrame([("a", 2), ("b", 3), ("c", 1)], "fold string, n long")
    alias = spark.createDataFrame([("A", "b")], "alias string, canonical string")
    assert {r.fold: r.n for r in identity.apply_aliases(counts, alias, ["fold"]).collect()} == {"b": 5, "c": 1}
    lost = spark.createDataFrame([("A", "zz")], "alias string, canonical string")
    assert [r.fold for r in identity.missing_aliases(counts, lost).collect()] == ["zz"]


def test_raw_to_canonical_last_wins(spark):
    reg = spark.createDataFrame([(0, "Renzo", ["Renzo", "il poeta"]), (1, "Lucia", ["poeta"]), (2, "A, B", [])], "ord int, canonical string, labels array<string>")
    assert {r.fold: r.canonical for r in identity.raw_to_canonical(reg).collect()} == {"renzo": "Renzo", "poeta": "Lucia", "a, b": "A, B"}


def test_candidates_by_type(spark):
    types = [("Carlo", "individual"), ("Carlo Martello", "individual"), ("figlio di Carlo", "individual"), ("il duca", "individual"), ("quei che va", "individual"), ("il Duca", "individual"), ("Virgilio", "individual"), ("duca", "class"), ("Dio", "individual"), ("Altissimo Dio", "individual")]
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(types)], "ord int, label string, type string")
    assert {r.label for r in coreference.epithets(t).collect()} == {"figlio di Carlo", "il duca", "il Duca"}
    assert {r.fold: r.label for r in coreference.named_individuals(t).collect()} == {"carlo": "Carlo", "carlo martello": "Carlo Martello", "virgilio": "Virgilio", "dio": "Dio", "altissimo dio": "Altissimo Dio"}
    seeds = spark.createDataFrame([("Carlo", "duca", 0), ("Carlo", "Carlo Martello", 1), ("Carlo", "nobody", 2), ("Virgilio", "Altissimo Dio", 3), ("x", "duca", 4)], "bare string, fuller string, ord int")
    assert {r.bare: r.targets for r in coreference.candidate_targets(t, seeds).collect()} == {"Carlo": ["Carlo Martello", "duca"], "Virgilio": ["Altissimo Dio"]}
    tags = spark.createDataFrame([(1, 1, "il duca"), (1, 2, "VIRGILIO"), (2, 2, "Virgilio"), (2, 1, "il duca")], "s int, tag_no int, label string")
    named = spark.createDataFrame([("Virgilio", 1), ("VIRGILIO", 0)], "label string, ord int")
    got = coreference.epithet_scenes(tags, coreference.epithets(t), named, ["s"]).collect()
    assert {(r.s, r.label): r.candidates for r in got} == {(1, "il duca"): ["Virgilio"], (2, "il duca"): ["Virgilio"]}


def test_binned_containment_is_the_plain_one(spark):
    rng = random.Random(1)
    pts = [(i, rng.randrange(3), (a := rng.randrange(200)), a + rng.randrange(9)) for i in range(200)]
    spans = [(rng.randrange(3), (a := rng.randrange(200)), a + rng.randrange(60), i) for i in range(60)]
    p = spark.createDataFrame(pts, "i int, k int, lo int, hi int")
    s = spark.createDataFrame(spans, "k int, start int, end int, span int")
    plain = {(r.i, r.span) for r in intervals.contain_join(p, s, ["k"], ("lo", "hi"), ("start", "end")).collect()}
    binned = {(r.i, r.span) for r in intervals.contain_join(p, s, ["k"], ("lo", "hi"), ("start", "end"), width=16).collect()}
    brute = {(i, n) for i, k, lo, hi in pts for kk, a, b, n in spans if k == kk and a <= lo and hi <= b}
    assert plain == binned and brute == {x for x in plain if x[1] is not None}


def test_partition_problems(spark):
    sc = spark.createDataFrame([("ok", 1, 3), ("ok", 4, 6), ("gap", 1, 2), ("gap", 4, 6), ("lap", 1, 4), ("lap", 3, 6), ("rev", 1, 6), ("rev", 7, 5), ("short", 1, 5)], "u string, s int, e int")
    total = spark.createDataFrame([(u, 6) for u in ("ok", "gap", "lap", "rev", "short")], "u string, total int")
    got = {(r.u, r.problem, r.at) for r in intervals.partition_problems(sc, ["u"], "s", "e", total).collect()}
    assert got == {("gap", "gap", 3), ("lap", "overlap", 3), ("rev", "reversed", 7), ("short", "coverage", 5)}


def test_spans(spark):
    q = spark.createDataFrame([("a", None, 0, 1, 0, 5, 9), ("b", "a", 0, 2, 3, 3, 4), ("c", None, 1, 7, 0, 7, 8)], "quote_id string, parent_id string, ord int, start_line int, start_col int, end_line int, end_col int")
    w = scene.walk_spans(q, [])
    assert [(r.quote_id, r.depth) for r in w.orderBy("path").collect()] == [("a", 0), ("b", 1), ("c", 0)]
    pts = spark.createDataFrame([(1, 0), (1, 1), (2, 3), (2, 4), (3, 4), (7, 8), (9, 9)], "line int, col int")
    got = {(r.line, r["col"]): r.quote_id for r in scene.own_region(pts, w.drop("parent_id", "ord", "path"), []).collect()}
    assert got == {(1, 1): "a", (2, 3): "a", (2, 4): "b", (3, 4): "a"}


def test_attribution(spark):
    rows = [(1, "io", "Renzo"), (1, "mi", "X"), (2, "io", "A"), (2, "i'", "B"), (3, "mi", "W"), (4, "mi", "A"), (4, "me", "B"), (5, "noi", "A"), (6, None, None)]
    got = {r.q: (r.speaker, r.signal, r.flags) for r in scene.attribute(spark.createDataFrame(rows, "q int, surface string, who string"), ["q"]).collect()}
    none = "(unattributed)"
    assert got == {1: ("Renzo", "strong", []), 2: (none, "none", ["multi(A;B)"]), 3: ("W", "weak", []), 4: (none, "none", []), 5: (none, "none", ["plural"]), 6: (none, "none", [])}


def test_routing_and_sets(spark):
    cast = spark.createDataFrame([(1, "Renzo", 0), (1, "Lucia", 1), (2, "l'Altra", 0), (3, "A", 2), (3, "B", 1), (3, "C", 0)], "sc int, who string, ord int")
    ask = spark.createDataFrame([(1, "Renzo"), (2, "La altra"), (3, "C"), (4, "Z")], "sc int, speaker string")
    pool = scene.candidates(cast, ask, ["sc"], "who", "speaker")
    got = {r.sc: (r.n, r.pick, r.source) for r in scene.route(pool, ["sc"], "who", "ord").collect()}
    assert got == {1: (1, "Lucia", "code"), 2: (0, "(none)", "none"), 3: (2, "B", "llm"), 4: (0, "(none)", "none")}
    reg = spark.createDataFrame([("A", "individual", []), ("B", "class", []), ("N", "non-person", []), ("S", "set", ["A", "T"]), ("T", "set", ["B", "N"])], "canonical string, type string, members array<string>")
    m = spark.createDataFrame([(1, "S", 5), (1, "B", 2), (2, "N", 1)], "sc int, canonical string, ord int")
    assert {(r.sc, r.who, r.ord) for r in scene.roster(m, reg, ["sc"]).collect()} == {(1, "A", 5), (1, "B", 2)}


def test_innermost_first_wins(spark):
    m = spark.createDataFrame([(1, "out", 1, 9, 0), (1, "in", 3, 5, 1), (1, "twin", 2, 4, 2), (2, None, None, None, None)], "edge int, speaker string, s int, e int, ord int")
    got = {r.edge: r.speaker for r in intervals.innermost(m, ["edge"], "speaker", F.col("e") - F.col("s"), F.col("ord")).collect()}
    assert got == {1: "in", 2: None}


def test_regions(spark):
    sc = spark.createDataFrame([("u", 1, None, None), ("u", 2, "r1", "r2"), ("u", 3, None, None), ("u", 4, "r1", "r1"), ("v", 5, None, None)], "unit string, s int, first_key string, last_key string").withColumn("all", F.lit(1))
    r = regions.scene_regions(sc, ["all"], ["s"])
    assert [x.region for x in r.orderBy("s").collect()] == [None, "r1", "r2", "r1", "r1"]
    runs = regions.region_runs(r, ["all"], ["unit"], ["s"], "s", "s")
    assert sorted((x.unit, x.region, x.run_start, x.run_end) for x in runs.collect()) == [("u", "(unstated)", 1, 1), ("u", "r1", 2, 2), ("u", "r1", 4, 4), ("u", "r2", 3, 3), ("v", "r1", 5, 5)]
    t = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "b", False), (4, "b", True), (5, "a", True)], "ord int, surf string, is_new boolean").withColumn("all", F.lit(1))
    k = regions.region_keys(t, ["all"], ["ord"] and [F.col("ord")])
    assert [x.region_key for x in k.orderBy("ord").collect()] == ["r1", "r1", "r1", "r2", "r3"]
    assert {x.region_key: x.label for x in regions.region_labels(k, ["all"], "surf", "ord").collect()} == {"r1": "b", "r2": "b #2", "r3": "a"}


def test_paragraphs(spark):
    sc = spark.createDataFrame([(i, "p" if i < 7 else "q") for i in range(9)], "s int, place string").withColumn("u", F.lit(1))
    got = regions.paragraphs(sc, ["u"], "place", ["s"]).orderBy("s").collect()
    assert [r.paragraph for r in got] == [1] * 5 + [2] * 2 + [3] * 2


def test_runs_explode_back(spark):
    rng = random.Random(2)
    rows = [(u, i, rng.choice("ab")) for u in range(3) for i in range(30)]
    df = intervals.islands(spark.createDataFrame(rows, "u int, i int, k string"), F.col("k"), ["u"], [F.col("i")])
    r = intervals.runs(df, ["u"], "k", "island", "i", "i", "i").collect()
    assert sorted((x.u, i, x.k) for x in r for i in range(x.run_start, x.run_end + 1)) == sorted(rows)


def test_checks_and_oracle(spark):
    df = spark.createDataFrame([(1, "present"), (1, "present"), (2, "gone")], "k int, status string")
    p = checks.all_of(checks.repeated(df, ["k"], "presence", "not once", F.col("k"), F.lit("")), checks.in_vocabulary(df, "status", ("present", "mentioned"), "presence", F.col("k")))
    assert {(r.unit, r.code) for r in p.collect()} == {("1", "not once"), ("2", "status not in vocabulary")}
    checks.require_none(p.limit(0))
    with pytest.raises(ValueError):
        checks.require_none(p)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, first string")
    made = spark.createDataFrame([(1, "x")], "k int, pick string")
    assert {(r.k, r.pick, r.decided) for r in oracle.decide(rows, made, ["k"], "pick", F.col("first")).collect()} == {(1, "x", True), (2, "b", False)}
    got = oracle.ask(rows, lambda r: "ok" if r["k"] == 1 else "", "k int, first string").collect()
    assert {(r.k, r.reply, r.ok) for r in got} == {(1, "ok", True), (2, "", False)}


def test_batches_and_settling(spark):
    from skein import oracle

    rows = spark.range(95).select(F.concat(F.lit("k"), "id").alias("k"))
    sizes = [r.n for r in oracle.batches(rows, "k", 20, 4).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 95 and max(sizes) <= 20
    known = spark.createDataFrame([("k1", "a"), ("k2", "b")], "k string, v string")
    asked = []

    def ask(open_):
        asked.extend(r.k for r in open_.collect())
        return open_.where("k like 'k9%'").select("k", F.lit("c").alias("v"))

    out, new = oracle.settle(rows, known, ["k"], "v", ask, F.lit("(none)"))
    got = {r.k: (r.v, r.decided) for r in out.collect()}
    assert got["k1"] == ("a", True) and got["k93"] == ("c", True) and got["k3"] == ("(none)", False)
    assert len(asked) == 93 and "k1" not in asked and new.count() == 6
    p = spark.createDataFrame([("1", "empty", ""), ("1", "bad", "x")], "unit string, code string, detail string")
    assert oracle.retries(p).first().prompt == "- bad: x\n- empty"


def test_graph_speech_and_recurring(spark):
    from skein.operators import graph

    spans = spark.createDataFrame([("q1", "Renzo"), ("q2", "(unattributed)"), ("q3", "Nobody")], "quote_id string, speaker string")
    said, problems = graph.speech_edges(spans, spark.createDataFrame([("Renzo",)], "canonical string"))
    assert {r.quote_id for r in said.collect()} == {"q1", "q3"} and [r.unit for r in problems.collect()] == ["q3"]
    regions = spark.createDataFrame([(1, "a", 1), (1, "a", 3), (1, "b", 2)], "u int, k string, i int")
    assert [(r.k, r.n_islands) for r in graph.recurring(regions, ["u"], "k", "i").collect()] == [("a", 2)]


def test_finished_blocks_stay(spark):
    from skein.sources import sinks

    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, t string")
    assert sorted(tuple(r) for r in sinks.restore(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
