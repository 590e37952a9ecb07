"""What the sinks write, the readers read back; what a reply says, the grammars find."""

import pytest
from pyspark.sql import functions as F

from skein.functions import replies as R
from skein.functions import text as T
from skein.sources import layers, sinks

SCENES = [("a", 1, 1, 3, "first"), ("a", 1, 4, 6, "second"), ("a", 2, 1, 9, "only"), ("b", 1, 1, 2, "other")]


@pytest.fixture(scope="module")
def scenes(spark):
    return spark.createDataFrame(SCENES, "canticle string, canto int, s int, e int, name string")


def same(a, b):
    key = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    assert key(a.select(*b.columns)) == key(b)


CASES = {
    "tags": ("ord int, tag_no int, label string", [(0, 1, "Renzo"), (1, 2, "Lucia, duca")], R.tag_line, layers.read_tags),
    "location": ("ord int, it string, en string, basis_start int, basis_end int", [(0, "selva oscura", "dark wood", 1, 2), (1, None, "same", 2, 2)], R.location_line, layers.read_locations),
    "presence": ("ord int, who string, status string, basis_start int, basis_end int", [(0, "Renzo", "present", 1, 1), (1, "X", "mentioned", 1, 2)], R.presence_line, layers.read_presence),
    "addressee": ("ord int, quote_id string, start int, end int, speaker string, addressee string, source string, basis_start int, basis_end int", [(0, "q1", 1, 2, "A", "(none)", "none", 1, 2)], R.addressee_line, layers.read_addressee),
    "cohort": ("ord int, cohort string, source string, basis_start int, basis_end int", [(0, "i golosi", "code", 1, 2), (1, "gli avari", "llm", 2, 2)], R.cohort_line, layers.read_cohort),
}


@pytest.mark.parametrize("layer", sorted(CASES))
def test_scene_layers_round_trip(spark, scenes, tmp_path, layer):
    kind, rows, line, read = CASES[layer]
    df = spark.createDataFrame([(*sc[:4], *r) for sc in SCENES[:3] for r in rows], f"canticle string, canto int, s int, e int, {kind}")
    root = str(tmp_path / layer)
    sinks.write_scene_blocks(scenes, df, root, line())
    assert (tmp_path / layer / "a" / "01.txt").read_text().startswith("## Scene 1-3: first\n")
    same(read(spark, root), df)
    assert layers.scene_blocks(spark, root).count() == len(SCENES)
    # rewriting one unit leaves the others alone, and block by block what was finished stays
    part = df.where("canticle = 'a' and canto = 2")
    sinks.write_scene_blocks(scenes.where("canticle = 'a' and canto = 2"), part.where("ord = 0"), root, line())
    same(read(spark, root), df.where("canto = 1 or ord = 0"))


def test_recaps_follow_the_blocks(spark, scenes, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, 3, 0, "body")], "canticle string, canto int, s int, e int, ord int, line string")
    recap = spark.createDataFrame([("a", 1, "what was\ncarried")], "canticle string, canto int, recap string")
    sinks.write_scene_blocks(scenes, rows, str(tmp_path / "r"), F.col("line"), recap=recap)
    got = {(r.canticle, r.canto): r.recap for r in layers.read_recaps(spark, str(tmp_path / "r")).collect()}
    assert got == {("a", 1): "what was\ncarried", ("a", 2): "", ("b", 1): ""}
    assert {r.body for r in layers.scene_blocks(spark, str(tmp_path / "r")).collect()} == {"body", ""}


def test_line_layers_round_trip(spark, tmp_path):
    speech = spark.createDataFrame([("a", 1, i, f"q{i}", i, i + 1, "Renzo", "strong", ["multi(A;B)"] if i else []) for i in range(12)], "canticle string, canto int, ord int, quote_id string, start int, end int, speaker string, signal string, flags array<string>")
    sinks.write_lines(speech, str(tmp_path / "s"), sinks.speech_line())
    same(layers.read_speech(spark, str(tmp_path / "s")), speech)
    rel = spark.createDataFrame([("a", 3, 0, 1, "meets", 2, "literal", 3, 4), ("b", 1, 0, 2, "sees", 1, "simile", 1, 1)], "canticle string, canto int, ord int, subj int, predicate string, obj int, frame string, start int, end int")
    sinks.write_lines(rel, str(tmp_path / "r"), R.relation_line())
    same(layers.read_relations(spark, str(tmp_path / "r")), rel)
    sc = spark.createDataFrame([("a", 1, "Title", 1, 3, "first", "what"), ("a", 1, "Title", 4, 6, "second", "more")], "canticle string, canto int, canto_title string, s int, e int, scene_name string, summary string")
    sinks.write_files(sinks.scene_json(sc), str(tmp_path / "j"), suffix="json")
    same(layers.read_scenes(spark, str(tmp_path / "j")), sc)
    sinks.write_files(sinks.scene_page(sc), str(tmp_path / "m"), suffix="md")
    assert (tmp_path / "m/a/01.md").read_text().splitlines()[-2:] == ["| 1-3 | first | what |", "| 4-6 | second | more |"]


def test_section_layers_round_trip(spark, tmp_path):
    reg = spark.createDataFrame([("a", 0, "Renzo", "individual", ["Renzo", "il Renzo"], [("Renzo", 3), ("el", 1)], [], True), ("a", 1, "A, B", "set", [], [], ["A", "B"], True), ("b", 0, "gente", "class", ["gente"], [], [], False)], "canticle string, ord int, canonical string, type string, labels array<string>, surfaces array<struct<form:string,n:int>>, members array<string>, grouped boolean")
    sinks.write_sections(reg, str(tmp_path / "g"), sinks.registry_block())
    same(layers.read_registry(spark, str(tmp_path / "g")), reg)
    topo = spark.createDataFrame([("a", 0, "selva", "wood", [("selva", 2)], [(1, 1, 3), (2, 4, 9)])], "canticle string, ord int, region_id string, en string, surfaces array<struct<form:string,n:int>>, runs array<struct<canto:int,ls:int,le:int>>")
    sinks.write_sections(topo, str(tmp_path / "t"), sinks.topography_block())
    same(layers.read_topography(spark, str(tmp_path / "t")), topo)
    roll = spark.createDataFrame([("a", 0, "selva", None, [("gente", 2)]), ("a", 1, "riva", "shore", [])], "canticle string, ord int, region_id string, en string, cohorts array<struct<form:string,n:int>>")
    sinks.write_sections(roll, str(tmp_path / "c"), sinks.cohort_block())
    assert (tmp_path / "c/a.txt").read_text() == "## selva\n- en: -\n- cohort: gente (2)\n\n## riva\n- en: shore\n- cohort: (none)\n"


def test_locks_round_trip(spark, tmp_path):
    lock = spark.createDataFrame([("a", 1, 0, "1-3", "T \"x\"", None, "r", ["i golosi"], [("A", "present")], [("q1", "1-2", "A", "B", "code")], [("el", 2, "Renzo")], [("A", "sees", "B", "1-1")], [("1-1", "lupo")], "1-3"), ("a", 1, 1, "4-6", "U\n", "selva", None, [], [], [], [], [], [], "4-6")], layers.LOCK_SCHEMA)
    sinks.write_locks(lock, str(tmp_path / "l"))
    got = layers.read_lock(spark, str(tmp_path / "l"))
    same(got, lock.fillna({"location": "", "region": ""}))


def parsed(spark, layer, text):
    df = spark.createDataFrame([(1, text), (2, "")], "id int, reply string")
    rows = [tuple(r)[1:] for r in R.parse(df, ["id"], layer).orderBy("ord").collect()]
    return rows, [r.raw for r in R.malformed(df, ["id"], layer).orderBy("ord").collect()]


def test_reply_grammars(spark):
    assert parsed(spark, "tags", "1. A\n2. B\nnote\n1. C") == ([(1, 2, "B"), (3, 1, "C")], [])
    assert parsed(spark, "types", "1. Renzo = individual\n2. x = BAD") == ([(0, 1, "Renzo", "individual")], [])
    assert parsed(spark, "coref", "thinking\nel = Renzo\nel = Lucia") == ([(1, "el", "Renzo")], [])
    assert parsed(spark, "relations", "- [1] sees [2] | frame: literal | lines 4\n- [1] sees | oops\n- other") == ([(0, 1, "sees", 2, "literal", 4, 4)], ["- [1] sees | oops"])
    assert parsed(spark, "location", "- it: - | en: same | basis: 3\n- no\ntext") == ([(0, "-", "same", 3, 3)], ["- no"])
    assert parsed(spark, "walk", "1. selva = SAME\n2. riva = new\n3. x = maybe") == ([(0, 1, "selva", "same"), (1, 2, "riva", "new")], [])
    assert parsed(spark, "presence", "- who: A | status: maybe | basis: 1-2\n- who: B") == ([(0, "A", "maybe", 1, 2)], ["- who: B"])
    assert parsed(spark, "addressee", "addressee: A | basis: 1\n- addressee: B | basis: 2-3\naddressee: C") == ([(0, "A", 1, 1)], ["addressee: C"])
    assert parsed(spark, "cohort", "cohort: A | basis: 1\n- cohort: B | basis: 2-3\ncohort:") == ([(0, "A", 1, 1), (1, "B", 2, 3)], ["cohort:"])


def test_numbered_replies(spark):
    df = spark.createDataFrame([("1: a b \n```\n 2. c\nthinking out loud\n1 again\n",)], "t string")
    r = df.select(T.numbered(F.col("t")).alias("n"), T.extraneous(F.col("t")).alias("x")).first()
    assert r.n == {2: "c", 1: "again"} and r.x == ["thinking out loud"]
    s = spark.createDataFrame([([(2, "b"), (1, "a")],)], "l array<struct<line:int,text:string>>").select(T.numbered_source(F.col("l")).alias("s")).first().s
    assert s == "1 a\n2 b"
    e = spark.createDataFrame([("Io", "i'"), (" io ", "io"), ("Renzo", "io"), ("'I'", "i")], "a string, b string")
    assert [r.x for r in e.select(T.is_echo(F.col("a"), F.col("b")).alias("x")).collect()] == [False, True, False, True]


def test_figures_in_roster_order(spark):
    figs = spark.createDataFrame([(1, 0, "lucia", "present", 1, 1), (1, 1, "Renzo", "mentioned", 2, 2), (1, 2, "Lucia", "mentioned", 3, 3), (1, 3, "Nobody", "present", 1, 1)], "scene int, ord int, who string, status string, basis_start int, basis_end int")
    roster = spark.createDataFrame([(1, 0, "Renzo"), (1, 1, "Lucia"), (1, 2, "Agnese")], "scene int, ord int, who string")
    got = R.in_roster_order(figs, roster, ["scene"]).orderBy("ord").collect()
    assert [(r.who, r.status, r.basis_start) for r in got] == [("Renzo", "mentioned", 2), ("Lucia", "present", 1)]
