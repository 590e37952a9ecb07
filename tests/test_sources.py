import tomllib

from pyspark.sql import functions as F

from skein.sources import layers, sinks
from skein.streaming import ingest


def put(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")
    return str(root)


SCENES = """# Canto 01 — title

## Scene 1-3: first
{0}

## Scene 4-6: second
{1}

# recap
what was

carried
"""


def test_blocks_and_tags(spark, tmp_path):
    root = put(tmp_path / "t", "libro/01.txt", SCENES.format("1. Renzo\n2. (unknown)\nnoise", "1. Lucia, duca\n"))
    put(tmp_path / "t", "libro/02.txt", "## Scene 1-2: only\n")
    b = {(r.canto, r.s, r.e): r.body for r in layers.scene_blocks(spark, root).collect()}
    assert b == {(1, 1, 3): "1. Renzo\n2. (unknown)\nnoise", (1, 4, 6): "1. Lucia, duca", (2, 1, 2): ""}
    assert [(r.canticle, r.canto) for r in layers.available_cantos(spark, root).collect()] == [("libro", 1), ("libro", 2)]
    assert {r.canto: r.recap for r in layers.read_recaps(spark, root).collect()} == {1: "what was\ncarried", 2: ""}
    over = put(tmp_path, "coref.txt", "# note\nlibro/1/4-6/1 = X\nlibro/1/4-6/1 = Y\n") + "/coref.txt"
    t = layers.read_tags(spark, root, layers.read_overlay(spark, over))
    assert {(r.s, r.tag_no): r.label for r in t.collect()} == {(1, 1): "Renzo", (1, 2): "(unknown)", (4, 1): "Y"}
    bad = layers.malformed(layers._lines(layers.scene_blocks(spark, root), layers.SCENE, "body"), layers.SCENE, layers.TAG)
    assert [r.raw for r in bad.collect()] == ["noise"]


def test_line_formats(spark, tmp_path):
    r = put(tmp_path / "s", "libro/01.txt", "- q1 lines 1-3 | speaker: Renzo | signal: strong | flags: -\n- q2 lines 2-2 | speaker: (unattributed) | signal: none | flags: multi(A;B), cross-scene\n")
    got = layers.read_speech(spark, r).orderBy("ord").collect()
    assert [(x.quote_id, x.start, x.end, x.speaker, x.flags) for x in got] == [("q1", 1, 3, "Renzo", []), ("q2", 2, 2, "(unattributed)", ["multi(A;B)", "cross-scene"])]
    assert [x.v for x in layers.read_speech(spark, r).select("ord", sinks.speech_line().alias("v")).orderBy("ord").collect()] == (tmp_path / "s/libro/01.txt").read_text().splitlines()
    r = put(tmp_path / "r", "libro/01.txt", "- [1] meets [2] | frame: literal | lines 3-4\n- [x] bad\n")
    assert [(x.subj, x.predicate, x.obj, x.frame, x.start, x.end) for x in layers.read_relations(spark, r).collect()] == [(1, "meets", 2, "literal", 3, 4)]
    r = put(tmp_path / "l", "libro/01.txt", SCENES.format("- it: selva oscura | en: dark wood | basis: 2-3\n- it: - | en: same | basis: 1", ""))
    assert [(x.s, x.it, x.en, x.basis_start, x.basis_end) for x in layers.read_locations(spark, r).orderBy("ord").collect()] == [(1, "selva oscura", "dark wood", 2, 3), (1, None, "same", 1, 1)]
    r = put(tmp_path / "p", "libro/01.txt", SCENES.format("- who: Renzo | status: present | basis: 1\n- who: X | status: maybe | basis: 1", "- who: Y | status: mentioned | basis: 4-5"))
    assert {(x.who, x.status, x.basis_end) for x in layers.read_presence(spark, r).collect()} == {("Renzo", "present", 1), ("Y", "mentioned", 5)}
    r = put(tmp_path / "a", "libro/01.txt", SCENES.format("- q1 lines 1-2 | speaker: A | addressee: (none) | source: none | basis: 1-2", ""))
    assert [(x.quote_id, x.addressee, x.source) for x in layers.read_addressee(spark, r).collect()] == [("q1", "(none)", "none")]
    r = put(tmp_path / "c", "libro/01.txt", SCENES.format("- cohort: (none) | source: none | basis: 1", "- cohort: i golosi | source: code | basis: 4"))
    assert [(x.s, x.cohort) for x in layers.read_cohort(spark, r).collect()] == [(4, "i golosi")]
    r = put(tmp_path / "d", "libro/01.txt", SCENES.format("en: Renzo walks.\nja: ダンテ", "en: Only."))
    assert {(x.s, x.en, x.ja) for x in layers.read_digest(spark, r).collect()} == {(1, "Renzo walks.", "ダンテ"), (4, "Only.", "")}


def test_sections_round_trip(spark, tmp_path):
    text = "## Renzo\n- type: individual\n- labels: Renzo | il poeta\n- surfaces: io (3), mi (1)\n\n## A, B\n- type: set\n- members: A | B\n\n## quel cane\n- type: deictic\n- labels: quel cane\n- surfaces: cane (1)\n- grouped: no\n"
    root = put(tmp_path / "reg", "libro.txt", "# Registry\n\n" + text)
    reg = layers.read_registry(spark, root)
    rows = {r.canonical: r for r in reg.collect()}
    assert rows["Renzo"].labels == ["Renzo", "il poeta"] and [(x.form, x.n) for x in rows["Renzo"].surfaces] == [("io", 3), ("mi", 1)]
    assert rows["A, B"].members == ["A", "B"] and rows["quel cane"].grouped is False
    assert "\n".join(r.b for r in reg.select("ord", sinks.registry_block().alias("b")).orderBy("ord").collect()) == text
    topo = "## selva\n- en: wood\n- surfaces: selva (2), loco (1)\n- runs: 1:1-30, 2:1-4\n\n## (unstated)\n- en: not stated\n- surfaces: -\n- runs: 3:1-9\n"
    t = layers.read_topography(spark, put(tmp_path / "topo", "libro.txt", topo))
    assert [(x.canto, x.ls, x.le) for x in t.where("region_id = 'selva'").first().runs] == [(1, 1, 30), (2, 1, 4)]
    assert "\n".join(r.b for r in t.select("ord", sinks.topography_block().alias("b")).orderBy("ord").collect()) == topo


def test_small_files(spark, tmp_path):
    d = str(tmp_path)
    put(tmp_path, "aliases.txt", "# c\nMosca = il Mosca\na = b = c\n")
    assert {(r.alias, r.canonical) for r in layers.read_aliases(spark, f"{d}/aliases.txt").collect()} == {("Mosca", "il Mosca"), ("a", "b = c")}
    put(tmp_path, "types.txt", "a = b = class\nx = generic\nx = individual\n")
    assert {(r.label, r.type) for r in layers.read_types(spark, f"{d}/types.txt").collect()} == {("a = b", "class"), ("x", "individual")}
    put(tmp_path, "w.clusters.txt", "1:0 selva = r1\n1:1 lo scoglio = r2\n1:1 lo scoglio = r3\n")
    assert {(r.canto, r.occ, r.region_key) for r in layers.read_walk_cache(spark, f"{d}/w.clusters.txt").collect()} == {(1, 0, "r1"), (1, 1, "r3")}
    put(tmp_path / "sc", "libro/01.json", '{"canto_title": "T", "scenes": [{"start_line": 4, "end_line": 6, "scene_name": "b", "summary": "y"}, {"start_line": 1, "end_line": 3, "scene_name": "a", "summary": "x"}]}')
    assert [(r.s, r.scene_name) for r in layers.read_scenes(spark, f"{d}/sc").collect()] == [(1, "a"), (4, "b")]
    put(tmp_path / "m", "libro/01.txt", "[io] vado\n\n  \n{Renzo} va\n")
    assert [(r.line, r.marked) for r in layers.read_markup(spark, f"{d}/m").collect()] == [(1, "[io] vado"), (2, "{Renzo} va")]
    put(tmp_path / "kg", "libro/edges.jsonl", '{"canto": 1, "scene": [1, 3], "subj": {"tag": 1, "name": "Renzo", "node": null}, "predicate": "meets", "obj": {"tag": 2, "name": "X", "node": "X"}, "frame": "literal", "lines": [2, 3], "asserter": null}\n')
    e = layers.read_kg(spark, f"{d}/kg", "edges").first()
    assert (e.canticle, e.subj.name, e.subj.node, e.lines) == ("libro", "Renzo", None, [2, 3])


def test_lock_round_trip(spark, tmp_path):
    rows = [
        ("libro", 1, 0, "1-3", 'a "title"', "selva", None, ["x"], [("Renzo", "present")], [("q", "1-2", "Renzo", "(none)", "none")], [], [("a", "meets", "b", "1-1")], [("2-3", "come \\ v")], "1-3"),
        ("libro", 1, 1, "4-6", "t\tb", None, "r", [], [], [], [("p", 4, "P")], [], [], "4-6"),
    ]
    df = spark.createDataFrame(rows, layers.LOCK_SCHEMA)
    text = sinks.lock_toml(df).first().toml
    doc = tomllib.loads(text)
    assert doc["canticle"] == "libro" and doc["scene"][0]["title"] == 'a "title"' and doc["scene"][1]["cast"] == [] and doc["scene"][1]["location"] == ""
    put(tmp_path / "k", "libro/01.toml", text)
    back = [r.asDict(recursive=True) for r in layers.read_lock(spark, str(tmp_path / "k")).orderBy("ord").collect()]
    want = [r.asDict(recursive=True) for r in df.orderBy("ord").collect()]
    for w in want:
        w["location"], w["region"] = w["location"] or "", w["region"] or ""
    assert back == want


def test_units_resume(spark, tmp_path):
    work = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "canticle string, canto int")
    done = spark.createDataFrame([("a", 1, "x"), ("a", 2, "  ")], "canticle string, canto int, body string")
    keys = ["canticle", "canto"]
    assert {tuple(r) for r in sinks.unfinished(work, done, keys).collect()} == {("b", 1)}
    assert {tuple(r) for r in sinks.unfinished(work, done, keys, "body").collect()} == {("a", 2), ("b", 1)}
    p = str(tmp_path / "u")
    sinks.write_units(done, p)
    sinks.write_units(spark.createDataFrame([("a", 2, "y")], done.schema), p)
    assert {(r.canto, r.body) for r in spark.read.parquet(p).collect()} == {(1, "x"), (2, "y")}
    log = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "k int, v string, ord int")
    assert {(r.k, r.v) for r in sinks.compact_decisions(log, ["k"], "ord").collect()} == {(1, "b"), (2, "c")}


def test_ingest_reads_each_file_once(spark, tmp_path):
    src, dst, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    spark.range(5).write.parquet(f"{src}/a")
    ingest.ingest(spark, src, "id long", dst, chk)
    spark.range(5, 8).write.parquet(f"{src}/b")
    ingest.ingest(spark, src, "id long", dst, chk)
    assert sorted(r.id for r in spark.read.parquet(dst).collect()) == list(range(8))


def test_carried_regions(spark, tmp_path):
    src = str(tmp_path / "ev")
    for i, part in enumerate(([(1, 1, "a"), (1, 2, "a"), (2, 1, "b")], [(1, 3, "b"), (1, 4, "a"), (2, 2, "b")])):
        spark.createDataFrame(part, "u long, t long, s string").coalesce(1).write.parquet(f"{src}/{i}")
    s = spark.readStream.schema("u long, t long, s string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    q = ingest.carried_regions(s, "u", "t", "s").writeStream.format("memory").queryName("regions_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.u, r.t): r.region_no for r in spark.table("regions_out").collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (2, 1): 1, (1, 3): 2, (1, 4): 3, (2, 2): 1}


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "w")
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' k union all select timestamp'2024-01-01 00:20:00', 'a' union all select timestamp'2024-01-01 02:20:00', 'b'").write.parquet(src)
    s = spark.readStream.schema("ts timestamp, k string").parquet(src)
    q = ingest.windowed_counts(s, "ts", "k").writeStream.format("memory").queryName("windows_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.n) for r in spark.table("windows_out").select("k", F.col("n")).collect()} == {("a", 2), ("b", 1)}
