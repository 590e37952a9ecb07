import os

import pytest
from pyspark.sql import functions as F

from skein import progress
from skein.operators import lock as L
from skein.sources import layers, toml

ROWS = [
    ("a", 1, 0, "1-3", 'ti"tle', "", "r \\1", ["c1", "c2"], [("Renzo", "present")], [("q1", "1-2", "A", "B", "code")], [("he", 2, "Renzo")], [], [("1-1", "a wolf")], "1-3"),
    ("a", 1, 1, "4-6", "t", "selva\noscura", "", [], [], [], [], [("A", "sees", "B", "4-4")], [], "4-6"),
]


def locks(spark, units):
    from pyspark.sql.types import _parse_datatype_string as kind

    return spark.createDataFrame([(c, n, *r[2:]) for c, n in units for r in ROWS], kind(layers.LOCK_SCHEMA))


def same(a, b):
    key = lambda df: sorted(map(str, df.select(*df.columns).collect()))
    assert key(a) == key(b.select(*a.columns))


def test_a_thousand_units_round_trip(spark, tmp_path):
    root = str(tmp_path / "lock")
    df = locks(spark, [(f"u{i % 11}", i // 11 + 1) for i in range(1000)]).repartition(7)
    toml.write_locks(df, root)
    assert sum(len(f) for _, _, f in os.walk(root)) == 1000 and not [d for d in os.listdir(root) if d.startswith(".")]
    same(toml.read_locks(spark, root), df)
    same(layers.read_lock(spark, f"file://{root}"), df)
    # one unit is rewritten, the others stay
    toml.write_locks(locks(spark, [("u3", 5)]).where("ord = 0"), root)
    assert toml.read_locks(spark, root).count() == 1999


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "lock")
    toml.write_locks(locks(spark, [("a", 1)]), root)
    broken = locks(spark, [("a", 1), ("b", 2), ("c", 3)]).withColumn("canto", F.when(F.col("canticle") == "c", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("canto") + 10))
    with pytest.raises(Exception, match="lost"):
        toml.write_locks(broken.repartition(3), root)
    assert [os.path.join(d, f)[len(root) :] for d, _, fs in os.walk(root) for f in fs] == ["/a/01.toml"]


def test_a_lost_commit_is_finished(spark, tmp_path):
    root = str(tmp_path / "lock")
    w = toml.Writer(root)
    import pyarrow as pa

    unit = [{"canticle": "a", "canto": n, "toml": f'canticle = "a"\ncanto = {n}\n'} for n in (1, 2)]
    told = w.write(iter([pa.RecordBatch.from_pylist(unit)]))
    other = toml.Writer(root)
    other.write(iter([pa.RecordBatch.from_pylist(unit)]))  # never committed
    import json

    with open(f"{root}/{w.run}/files.json", "w") as f:
        json.dump(told.files, f)
    os.makedirs(f"{root}/a")
    os.rename(f"{root}/{told.files[0][0]}", f"{root}/a/01.toml")  # the driver was lost after one
    assert toml.resume_commits(root) == 1
    assert sorted(os.listdir(f"{root}/a")) == ["01.toml", "02.toml"] and os.listdir(root) == ["a"]


def test_lines_go_on_where_they_stopped(spark, tmp_path):
    path = str(tmp_path / "p")
    lines = spark.createDataFrame([("a", i, f"l{i}") for i in range(1, 8)] + [("b", 3, "x"), ("b", 9, "y")], "u string, line int, text string")
    asked = []

    def make(bad):
        def f(todo):
            asked.append(sorted((r["u"], r["line"]) for r in todo.collect()))
            return todo.select("u", "line", F.upper("text").alias("made"), (~F.col("line").isin(*bad)).alias("ok"))

        return f

    assert progress.advance(lines, path, ["u"], make([2]), step=3) == 3  # a: 1, b: 3 and 9
    assert asked[-1] == [("a", 1), ("a", 2), ("a", 3), ("b", 3), ("b", 9)]

    def lost(todo):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        progress.advance(lines, path, ["u"], lost, step=3)
    # a batch without its offsets does not count
    lines.limit(1).select("u", "line", F.lit("stray").alias("made")).write.parquet(f"{path}/lines/batch=1")
    assert progress.accepted(spark, path).count() == 3
    assert progress.run(lines, path, ["u"], make([0]), step=4)
    assert asked[1] == [("a", 2), ("a", 3), ("a", 4), ("a", 5)] and asked[2] == [("a", 6), ("a", 7)] and len(asked) == 3
    got = sorted((r["u"], r["line"], r["made"]) for r in progress.accepted(spark, path).collect())
    assert got == sorted((r["u"], r["line"], r["text"].upper()) for r in lines.collect())
    assert not progress.run(lines.withColumn("line", F.col("line") + 100), str(tmp_path / "q"), ["u"], make([101]), step=1)


def test_layers_of_one_frame_and_of_their_own_assemble_alike(spark):
    scenes = spark.createDataFrame([("I", "a", 1, 1, 9, "t1", "r"), ("I", "b", 2, 10, 19, "t2", "r"), ("I", "c", 3, 20, 29, "t3", "r")], "unit string, scene string, ord int, lo int, hi int, title string, region string")
    locations = spark.createDataFrame([("a", 2, "wood"), ("a", 1, "hill")], "scene string, ord int, it string")
    presence = [("a", 2, "Virgil", "present"), ("a", 1, "Dante", None), ("a", 1, "Anna", "named"), ("a", 3, "Dante", None)]
    cohort = [("a", 1, "souls"), ("a", 1, None), ("b", 5, "souls")]
    speech = [("a", 4, "q1", 3, 4, "Dante", "Virgil", "code")]
    edges = [
        ("a", 1, "he", "Dante", "sees", "wolf", "", "literal", 2, 3), ("a", 2, "he", "Dante", "sees", "wolf", "", "literal", 2, 3),
        ("a", 3, "I", None, "names", "guide", "Virgil", "simile", 5, 5), ("a", 3, "Anna", "Anna", "names", "it", "sea", None, 6, 6),
    ]
    kinds = {
        "presence": "who string, status string", "speech": "quote_id string, start int, end int, speaker string, addressee string, source string", "cohort": "cohort string",
        "edge": "subj_name string, subj_node string, predicate string, obj_name string, obj_node string, frame string, start int, end int",
    }
    rows = dict(zip(kinds, (presence, speech, cohort, edges), strict=True))
    frames = [spark.createDataFrame(rows[k], f"scene string, ord int, {v}") for k, v in kinds.items()]
    apart = {r.scene: r for r in L.assemble(scenes, locations, *frames, ["scene"], ["unit"]).collect()}
    # the same rows in one frame, where a row is in all the layers that have one in its place
    by_place = {}
    for k, v in rows.items():
        for scene, at, *values in v:
            i = sum((scene, at, n) in by_place and k in by_place[scene, at, n] for n in range(9))
            by_place.setdefault((scene, at, i), {})[k] = tuple(values)
    one = spark.createDataFrame([(s, at, *[x.get(k) for k in kinds]) for (s, at, _), x in by_place.items()], "scene string, ord int, " + ", ".join(f"{k} struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in v.split(', '))}>" for k, v in kinds.items()))
    together = {r.scene: r for r in L.assemble_rows(scenes, locations, one, {k: lambda x, k=k: x[k] for k in kinds}, ["scene"], ["unit"]).collect()}
    assert apart == together and one.count() < sum(map(len, rows.values()))
    a = apart["a"]
    assert a.location == "hill" and apart["c"].location == "hill" and a.lines == a.basis == "1-9"
    assert [tuple(x) for x in a.cast] == [("Anna", "named"), ("Dante", None), ("Virgil", "present"), ("Dante", None)] and a.cohort == [None, "souls"]
    assert [tuple(x) for x in a.speech] == [("q1", "3-4", "Dante", "Virgil", "code")]
    assert [tuple(x) for x in a.refer] == [("he", 2, "Dante"), ("guide", 5, "Virgil"), ("it", 6, "sea")]
    assert [tuple(x) for x in a.relations] == [("Dante", "sees", "wolf", "2-3")] and [tuple(x) for x in a.simile] == [("5-5", "Virgil")]
    assert apart["b"].cohort == ["souls"] and [apart["c"][k] for k in ("cohort", "cast", "speech", "refer", "relations", "simile")] == [[]] * 6
