import json
import random

from skein.__main__ import main
from skein.operators import views


def put(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")
    return str(root)


def test_digest_view(spark):
    rng = random.Random(5)
    scenes, lock, digest, want = [], [], [], {}
    for canto in range(1, 5):
        lines, group, last = [f"# Canto {canto:02d} — T{canto}"], [], object()
        said = {}
        for s in range(1, 25):
            at = rng.choice(("wood", "hill", None)) if s % 3 == 0 or s == 1 else at  # noqa: F821
            scenes.append(("libro", canto, f"T{canto}", s, s + 1, f"n{s}", ""))
            if at or rng.random() < 0.5:
                lock.append(("libro", canto, f"{s}-{s + 1}", at))
            if rng.random() < 0.8:
                said[s] = (f"E{s}.", rng.choice(("", f"J{s}。")))
                digest.append(("libro", canto, s, s + 1, *said[s]))
            if group and (at != last or len(group[-1]) >= 5):
                group.append([])
            group = group or [[]]
            group[-1].append(s)
            last = at
        for g in group:
            lines += ["", *[x for i in range(2) if (x := " ".join(said[s][i] for s in g if s in said and said[s][i]))]]
        want[canto] = "\n".join(lines)
    sc = spark.createDataFrame(scenes, "canticle string, canto int, canto_title string, s int, e int, scene_name string, summary string")
    lk = spark.createDataFrame(lock, "canticle string, canto int, lines string, location string")
    dg = spark.createDataFrame(digest, "canticle string, canto int, s int, e int, en string, ja string")
    assert {r.canto: r.text for r in views.digest_view(dg, sc, lk).collect()} == want
    only = views.digest_view(dg, sc, lk, ("en",)).collect()
    assert all("。" not in r.text for r in only) and views.digest_view(dg, sc.limit(0), lk).count() == 0


def test_show(spark, tmp_path, capsys):
    tags = "# Canto 01\n\n## Scene 1-3: first\n1. Renzo\n"
    root = put(tmp_path / "tags", "libro/01.txt", tags)
    put(tmp_path / "tags", "libro/02.txt", "## Scene 1-2: x\n1. Lucia\n")
    assert main(["show", "tags", root, "-c", "1"]) == 0 and capsys.readouterr().out == tags
    assert main(["show", "tags", root, "-c", "2", "--rows"]) == 0 and json.loads(capsys.readouterr().out)["label"] == "Lucia"
    assert main(["show", "tags", root, "-c", "9"]) == 1 and main(["show", "tags", str(tmp_path / "none")]) == 1
    reg = "## Renzo\n- type: individual\n"
    assert main(["show", "registry", put(tmp_path / "reg", "libro.txt", reg), "-u", "libro"]) == 0 and capsys.readouterr().out == reg
    edge = '{"canto":1,"predicate":"meets"}\n'
    kg = put(tmp_path / "kg", "libro/edges.jsonl", edge)
    assert main(["show", "kg", kg]) == 0 and capsys.readouterr().out == edge
    assert main(["show", "kg", kg, "--part", "nodes"]) == 1
    sc = put(tmp_path / "sc", "libro/01.json", json.dumps({"canto_title": "Wood", "scenes": [{"start_line": 4, "end_line": 6, "scene_name": "b", "summary": ""}, {"start_line": 1, "end_line": 3, "scene_name": "a", "summary": "Walks."}]}))
    capsys.readouterr()
    assert main(["show", "scenes", sc]) == 0
    assert capsys.readouterr().out == "# Canto 01 — Wood\n\n## Scene 1-3: a\nWalks.\n\n## Scene 4-6: b\n"
    dg = put(tmp_path / "dg", "libro/01.txt", "## Scene 1-3: a\nen: One.\nja: 一。\n\n## Scene 4-6: b\nen: Two.\n")
    lk = put(tmp_path / "lk", "libro/01.toml", 'canticle = "libro"\ncanto = 1\n\n[[scene]]\nlines = "1-3"\nlocation = "wood"\n\n[[scene]]\nlines = "4-6"\nlocation = "wood"\n')
    assert main(["show", "digest", dg, "--scenes", sc, "--lock", lk]) == 0
    assert capsys.readouterr().out == "# Canto 01 — Wood\n\nOne. Two.\n一。\n"
