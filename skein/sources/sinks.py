"""Writers of the text layers. Rendering is Column expressions; files are written by Spark, one task a unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V


def write_units(df: DataFrame, path: str, keys: tuple[str, ...] = ("canticle", "canto")) -> None:
    """Rewrites the partitions of the units in ``df`` and leaves the others alone."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def unfinished(work: DataFrame, done: DataFrame, keys: list[str], body: str | None = None) -> DataFrame:
    """Work without a finished unit; with ``body``, an empty one does not count as finished."""
    finished = done if body is None else done.where(F.trim(F.coalesce(body, F.lit(""))) != "")
    return work.join(finished.select(*keys).distinct(), keys, "left_anti")


def write_text(df: DataFrame, path: str, text: str, keys: tuple[str, ...] = ("canticle",)) -> None:
    df.select(*keys, F.col(text).alias("value")).repartition(*keys).write.mode("overwrite").partitionBy(*keys).text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_decisions(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def compact_decisions(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last decision."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*")


def scene_block(s: Column, e: Column, name: Column, body: Column) -> Column:
    return F.concat(F.lit("## Scene "), s, F.lit("-"), e, F.lit(": "), name, F.lit("\n"), body, F.lit("\n"))


def counted(c: Column) -> Column:
    """Structs (form, n) as ``form (n), form (n)``."""
    return F.array_join(F.transform(c, lambda x: F.concat(x["form"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")


def registry_block() -> Column:
    """A ``## canonical`` section from canonical, type, labels, surfaces, members, grouped."""
    head = F.concat(F.lit("## "), "canonical", F.lit("\n- type: "))
    sets = F.concat(head, F.lit("set\n- members: "), F.array_join("members", " | "), F.lit("\n"))
    plain = F.concat(head, F.coalesce("type", F.lit(V.UNTYPED)), F.lit("\n- labels: "), F.array_join("labels", " | "), F.lit("\n- surfaces: "), counted(F.col("surfaces")), F.when(F.col("grouped"), "\n").otherwise("\n- grouped: no\n"))
    return F.when(F.size("members") > 0, sets).otherwise(plain)


def topography_block() -> Column:
    """A ``## region`` section from region_id, en, surfaces, runs."""
    runs = F.array_join(F.transform("runs", lambda r: F.concat(r["canto"].cast("string"), F.lit(":"), r["ls"].cast("string"), F.lit("-"), r["le"].cast("string"))), ", ")
    plain = F.concat(F.lit("## "), "region_id", F.lit("\n- en: "), F.coalesce("en", F.lit("-")), F.lit("\n- surfaces: "), counted(F.col("surfaces")), F.lit("\n- runs: "), runs, F.lit("\n"))
    bare = F.concat(F.lit("## "), "region_id", F.lit("\n- en: not stated\n- surfaces: -\n- runs: "), runs, F.lit("\n"))
    return F.when(F.col("region_id") == V.UNSTATED, bare).otherwise(plain)


def cohort_block() -> Column:
    """A ``## region`` section from region_id, en and cohorts (form, n)."""
    return F.concat(F.lit("## "), "region_id", F.lit("\n- en: "), F.coalesce("en", F.lit("-")), F.lit("\n- cohort: "), F.when(F.size("cohorts") > 0, counted(F.col("cohorts"))).otherwise(V.NO_ADDRESSEE), F.lit("\n"))


def speech_line() -> Column:
    flags = F.when(F.size("flags") > 0, F.array_join("flags", ", ")).otherwise("-")
    return F.concat(F.lit("- "), "quote_id", F.lit(" lines "), "start", F.lit("-"), "end", F.lit(" | speaker: "), "speaker", F.lit(" | signal: "), "signal", F.lit(" | flags: "), flags)


def scene_table() -> Column:
    return F.concat(F.lit("| "), "s", F.lit("-"), "e", F.lit(" | "), "scene_name", F.lit(" | "), "summary", F.lit(" |"))


def _quoted(c: Column) -> Column:
    s = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, esc in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        s = F.replace(s, F.lit(raw), F.lit(esc))
    return F.concat(F.lit('"'), s, F.lit('"'))


def _rows(column: str, fields: dict[str, str]) -> Column:
    """``key = [ {..}, ]`` of inline tables, nothing for an empty list."""

    def one(x: Column) -> Column:
        vals = [F.concat(F.lit(f"{n} = "), _quoted(x[n]) if kind == "string" else x[n].cast("string")) for n, kind in fields.items()]
        return F.concat(F.lit("  { "), F.concat_ws(", ", *vals), F.lit(" },\n"))

    return F.when(F.size(column) > 0, F.concat(F.lit(f"{column} = [\n"), F.array_join(F.transform(column, one), ""), F.lit("]\n"))).otherwise("")


def lock_toml(locks: DataFrame) -> DataFrame:
    """(canticle, canto, toml) from rows of the lock schema, scenes in order of ``ord``."""
    empty = F.lit("")
    cohort = F.when(F.size("cohort") > 0, F.concat(F.lit("cohort = ["), F.array_join(F.transform("cohort", _quoted), ", "), F.lit("]\n"))).otherwise("")
    cast = F.when(F.size("cast") > 0, _rows("cast", {"who": "string", "status": "string"})).otherwise("cast = []\n")
    text = F.concat(
        F.lit("[[scene]]\nlines = "), _quoted(F.col("lines")), F.lit("\ntitle = "), _quoted(F.col("title")),
        F.lit("\nlocation = "), _quoted(F.coalesce("location", empty)), F.lit("\nregion = "), _quoted(F.coalesce("region", empty)), F.lit("\n"),
        cohort, cast,
        _rows("speech", dict.fromkeys(("quote_id", "lines", "speaker", "addressee", "source"), "string")),
        _rows("refer", {"phrase": "string", "line": "int", "resolves": "string"}),
        _rows("relations", dict.fromkeys(("subj", "predicate", "obj", "lines"), "string")),
        _rows("simile", dict.fromkeys(("lines", "vehicle"), "string")),
        F.lit("basis = "), _quoted(F.col("basis")), F.lit("\n"),
    )
    g = locks.select("canticle", "canto", "ord", text.alias("t")).groupBy("canticle", "canto").agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("x"))
    head = F.concat(F.lit("canticle = "), _quoted(F.col("canticle")), F.lit("\ncanto = "), F.col("canto").cast("string"), F.lit("\n\n"))
    return g.select("canticle", "canto", F.concat(head, F.array_join(F.transform("x", lambda v: v["t"]), "\n")).alias("toml"))


def write_files(units: DataFrame, root: str, text: str = "text", keys: tuple[str, str] = ("canticle", "canto"), suffix: str = "txt") -> None:
    """``<root>/<canticle>/NN.<suffix>``, one whole file a row, in place of the one there; other files stay.

    Spark writes a folder a unit beside ``root``; the files then take their names (as many renames as units).
    """
    spark = units.sparkSession
    big, small = keys
    draft = f"{root.rstrip('/')}.draft"
    value = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n$", "")
    units.select(big, small, value.alias("value")).repartition(big, small).write.mode("overwrite").partitionBy(big, small).text(draft)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(draft).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path(f"{draft}/{big}=*/{small}=*/part-*"))
    for f in found:
        folder = f.getPath().getParent()
        unit, no = folder.getParent().getName().split("=", 1)[1], int(folder.getName().split("=", 1)[1])
        to = path(f"{root}/{unit}/{no:02d}.{suffix}")
        fs.mkdirs(to.getParent())
        fs.delete(to, False)
        if not fs.rename(f.getPath(), to):
            raise OSError(f"cannot write {to}")
    fs.delete(path(draft), True)


def join_lines(rows: DataFrame, keys: list[str], line: Column, order: str = "ord", sep: str = "\n") -> DataFrame:
    """(keys, text): the lines of each unit in order."""
    g = rows.select(*keys, F.struct(F.col(order).alias("o"), line.alias("l")).alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return g.select(*keys, F.array_join(F.transform("x", lambda x: x["l"]), sep).alias("text"))


def write_lines(rows: DataFrame, root: str, line: Column, order: str = "ord") -> None:
    """A layer of plain lines (speech, relations), a file a unit."""
    write_files(join_lines(rows, ["canticle", "canto"], line, order), root)


def write_scene_blocks(scenes: DataFrame, rows: DataFrame, root: str, line: Column, order: str = "ord", recap: DataFrame | None = None) -> None:
    """A layer of scene blocks: ``scenes`` (canticle, canto, s, e, name) each with the lines of its ``rows``, empty ones too.

    ``recap`` (canticle, canto, recap) follows the blocks. Units of ``scenes`` are rewritten whole, in order of the lines.
    """
    scene = ["canticle", "canto", "s", "e"]
    body = join_lines(rows, scene, line, order)
    blocks = scenes.join(body, scene, "left").select(*scene, scene_block(F.col("s").cast("string"), F.col("e").cast("string"), F.col("name"), F.coalesce("text", F.lit(""))).alias("block"))
    units = join_lines(blocks, ["canticle", "canto"], F.col("block"), order="s")
    if recap is not None:
        units = units.join(recap, ["canticle", "canto"], "left").withColumn("text", F.concat("text", F.when(F.coalesce("recap", F.lit("")) != "", F.concat(F.lit("\n# recap\n"), "recap", F.lit("\n"))).otherwise("")))
    write_files(units, root)


def restore(existing: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """Finished blocks that were not made anew, and the new ones."""
    return existing.join(made.select(*keys).distinct(), keys, "left_anti").unionByName(made, allowMissingColumns=True)


def write_sections(rows: DataFrame, root: str, block: Column, order: str = "ord") -> None:
    """``<root>/<canticle>.txt`` of ``## head`` sections in order (registry, topography, cohort rollup)."""
    text = join_lines(rows, ["canticle"], block, order)
    spark = rows.sparkSession
    draft = f"{root.rstrip('/')}.draft"
    text.select("canticle", F.regexp_replace("text", r"\n$", "").alias("value")).repartition("canticle").write.mode("overwrite").partitionBy("canticle").text(draft)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(draft).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(root))
    for f in fs.globStatus(path(f"{draft}/canticle=*/part-*")):
        to = path(f"{root}/{f.getPath().getParent().getName().split('=', 1)[1]}.txt")
        fs.delete(to, False)
        if not fs.rename(f.getPath(), to):
            raise OSError(f"cannot write {to}")
    fs.delete(path(draft), True)


def scene_json(scenes: DataFrame) -> DataFrame:
    """(canticle, canto, text): the scene layer's JSON from (canto_title, s, e, scene_name, summary), in order of the lines."""
    one = F.struct(F.col("s").alias("start_line"), F.col("e").alias("end_line"), "scene_name", "summary")
    g = scenes.groupBy("canticle", "canto").agg(F.first("canto_title").alias("canto_title"), F.array_sort(F.collect_list(one)).alias("scenes"))
    return g.select("canticle", "canto", F.to_json(F.struct("canto_title", "scenes")).alias("text"))


def scene_page(scenes: DataFrame) -> DataFrame:
    """(canticle, canto, text): the scenes of a unit as a pipe table under its title."""
    body = join_lines(scenes, ["canticle", "canto"], scene_table(), order="s")
    title = scenes.groupBy("canticle", "canto").agg(F.first("canto_title").alias("t"))
    head = F.concat(F.lit("# "), "t", F.lit("\n\n| lines | scene | summary |\n|-|-|-|\n"))
    return body.join(title, ["canticle", "canto"]).select("canticle", "canto", F.concat(head, "text").alias("text"))


def write_locks(locks: DataFrame, root: str) -> None:
    """``<root>/<canticle>/NN.toml``."""
    write_files(lock_toml(locks), root, text="toml", suffix="toml")
