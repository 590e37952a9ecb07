"""Readers of the text layers: scene blocks, key-value blocks, line formats, JSON, JSONL, TOML.

Files are ``<root>/<canticle>/NN.txt``. Each reader lists files with Spark, so any store that Spark reads will do,
and carries ``ord``, the place of a row in its file, since order decides ties downstream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

_UNIT = r"([^/]+)/(\d+)\.\w+$"


def _files(spark: SparkSession, root: str, suffix: str = "txt") -> DataFrame:
    """(canticle, canto, value): whole files, by partition directory."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"[0-9][0-9].{suffix}").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(path, _UNIT, 1).alias("canticle"), F.regexp_extract(path, _UNIT, 2).cast("int").alias("canto"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))


def available_cantos(spark: SparkSession, root: str, suffix: str = "txt") -> DataFrame:
    """(canticle, canto) in order, one for each file."""
    return _files(spark, root, suffix).select("canticle", "canto").orderBy("canticle", "canto")


def read_markup(spark: SparkSession, root: str) -> DataFrame:
    """(canticle, canto, line, marked): blank lines dropped, the others numbered from 1."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    return _files(spark, root).select("canticle", "canto", F.posexplode(lines).alias("line", "marked")).withColumn("line", F.col("line") + 1)


def read_recaps(spark: SparkSession, root: str) -> DataFrame:
    """(canticle, canto, recap): the block after ``# recap``, blank lines dropped, empty where there is none."""
    body = F.regexp_extract("value", r"(?s)(?:^|\n)[ \t]*# recap[ \t]*\n(.*)$", 1)
    return _files(spark, root).select("canticle", "canto", F.array_join(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), "\n").alias("recap"))


def scene_blocks(spark: SparkSession, root: str) -> DataFrame:
    """(canticle, canto, s, e, body, block): files cut at ``## Scene s-e:``, the recap left out."""
    kept = F.split_part(F.concat("value", F.lit("\n")), F.lit("# recap\n"), F.lit(1))
    b = _files(spark, root).select("canticle", "canto", F.explode(F.split(kept, r"(?m)(?=^## Scene )")).alias("block"))
    head = r"^## Scene (\d+)-(\d+):"
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    b = b.where(F.col("block").rlike(head)).withColumn("block", trim(F.col("block")))
    body = F.when(F.col("block").contains("\n"), trim(F.regexp_replace("block", r"^[^\n]*\n", ""))).otherwise("")
    return b.select("canticle", "canto", F.regexp_extract("block", head, 1).cast("int").alias("s"), F.regexp_extract("block", head, 2).cast("int").alias("e"), body.alias("body"), "block")


def _lines(blocks: DataFrame, keys: list[str], text: str) -> DataFrame:
    return blocks.select(*keys, F.posexplode(F.split(text, "\n")).alias("ord", "raw"))


def _matched(df: DataFrame, keys: list[str], pattern: str, fields: dict[str, str]) -> DataFrame:
    """Rows whose ``raw`` fits the pattern; group i is the i-th field, cast to its type."""
    cols = [F.nullif(F.regexp_extract("raw", pattern, i + 1), F.lit("")).cast(kind).alias(name) if kind != "string" else F.regexp_extract("raw", pattern, i + 1).alias(name) for i, (name, kind) in enumerate(fields.items())]
    return df.where(F.col("raw").rlike(pattern)).select(*keys, "ord", *cols)


def malformed(df: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """The non-blank, non-comment lines that do not fit, for a generator's report."""
    return df.where((F.trim("raw") != "") & ~F.col("raw").startswith("#") & ~F.col("raw").rlike(pattern)).select(*keys, "ord", "raw")


SCENE = ["canticle", "canto", "s", "e"]
UNIT = ["canticle", "canto"]
_BASIS = r"basis:\s*(\d+)(?:-(\d+))?\s*$"

#: line formats: fixed values, one for each layer
TAG = r"^\s*(\d+)\.\s+(.*\S)\s*$"
OVERLAY = r"^\s*(\w+)/(\d+)/(\d+)-(\d+)/(\d+)\s*=\s*(.*\S)\s*$"
SPEECH = r"^-\s+(\S+)\s+lines\s+(\d+)-(\d+)\s*\|\s*speaker:\s*(.*\S)\s*\|\s*signal:\s*(\w+)\s*\|\s*flags:\s*(.*\S)\s*$"
RELATION = r"^-\s*\[(\d+)\]\s+(\S+)\s+\[(\d+)\]\s*\|\s*frame:\s*(\w+)\s*\|\s*lines\s+(\d+)-(\d+)\s*$"
LOCATION = r"^-\s*it:\s*(.*?)\s*\|\s*en:\s*(.*?)\s*\|\s*" + _BASIS
PRESENCE = r"^-\s*who:\s*(.*?)\s*\|\s*status:\s*(present|mentioned)\s*\|\s*" + _BASIS
ADDRESSEE = r"^-\s+(\S+)\s+lines\s+(\d+)-(\d+)\s*\|\s*speaker:\s*(.*?)\s*\|\s*addressee:\s*(.*?)\s*\|\s*source:\s*(\w+)\s*\|\s*" + _BASIS
COHORT = r"^-\s*cohort:\s*(.*?)\s*\|\s*source:\s*(\w+)\s*\|\s*" + _BASIS
DIGEST = r"^(en|ja):\s*(.*\S)\s*$"
WALK = r"^(\d+):(\d+)\s+(.*\S)\s*=\s*(r\d+)\s*$"


def _basis(df: DataFrame) -> DataFrame:
    return df.withColumn("basis_end", F.coalesce("basis_end", "basis_start"))


def _flags(c: Column) -> Column:
    return F.when(F.trim(c) == "-", F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def read_tags(spark: SparkSession, root: str, overlay: DataFrame | None = None) -> DataFrame:
    """(scene, tag_no, label), corrected by an overlay if one is given."""
    t = _matched(_lines(scene_blocks(spark, root), SCENE, "body"), SCENE, TAG, {"tag_no": "int", "label": "string"})
    if overlay is None:
        return t
    keys = [*SCENE, "tag_no"]
    return t.join(overlay.select(*keys, F.col("label").alias("_new")), keys, "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    """(scene, tag_no, label): comments skipped, the last line of a key wins."""
    df = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "raw")).where(~F.ltrim("raw").startswith("#"))
    o = _matched(df, [], OVERLAY, {"canticle": "string", "canto": "int", "s": "int", "e": "int", "tag_no": "int", "label": "string"})
    return o.groupBy(*SCENE, "tag_no").agg(F.max_by("label", "ord").alias("label"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical): split at the first `` = ``."""
    df = spark.read.text(path).select(F.trim("value").alias("raw")).where((F.col("raw") != "") & ~F.col("raw").startswith("#"))
    p = F.split("raw", " = ", 2)
    return df.select(F.trim(F.get(p, F.lit(0))).alias("alias"), F.trim(F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("canonical"))


def read_types(spark: SparkSession, path: str) -> DataFrame:
    """(label, type): split at the last `` = ``, the last line of a label wins."""
    df = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "raw"))
    t = _matched(df, [], r"^(.*) = (.*)$", {"label": "string", "type": "string"}).withColumn("label", F.trim("label"))
    return t.groupBy("label").agg(F.trim(F.max_by("type", "ord")).alias("type"))


def read_speech(spark: SparkSession, root: str) -> DataFrame:
    d = _matched(_lines(_files(spark, root), UNIT, "value"), UNIT, SPEECH, {"quote_id": "string", "start": "int", "end": "int", "speaker": "string", "signal": "string", "flags": "string"})
    return d.withColumn("flags", _flags(F.col("flags")))


def read_relations(spark: SparkSession, root: str) -> DataFrame:
    return _matched(_lines(_files(spark, root), UNIT, "value"), UNIT, RELATION, {"subj": "int", "predicate": "string", "obj": "int", "frame": "string", "start": "int", "end": "int"})


def read_locations(spark: SparkSession, root: str) -> DataFrame:
    """Rows in order of a scene; a carried setting (``-``) has a null ``it``."""
    d = _basis(_matched(_lines(scene_blocks(spark, root), SCENE, "body"), SCENE, LOCATION, {"it": "string", "en": "string", "basis_start": "int", "basis_end": "int"}))
    return d.withColumn("it", F.nullif("it", F.lit("-")))


def read_presence(spark: SparkSession, root: str) -> DataFrame:
    return _basis(_matched(_lines(scene_blocks(spark, root), SCENE, "body"), SCENE, PRESENCE, {"who": "string", "status": "string", "basis_start": "int", "basis_end": "int"}))


def read_addressee(spark: SparkSession, root: str) -> DataFrame:
    return _basis(_matched(_lines(scene_blocks(spark, root), SCENE, "body"), SCENE, ADDRESSEE, {"quote_id": "string", "start": "int", "end": "int", "speaker": "string", "addressee": "string", "source": "string", "basis_start": "int", "basis_end": "int"}))


def read_cohort(spark: SparkSession, root: str) -> DataFrame:
    """Rows decided to be none are left out."""
    d = _basis(_matched(_lines(scene_blocks(spark, root), SCENE, "body"), SCENE, COHORT, {"cohort": "string", "source": "string", "basis_start": "int", "basis_end": "int"}))
    return d.where("source <> 'none'")


def read_digest(spark: SparkSession, root: str) -> DataFrame:
    """(scene, en, ja): a missing language is empty; the last line of a language wins."""
    blocks = scene_blocks(spark, root)
    d = _matched(_lines(blocks, SCENE, "body"), SCENE, DIGEST, {"lang": "string", "text": "string"})
    pick = lambda k: F.max_by(F.when(F.col("lang") == k, F.col("text")), F.when(F.col("lang") == k, F.col("ord"))).alias(k)
    g = d.groupBy(*SCENE).agg(pick("en"), pick("ja"))
    return blocks.select(*SCENE).distinct().join(g, SCENE, "left").select(*SCENE, *[F.coalesce(k, F.lit("")).alias(k) for k in ("en", "ja")])


def _sections(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(canticle, ord, head, fields): ``## head`` sections with ``- key: value`` lines; later keys win."""
    df = spark.read.option("pathGlobFilter", glob).text(root, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.\w+$", 1).alias("canticle"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    b = df.select("canticle", F.posexplode(F.split("value", r"(?m)(?=^## )")).alias("ord", "block")).where(F.col("block").rlike(r"^##\s+\S"))
    kv = F.transform(
        F.filter(F.split("block", "\n"), lambda x: x.rlike(r"^-\s+\w+:")),
        lambda x: F.struct(F.regexp_extract(x, r"^-\s+(\w+):\s*(.*)$", 1).alias("k"), F.trim(F.regexp_extract(x, r"^-\s+(\w+):\s*(.*)$", 2)).alias("v")),
    )
    return b.select("canticle", "ord", F.regexp_extract("block", r"^##\s+(.*\S)\s*", 1).alias("head"), kv.alias("kv"))


def _field(key: str) -> Column:
    return F.try_element_at(F.transform(F.filter("kv", lambda x: x["k"] == key), lambda x: x["v"]), F.lit(-1))


def _list(c: Column, sep: str) -> Column:
    return F.coalesce(F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def _counted(c: Column) -> Column:
    """``form (n), form (n)`` as structs."""
    p = r"^(.*\S)\s+\((\d+)\)$"
    return F.transform(F.filter(_list(c, ","), lambda x: x.rlike(p)), lambda x: F.struct(F.regexp_extract(x, p, 1).alias("form"), F.regexp_extract(x, p, 2).cast("int").alias("n")))


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """(canticle, ord, canonical, type, labels, surfaces, members, grouped)."""
    s = _sections(spark, root)
    grouped = F.coalesce(F.lower(_field("grouped")) != "no", F.lit(True))
    return s.select("canticle", "ord", F.col("head").alias("canonical"), _field("type").alias("type"), _list(_field("labels"), r"\|").alias("labels"), _counted(_field("surfaces")).alias("surfaces"), _list(_field("members"), r"\|").alias("members"), grouped.alias("grouped"))


def read_topography(spark: SparkSession, root: str) -> DataFrame:
    """(canticle, ord, region_id, en, surfaces, runs)."""
    p = r"^(\d+):(\d+)-(\d+)$"
    runs = F.transform(F.filter(_list(_field("runs"), ","), lambda x: x.rlike(p)), lambda x: F.struct(*[F.regexp_extract(x, p, i + 1).cast("int").alias(n) for i, n in enumerate(("canto", "ls", "le"))]))
    s = _sections(spark, root)
    return s.select("canticle", "ord", F.col("head").alias("region_id"), _field("en").alias("en"), _counted(_field("surfaces")).alias("surfaces"), runs.alias("runs"))


def read_walk_cache(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "raw"))
    w = _matched(df, [], WALK, {"canto": "int", "occ": "int", "surface": "string", "region_key": "string"})
    return w.groupBy("canto", "occ").agg(F.max_by("surface", "ord").alias("surface"), F.max_by("region_key", "ord").alias("region_key"))


def read_scenes(spark: SparkSession, root: str) -> DataFrame:
    """(canticle, canto, canto_title, s, e, scene_name, summary), in order of the lines."""
    kind = "canto_title string, scenes array<struct<start_line:int, end_line:int, scene_name:string, summary:string>>"
    df = _files(spark, root, "json").withColumn("j", F.from_json("value", kind))
    x = df.select("canticle", "canto", F.col("j.canto_title").alias("canto_title"), F.explode("j.scenes").alias("x"))
    return x.select("canticle", "canto", "canto_title", F.col("x.start_line").alias("s"), F.col("x.end_line").alias("e"), F.col("x.scene_name").alias("scene_name"), F.col("x.summary").alias("summary")).orderBy("canticle", "canto", "s", "e", "scene_name")


_END = "struct<tag:int, name:string, node:string>"
KG_SCHEMAS = {
    "nodes": "id string, type string, members array<string>",
    "edges": f"canto int, scene array<int>, subj {_END}, predicate string, obj {_END}, frame string, lines array<int>, asserter string",
    "speech_edges": "canto int, quote_id string, lines array<int>, speaker string, signal string, flags array<string>",
}


def read_kg(spark: SparkSession, root: str, part: str) -> DataFrame:
    """One part of the graph, JSON lines in ``<root>/<canticle>/<part>.jsonl``."""
    df = spark.read.schema(KG_SCHEMAS[part]).option("recursiveFileLookup", "true").option("pathGlobFilter", f"{part}.jsonl").json(root)
    return df.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("canticle"), *[c for c in df.columns])


LOCK_LISTS = ("cohort", "cast", "speech", "refer", "relations", "simile")
LOCK_SCHEMA = (
    "canticle string, canto int, ord int, lines string, title string, location string, region string, cohort array<string>, "
    "cast array<struct<who:string, status:string>>, "
    "speech array<struct<quote_id:string, lines:string, speaker:string, addressee:string, source:string>>, "
    "refer array<struct<phrase:string, line:int, resolves:string>>, "
    "relations array<struct<subj:string, predicate:string, obj:string, lines:string>>, "
    "simile array<struct<lines:string, vehicle:string>>, basis string"
)


def read_lock(spark: SparkSession, root: str) -> DataFrame:
    """One row a scene of the TOML lock; Spark has no TOML reader, so files are parsed in Arrow batches."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tomllib

        names = ["canticle", "canto", "ord", "lines", "title", "location", "region", *LOCK_LISTS, "basis"]
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                doc = tomllib.loads(text)
                for i, sc in enumerate(doc.get("scene", [])):
                    rows.append([doc["canticle"], doc["canto"], i] + [sc.get(n, [] if n in LOCK_LISTS else None) for n in names[3:]])
            yield pd.DataFrame(rows, columns=names)

    return _files(spark, root, "toml").select("value").mapInPandas(parse, LOCK_SCHEMA)


def digest_of(labels: Column) -> Column:
    """Content hash of a unit, to find what an incremental run must do again."""
    return F.sha2(F.array_join(F.transform(labels, T.norm_label), "\n"), 256)
