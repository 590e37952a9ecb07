"""One record a scene from all layers. The rows of all layers are gathered per scene in one pass before any join, so no join multiplies rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .intervals import carry, dealt

#: the fields of a row of each layer
LAYERS = {
    "presence": ("who", "status"),
    "speech": ("quote_id", "start", "end", "speaker", "addressee", "source"),
    "cohort": ("cohort",),
    "edge": ("subj_name", "subj_node", "predicate", "obj_name", "obj_node", "frame", "start", "end"),
}


def _lines(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), end.cast("string"))


def _of(rows: Column, layer: Callable[[Column], Column]) -> Column:
    """The rows that a layer has, as (ord, row)."""
    return F.filter(F.transform(rows, lambda x: F.struct(x["ord"].alias("ord"), layer(x).alias("row"))), lambda x: x["row"].isNotNull())


def _told(rows: Column, value: Callable[[Column], Column]) -> Column:
    """Values of (ord, row) in order of ``ord``, equal places by value, repeats kept."""
    return F.transform(F.sort_array(F.transform(rows, lambda x: F.struct(x["ord"].alias("ord"), value(x["row"]).alias("v")))), lambda x: x["v"])


def identities(edges: Column) -> Column:
    """Phrases of a scene's edges (ord, row) whose node is spelt otherwise, with the line, each once, subjects before objects."""
    end = lambda x, i, name: F.struct((x["ord"] * 2 + i).alias("ord"), F.struct(x["row"][f"{name}_name"].alias("phrase"), x["row"]["start"].cast("int").alias("line"), x["row"][f"{name}_node"].alias("resolves")).alias("row"))
    ends = F.flatten(F.transform(edges, lambda x: F.array(end(x, 0, "subj"), end(x, 1, "obj"))))
    said = F.filter(ends, lambda x: (x["row"]["phrase"] != "") & (x["row"]["resolves"] != "") & (x["row"]["phrase"] != x["row"]["resolves"]))
    return F.array_distinct(_told(said, lambda r: r))


def relations(edges: Column) -> tuple[Column, Column]:
    """(relations, simile) of a scene's edges (ord, row): literal edges between parties and the vehicles of similes, each once."""
    party = lambda r, name: T.edge_party(r[f"{name}_node"], r[f"{name}_name"])
    said = lambda r: F.struct(party(r, "subj").alias("subj"), r["predicate"].alias("predicate"), party(r, "obj").alias("obj"), _lines(r["start"], r["end"]).alias("lines"))
    like = lambda r: F.struct(_lines(r["start"], r["end"]).alias("lines"), party(r, "obj").alias("vehicle"))
    of = lambda frame: F.filter(edges, lambda x: x["row"]["frame"] == frame)
    return F.array_distinct(_told(of("literal"), said)), F.array_distinct(_told(of("simile"), like))


def settings(scenes: DataFrame, locations: DataFrame, scene: list[str], unit: list[str], order: str) -> DataFrame:
    """``scenes`` with ``location``: the first place a scene names, else the one carried from the scene before in the unit."""
    first = locations.groupBy(*scene).agg(F.min_by("it", "ord").alias("_it"))
    return scenes.join(dealt(first), scene, "left").withColumn("location", carry(F.col("_it"), unit, [F.col(order)])).drop("_it")


def assemble(scenes: DataFrame, locations: DataFrame, presence: DataFrame, speech: DataFrame, cohort: DataFrame, edges: DataFrame, scene: list[str], unit: list[str], order: str = "ord") -> DataFrame:
    """The lock rows: ``scenes`` (scene, unit, order, lo, hi, title, region) with the lists of every layer, empty where it has none.

    ``locations`` (it), ``presence`` (who, status), ``speech`` (quote_id, start, end, speaker, addressee, source), ``cohort`` (cohort) and
    ``edges`` (subj_name, subj_node, predicate, obj_name, obj_node, frame, start, end) carry the scene and ``ord``, their place in
    it; equal places go by value. Problems of the layers are found by ``checks.check_lock``.
    """
    frames = dict(zip(LAYERS, (presence, speech, cohort, edges), strict=True))
    rows = [df.select(*scene, "ord", F.struct(*LAYERS[name]).alias(name)) for name, df in frames.items()]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
    return assemble_rows(scenes, locations, rows, {name: lambda x, name=name: x[name] for name in LAYERS}, scene, unit, order)


def assemble_rows(scenes: DataFrame, locations: DataFrame, rows: DataFrame, layers: dict[str, Callable[[Column], Column]], scene: list[str], unit: list[str], order: str = "ord") -> DataFrame:
    """``assemble`` where one row may belong to several layers: ``rows`` (scene, ord, any fields) are read, moved and gathered once for all of them.

    Each of ``layers`` makes a struct of its fields (``LAYERS``) from a row, null where the row is not in the layer.
    """
    row = lambda *names: lambda r: F.struct(*[r[n].alias(n) for n in names])
    fields = [c for c in rows.columns if c not in scene]
    told = rows.groupBy(*scene).agg(F.collect_list(F.struct(*fields)).alias("_rows"))
    extra = [c for c in unit if c not in scene]
    out = scenes.select(*scene, *extra, *([order] if order not in scene else []), "title", "region", _lines(F.col("lo"), F.col("hi")).alias("lines"))
    out = settings(out, locations, scene, unit, order)
    rest = out.columns
    # the rows are joined as they were gathered, and the longer lists made of them behind the join
    out = out.join(dealt(told), scene, "left").withColumn("_edges", _of(F.col("_rows"), layers["edge"]))
    of = lambda name, value: _told(_of(F.col("_rows"), layers[name]), value)
    said, like = relations(F.col("_edges"))
    spoken = lambda r: F.struct(r["quote_id"].alias("quote_id"), _lines(r["start"], r["end"]).alias("lines"), *[r[n].alias(n) for n in ("speaker", "addressee", "source")])
    lists = {
        "cohort": of("cohort", lambda r: r["cohort"]),
        "cast": of("presence", row("who", "status")),
        "speech": of("speech", spoken),
        "refer": identities(F.col("_edges")),
        "relations": said,
        "simile": like,
    }
    out = out.select(*rest, *[v.alias(c) for c, v in lists.items()], F.col("lines").alias("basis"))
    empty = {f.name: F.array().cast(f.dataType) for f in out.schema if f.name in lists}
    return out.select(*rest, *[F.coalesce(c, empty[c]).alias(c) for c in lists], "basis")


def licensed_names(locks: DataFrame, sets: DataFrame | None = None, constant: tuple[str, ...] = ()) -> DataFrame:
    """(lock's key columns, names): every name a lock mentions, sentinels left out; with ``sets`` (canonical, member) set members too."""
    names = F.flatten(F.array(
        F.transform("cast", lambda c: c["who"]), F.col("cohort"),
        F.flatten(F.transform("speech", lambda x: F.array(x["speaker"], x["addressee"]))),
        F.flatten(F.transform("refer", lambda x: F.array(x["phrase"], x["resolves"]))),
        F.flatten(F.transform("relations", lambda x: F.array(x["subj"], x["obj"]))),
        F.transform("simile", lambda x: x["vehicle"]), F.array("location", "region"), F.array(*[F.lit(x) for x in constant]).cast("array<string>"),
    ))
    keep = F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "") & (x != "-") & ~x.startswith("(")))
    lists = ("title", "location", "region", "cohort", "cast", "speech", "refer", "relations", "simile", "basis")
    key = [c for c in locks.columns if c not in lists]
    out = locks.select(*key, keep.alias("names"))
    if sets is None:
        return out
    m = out.select(*key, F.explode("names").alias("canonical")).join(sets, "canonical").groupBy(*key).agg(F.collect_set("member").alias("_m"))
    return out.join(m, key, "left").select(*key, F.array_distinct(F.concat("names", F.coalesce("_m", F.array().cast("array<string>")))).alias("names"))


def licensed_words(names: DataFrame) -> DataFrame:
    """Adds ``words``: the lower-cased words of the names."""
    words = F.flatten(F.transform("names", lambda n: F.transform(T.name_tokens(n), F.lower)))
    return names.withColumn("words", F.array_sort(F.array_distinct(words)))
