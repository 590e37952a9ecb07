"""Line grammars of model replies: parsed rows, and the lines that look like rows but do not fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import vocab as V


@dataclass(frozen=True)
class Grammar:
    line: str
    prefix: str | None
    fields: tuple[tuple[str, str], ...]
    ends: tuple[tuple[str, str], ...] = ()  # an end left out is its start
    by: str | None = None  # rows are one a value of this field: ``keep`` says which
    keep: str = "all"


_BASIS = r"basis:\s*(\d+)(?:-(\d+))?\s*$"
_RANGE = (("basis_start", "int"), ("basis_end", "int"))
_TO = (("basis_end", "basis_start"),)

#: reply lines: fixed values, one grammar for each pass
GRAMMARS = {
    "tags": Grammar(r"^\s*(\d+)\.\s+(.*\S)\s*$", None, (("tag_no", "int"), ("label", "string")), by="tag_no", keep="last"),
    "types": Grammar(r"^\s*(\d+)\.\s+(.*\S)\s*=\s*([a-z-]+)\s*$", None, (("no", "int"), ("label", "string"), ("type", "string")), by="no", keep="last"),
    "coref": Grammar(r"^\s*(.*\S)\s*=\s*(.*\S)\s*$", None, (("label", "string"), ("pick", "string")), keep="first"),
    "relations": Grammar(r"^-\s*\[(\d+)\]\s+(\S+)\s+\[(\d+)\]\s*\|\s*frame:\s*(\w+)\s*\|\s*lines\s+(\d+)(?:-(\d+))?\s*$", r"^-\s*\[", (("subj", "int"), ("predicate", "string"), ("obj", "int"), ("frame", "string"), ("start", "int"), ("end", "int")), (("end", "start"),)),
    "location": Grammar(r"^-\s*it:\s*(.*?)\s*\|\s*en:\s*(.*?)\s*\|\s*" + _BASIS, r"^-\s+\S", (("it", "string"), ("en", "string"), *_RANGE), _TO),
    "walk": Grammar(r"(?i)^\s*(\d+)\.\s+(.*\S)\s*=\s*(same|new)\s*$", None, (("no", "int"), ("surface", "string"), ("verdict", "string")), by="no", keep="last"),
    "presence": Grammar(r"^-\s*who:\s*(.*?)\s*\|\s*status:\s*(\w+)\s*\|\s*" + _BASIS, r"^-\s+\S", (("who", "string"), ("status", "string"), *_RANGE), _TO),
    "addressee": Grammar(r"^-?\s*addressee:\s*(.*?)\s*\|\s*" + _BASIS, r"^-?\s*addressee:", (("addressee", "string"), *_RANGE), _TO, keep="first"),
    "cohort": Grammar(r"^-?\s*cohort:\s*(.*?)\s*\|\s*" + _BASIS, r"^-?\s*cohort:", (("cohort", "string"), *_RANGE), _TO),
}


def _lines(replies: DataFrame, keys: list[str], reply: str) -> DataFrame:
    return replies.select(*keys, F.posexplode(F.split(reply, r"\R")).alias("ord", "raw"))


def parse(replies: DataFrame, keys: list[str], layer: str, reply: str = "reply") -> DataFrame:
    """(keys, ord, fields) of the lines that fit the layer's grammar; repeated keys as the grammar says (last or first wins)."""
    g = GRAMMARS[layer]
    cols = [F.nullif(F.regexp_extract("raw", g.line, i + 1), F.lit("")).cast(kind).alias(name) if kind == "int" else F.trim(F.regexp_extract("raw", g.line, i + 1)).alias(name) for i, (name, kind) in enumerate(g.fields)]
    out = _lines(replies, keys, reply).where(F.col("raw").rlike(g.line)).select(*keys, "ord", *cols)
    for end, start in g.ends:
        out = out.withColumn(end, F.coalesce(end, start))
    if layer == "tags":
        out = out.withColumn("label", T.fix_elision(F.col("label")))
    if layer == "walk":
        out = out.withColumn("verdict", F.lower("verdict"))
    if g.keep == "all":
        return out
    names = ["ord", *(n for n, _ in g.fields)]
    group = [*keys, *([g.by] if g.by else [])]
    pick = (F.max_by if g.keep == "last" else F.min_by)(F.struct(*names), "ord")
    return out.groupBy(*group).agg(pick.alias("_x")).select(*keys, *[F.col(f"_x.{n}").alias(n) for n in names])


def malformed(replies: DataFrame, keys: list[str], layer: str, reply: str = "reply") -> DataFrame:
    """(keys, ord, raw) of the lines that begin like the layer's but do not fit; none where the grammar has no beginning of its own."""
    g = GRAMMARS[layer]
    bad = F.col("raw").rlike(g.prefix) & ~F.col("raw").rlike(g.line) if g.prefix else F.lit(False)
    return _lines(replies, keys, reply).where(bad).select(*keys, "ord", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("raw"))


def range_of(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), end.cast("string"))


#: the canonical line of a row of each layer
def tag_line() -> Column:
    return F.concat(F.col("tag_no").cast("string"), F.lit(". "), "label")


def relation_line() -> Column:
    return F.concat(F.lit("- ["), F.col("subj").cast("string"), F.lit("] "), "predicate", F.lit(" ["), F.col("obj").cast("string"), F.lit("] | frame: "), "frame", F.lit(" | lines "), range_of(F.col("start"), F.col("end")))


def location_line() -> Column:
    return F.concat(F.lit("- it: "), F.coalesce("it", F.lit(V.CARRIED)), F.lit(" | en: "), "en", F.lit(" | basis: "), range_of(F.col("basis_start"), F.col("basis_end")))


def presence_line() -> Column:
    return F.concat(F.lit("- who: "), "who", F.lit(" | status: "), "status", F.lit(" | basis: "), range_of(F.col("basis_start"), F.col("basis_end")))


def addressee_line() -> Column:
    return F.concat(F.lit("- "), "quote_id", F.lit(" lines "), range_of(F.col("start"), F.col("end")), F.lit(" | speaker: "), "speaker", F.lit(" | addressee: "), "addressee", F.lit(" | source: "), "source", F.lit(" | basis: "), range_of(F.col("basis_start"), F.col("basis_end")))


def cohort_line() -> Column:
    return F.concat(F.lit("- cohort: "), "cohort", F.lit(" | source: "), "source", F.lit(" | basis: "), range_of(F.col("basis_start"), F.col("basis_end")))


def in_roster_order(figures: DataFrame, roster: DataFrame, scene: list[str]) -> DataFrame:
    """Figures as the roster (scene, who, ord) spells and orders them; the first row of a figure wins, others go."""
    f = figures.withColumn("_fold", T.fold_key(F.col("who"))).drop("who")
    rest = [c for c in f.columns if c not in (*scene, "_fold", "ord")]
    f = f.groupBy(*scene, "_fold").agg(F.min_by(F.struct(*rest), "ord").alias("_x"))
    r = roster.select(*scene, "who", "ord").withColumn("_fold", T.fold_key(F.col("who")))
    return r.join(f.hint("merge"), [*scene, "_fold"]).select(*scene, "ord", "who", *[F.col(f"_x.{c}").alias(c) for c in rest])
