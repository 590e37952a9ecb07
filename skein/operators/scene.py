"""Quotes, edges, candidates and their routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .intervals import contain_join, dealt, exactly_one


def contains(line: Column, col: Column, s: str = "start_line", sc: str = "start_col", e: str = "end_line", ec: str = "end_col") -> Column:
    """Is a point strictly between a span's markers."""
    at = F.struct(line.alias("l"), col.alias("c"))
    return (at > F.struct(F.col(s).alias("l"), F.col(sc).alias("c"))) & (at < F.struct(F.col(e).alias("l"), F.col(ec).alias("c")))


def walk_spans(spans: DataFrame, unit: list[str], max_depth: int = 32) -> DataFrame:
    """Adds depth and path (ordinals from the root) to spans with quote_id, parent_id and ord.

    One join a level, until a level is empty; deeper trees than ``max_depth`` are an error.
    """
    level = spans.where("parent_id is null").withColumn("depth", F.lit(0)).withColumn("path", F.array("ord"))
    out = level
    for depth in range(1, max_depth + 1):
        up = level.select(*unit, F.col("quote_id").alias("parent_id"), F.col("path").alias("_path"))
        level = spans.join(up, [*unit, "parent_id"]).withColumn("depth", F.lit(depth)).withColumn("path", F.concat("_path", F.array("ord"))).drop("_path")
        if level.isEmpty():
            return out
        out = out.unionByName(level, allowMissingColumns=True)
    raise ValueError(f"spans nested more than {max_depth} deep")


def own_region(points: DataFrame, spans: DataFrame, unit: list[str]) -> DataFrame:
    """Each point with the deepest span that holds it, points in no span dropped. ``spans`` has depth."""
    r = spans.withColumnsRenamed({u: f"_r_{u}" for u in unit})
    cond = contains(F.col("line"), F.col("col"))
    for u in unit:
        cond = cond & (F.col(u) == F.col(f"_r_{u}"))
    j = points.join(r, cond)
    keys = points.columns
    return j.groupBy(*keys).agg(F.max_by("quote_id", F.struct("depth", "quote_id")).alias("quote_id"))


def attribute(referents: DataFrame, span: list[str], forms: dict[str, tuple[str, ...]] = V.FIRST_PERSON) -> DataFrame:
    """(span, speaker, signal, flags): from the first-person surfaces (``surface``) of each span's referents (``who``).

    Spans come from the rows themselves: a span without referents has one row with a null ``who``.
    """
    low = F.lower("surface")
    pick = lambda kind: F.array_sort(F.collect_set(F.when(low.isin(*forms[kind]), F.col("who"))))
    g = referents.groupBy(*span).agg(pick("strong").alias("s"), pick("weak").alias("w"), pick("plural").alias("p"))
    one, weak = F.size("s") == 1, (F.size("s") == 0) & (F.size("w") == 1)
    flags = F.array_compact(
        F.array(
            F.when(F.size("s") > 1, F.concat(F.lit("multi("), F.array_join("s", ";"), F.lit(")"))),
            F.when((F.size("s") == 0) & ~weak & (F.size("p") > 0), "plural"),
        )
    )
    return g.select(*span, F.when(one, F.get("s", F.lit(0))).when(weak, F.get("w", F.lit(0))).otherwise(V.UNATTRIBUTED).alias("speaker"), F.when(one, "strong").when(weak, "weak").otherwise("none").alias("signal"), flags.alias("flags"))


def attribute_spans(spans: DataFrame, referents: DataFrame, scenes: DataFrame, unit: list[str], forms: dict[str, tuple[str, ...]] = V.FIRST_PERSON) -> DataFrame:
    """(unit, quote_id, speaker, signal, flags) of every span: forms count only in a span's own region, outside the spans in it.

    ``spans`` (unit, quote_id, start_line, start_col, end_line, end_col, depth), ``referents`` (unit, line, col, surface, who), ``scenes``
    (unit, scene, lo, hi). A span whose two ends are not in the same scene, or of which only one is in any, is ``cross-scene``.
    """
    low = F.lower("surface")
    told = referents.where(low.isin(*[w for v in forms.values() for w in v])).select(*unit, "line", "col", "surface", "who").distinct()
    own = own_region(told, spans.select(*unit, "quote_id", "start_line", "start_col", "end_line", "end_col", "depth"), unit)
    keys = [*unit, "quote_id"]
    said = attribute(spans.select(*keys).join(own.select(*keys, "surface", "who"), keys, "left"), keys, forms)
    # each end's scene by a look-up of its own; an end in several scenes, as in none, has no scene
    s = scenes.select(*unit, "scene", "lo", "hi")
    ends = spans.select(*keys, F.explode(F.array("start_line", "end_line")).alias("at")).distinct()
    hit = exactly_one(contain_join(ends, s, unit, ("at", "at"), ("lo", "hi")), [*keys, "at"], "scene", "scene").drop("n_hits")
    both = spans.select(*keys, "start_line", "end_line")
    for end in ("start_line", "end_line"):
        both = both.join(hit.withColumnsRenamed({"at": end, "scene": f"_{end}"}), [*keys, end], "left")
    crosses = F.when(~F.col("_start_line").eqNullSafe(F.col("_end_line")), F.array(F.lit("cross-scene"))).otherwise(F.array().cast("array<string>"))
    out = said.join(both.select(*keys, crosses.alias("_cross")), keys)
    return out.select(*keys, "speaker", "signal", F.concat("flags", "_cross").alias("flags"))


def resolve_ends(edges: DataFrame, tags: DataFrame, canon: DataFrame, scene: list[str]) -> DataFrame:
    """Joins both ends of edges (subj, obj: tag numbers) to names and to canonical nodes, null where unresolved."""
    for end in ("subj", "obj"):
        t = tags.select(*scene, F.col("tag_no").alias(end), F.col("label").alias(f"{end}_name"))
        c = canon.select(F.col("fold").alias("_fold"), F.col("canonical").alias(f"{end}_node"))
        edges = edges.join(dealt(t), [*scene, end], "left").withColumn("_fold", T.fold_key(F.col(f"{end}_name"))).join(c, "_fold", "left").drop("_fold")
    return edges


def expand_sets(registry: DataFrame, max_depth: int = 16) -> DataFrame:
    """(canonical, member): set nodes unrolled to their members, other nodes to themselves."""
    leaf = registry.where("type <> 'set'").select("canonical", F.col("canonical").alias("member"))
    open_ = registry.where("type = 'set'").select("canonical", F.explode("members").alias("member"))
    for _ in range(max_depth):
        leaf = leaf.unionByName(open_.join(registry.where("type <> 'set'").select(F.col("canonical").alias("member")), "member"))
        sets = registry.where("type = 'set'").select(F.col("canonical").alias("member"), F.explode("members").alias("_m"))
        open_ = open_.join(sets, "member").select("canonical", F.col("_m").alias("member"))
        if open_.isEmpty():
            return leaf.distinct()
    raise ValueError(f"sets nested more than {max_depth} deep")


def roster(mentions: DataFrame, registry: DataFrame, scene: list[str]) -> DataFrame:
    """(scene, who, ord): person-like figures by first mention; ``mentions`` has canonical and ord."""
    people = registry.where(F.col("type").isin(*V.PERSON_TYPES)).select(F.col("canonical").alias("who"))
    j = mentions.join(expand_sets(registry), "canonical").withColumnRenamed("member", "who").join(people, "who", "left_semi")
    return j.groupBy(*scene, "who").agg(F.min("ord").alias("ord"))


def candidates(present: DataFrame, asker: DataFrame, scene: list[str], who: str, speaker: str) -> DataFrame:
    """asker x the scene's present figures without the speaker, whatever the spelling."""
    return asker.join(present, scene, "left").withColumn("_ok", T.fold_key(F.col(who)) != T.fold_key(F.col(speaker)))


def route(pool: DataFrame, row: list[str], who: str, order: str, ok: str = "_ok", none: str = V.NO_ADDRESSEE) -> DataFrame:
    """(row, n, pick, source): no candidate is none, one is decided by code, more go to an oracle (first as fallback)."""
    n = F.count_if(F.col(ok))
    g = pool.groupBy(*row).agg(n.alias("n"), F.min_by(F.when(F.col(ok), F.col(who)), F.when(F.col(ok), F.col(order))).alias("pick"))
    return g.select(*row, "n", F.coalesce("pick", F.lit(none)).alias("pick"), F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "code").otherwise("llm").alias("source"))


def first_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group, as first-wins de-duplication does."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def ordered_distinct(order: Column, *fields: Column) -> Column:
    """Aggregate: distinct structs of ``fields`` in order of first appearance."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("_ord"), F.struct(*fields).alias("_row"))))
    return F.array_distinct(F.transform(rows, lambda x: x["_row"]))
