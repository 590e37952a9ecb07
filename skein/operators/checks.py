"""Constraint checks as one relation of problems (layer, unit, code, detail); empty means sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .intervals import dealt, islands


def rule(df: DataFrame, layer: str, unit: Column, code: str, broken: Column, detail: Column) -> DataFrame:
    return df.where(broken).select(F.lit(layer).alias("layer"), unit.cast("string").alias("unit"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))


def missing(want: DataFrame, have: DataFrame, keys: list[str], layer: str, code: str, unit: Column, detail: Column) -> DataFrame:
    return rule(want.join(dealt(have.select(*keys).distinct()), keys, "left_anti"), layer, unit, code, F.lit(True), detail)


def repeated(df: DataFrame, keys: list[str], layer: str, code: str, unit: Column, detail: Column) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return rule(g, layer, unit, code, F.col("_n") != 1, detail)


def in_vocabulary(df: DataFrame, column: str, words: tuple[str, ...], layer: str, unit: Column) -> DataFrame:
    return rule(df, layer, unit, f"{column} not in vocabulary", ~F.coalesce(F.col(column).isin(*words), F.lit(False)), F.col(column))


def all_of(*problems: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, problems)


def require_none(problems: DataFrame) -> None:
    """Raises with the first problem, so a sink behind it writes all or nothing."""
    first = problems.limit(1).collect()
    if first:
        raise ValueError("structural problem: " + ": ".join(str(x) for x in first[0]))


# --- the layers' own checks: a frame of problems each -----------------------------------------------------------
#
# ``scene`` names the columns that make a unit. Scenes carry their line range as ``lo`` and ``hi`` besides, so that a unit may be any
# key. A row may break several rules and then gives several problems. Null never satisfies a rule's requirement.


def _unit(keys: list[str]) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


def broken_rules(df: DataFrame, layer: str, keys: list[str], detail: Column, rules: dict[str, Column]) -> DataFrame:
    """A problem for every rule that a row breaks, in one pass."""
    codes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(code)) for code, c in rules.items()]))
    return df.select(F.lit(layer).alias("layer"), _unit(keys).alias("unit"), F.explode(codes).alias("code"), detail.cast("string").alias("detail"))


def _outside(lo: str, hi: str, start: str, end: str) -> Column:
    return ~((F.col(lo) <= F.col(start)) & (F.col(start) <= F.col(end)) & (F.col(end) <= F.col(hi)))


def unparsed(bad: DataFrame, layer: str, keys: list[str]) -> DataFrame:
    """Lines that look like the layer's but do not fit its grammar (``raw``)."""
    return broken_rules(bad, layer, keys, F.col("raw"), {"malformed": F.lit(True)})


def check_tags(named: DataFrame, expected: DataFrame, scene: list[str]) -> DataFrame:
    """``named`` (scene, tag_no, label) against ``expected`` (scene, tag_no, kind, surface): each tag once, none unknown, empty or echoed."""
    keys = [*scene, "tag_no"]
    n = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("label").alias("label"))
    j = n.join(expected.select(*keys, "kind", "surface", F.lit(True).alias("_want")), keys, "full_outer")
    known = F.col("_want").isNotNull() & F.col("_n").isNotNull()
    return broken_rules(j, "tags", scene, F.concat_ws(" ", "tag_no", "label"), {
        "unknown tag": F.col("_want").isNull(),
        "missing tag": F.col("_n").isNull(),
        "named twice": known & (F.col("_n") > 1),
        "empty": known & (F.trim(F.coalesce("label", F.lit(""))) == ""),
        "echoes the pronoun": known & F.coalesce((F.col("kind") == "pron") & T.is_echo(F.col("label"), F.col("surface")), F.lit(False)),
    })


def check_types(labels: DataFrame, types: DataFrame, unit: list[str]) -> DataFrame:
    """Every label (unit, label) has a type (label, type), and it is in the vocabulary."""
    j = labels.select(*unit, "label").distinct().join(types.select("label", "type"), "label", "left")
    return broken_rules(j, "types", unit, F.concat_ws(" = ", "label", "type"), {
        "untyped": F.col("type").isNull(),
        "type not in vocabulary": F.col("type").isNotNull() & ~F.col("type").isin(*V.NODE_TYPES),
    })


def check_registry(registry: DataFrame, labels: DataFrame, unit: str = "canticle") -> DataFrame:
    """Registry rows (unit, canonical, type, labels, members) against all labels (unit, label) of the unit."""
    texts = F.array().cast("array<string>")
    r = registry.withColumn("labels", F.coalesce("labels", texts)).withColumn("members", F.coalesce("members", texts))
    plain = F.size("members") == 0
    rows = broken_rules(r, "registry", [unit], F.col("canonical"), {
        "heading not among labels": (F.size("labels") > 0) & ~F.array_contains("labels", F.col("canonical")),
        "type not in vocabulary": plain & ~F.coalesce(F.col("type").isin(*V.NODE_TYPES), F.lit(False)),
    })
    own = r.where(plain).select(unit, F.explode(F.array_union("labels", F.array("canonical"))).alias("_l"))
    own = own.select(unit, T.fold_key(F.col("_l")).alias("_fold")).distinct()
    m = r.select(unit, "canonical", F.explode("members").alias("member")).withColumn("_fold", T.fold_key(F.col("member"))).join(own.withColumn("_own", F.lit(True)), [unit, "_fold"], "left")
    strange = broken_rules(m, "registry", [unit], F.concat_ws(": ", "canonical", "member"), {"member is no node and no name": F.col("_own").isNull() & ~F.coalesce(T.is_capitalized_name(F.col("member")), F.lit(False))})
    n = r.select(unit, F.explode("labels").alias("label")).groupBy(unit, "label").agg(F.count(F.lit(1)).alias("_n"))
    j = labels.select(unit, "label").where(F.col("label") != V.UNKNOWN).distinct().join(n, [unit, "label"], "left")
    return all_of(rows, strange, broken_rules(j, "registry", [unit], F.col("label"), {"label not in one node": ~F.coalesce(F.col("_n") == 1, F.lit(False))}))


def check_speech(emitted: DataFrame, spans: DataFrame, unit: list[str], registry: DataFrame | None = None) -> DataFrame:
    """``emitted`` (unit, quote_id, speaker) holds each span (unit, quote_id) as often as there are spans; speakers are nodes."""
    keys = [*unit, "quote_id"]
    e = emitted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_e"))
    s = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("_s"))
    j = e.join(s, keys, "full_outer")
    found = broken_rules(j, "speech", unit, F.col("quote_id"), {"not a span": F.col("_s").isNull(), "span not emitted": F.col("_e").isNull(), "emitted another number of times": F.coalesce(F.col("_e") != F.col("_s"), F.lit(False))})
    if registry is None:
        return found
    known = registry.select(F.col("canonical").alias("speaker")).distinct()
    strange = emitted.where(F.col("speaker") != V.UNATTRIBUTED).join(known, "speaker", "left_anti")
    return found.unionByName(broken_rules(strange, "speech", unit, F.concat_ws(" ", "quote_id", "speaker"), {"speaker not in the registry": F.lit(True)}))


def check_relations(edges: DataFrame, scenes: DataFrame, scene: list[str]) -> DataFrame:
    """Edges (scene, subj, obj, predicate, frame, start, end) within their scene (scene, lo, hi, k): tags 1..k, closed vocabularies, lines inside."""
    j = edges.join(dealt(scenes.select(*scene, "lo", "hi", "k")), scene, "left")
    return broken_rules(j, "relations", scene, F.concat(F.lit("["), "subj", F.lit("] "), "predicate", F.lit(" ["), "obj", F.lit("]")), {
        "subject not a tag": ~F.col("subj").between(1, F.col("k")),
        "object not a tag": ~F.col("obj").between(1, F.col("k")),
        "same tag twice": F.col("subj") == F.col("obj"),
        "predicate not in vocabulary": ~F.col("predicate").isin(*V.PREDICATES, V.FALLBACK_PREDICATE),
        "frame not in vocabulary": ~F.col("frame").isin(*V.FRAMES),
        "lines outside the scene": _outside("lo", "hi", "start", "end"),
    })


def check_locations(locations: DataFrame, scenes: DataFrame, scene: list[str], source: DataFrame | None = None) -> DataFrame:
    """Each scene (scene, lo, hi) has a location (scene, it, en, basis_start, basis_end) with a gloss and a basis inside; ``source`` (scene, text): soft check that the text has the place."""
    j = locations.join(dealt(scenes.select(*scene, "lo", "hi")), scene, "left")
    name = F.coalesce("it", F.lit(V.CARRIED))
    rows = broken_rules(j, "location", scene, name, {"no gloss": F.trim(F.coalesce("en", F.lit(""))) == "", "basis outside the scene": _outside("lo", "hi", "basis_start", "basis_end")})
    bare = scenes.join(dealt(locations.select(*scene).distinct()), scene, "left_anti")
    out = rows.unionByName(broken_rules(bare, "location", scene, F.lit(""), {"no location": F.lit(True)}))
    if source is None:
        return out
    t = locations.where("it is not null").join(dealt(source.select(*scene, "text")), scene)
    return out.unionByName(broken_rules(t, "location", scene, F.col("it"), {"soft: not in the text": ~F.contains(F.lower("text"), F.lower("it"))}))


def check_roundtrip(marked: DataFrame, source: DataFrame, line: list[str]) -> DataFrame:
    """Lines (line keys, marked) that without their marks differ from their source (line keys, text), white space apart (soft); lines without a source are left out."""
    j = marked.join(dealt(source.select(*line, "text")), line)
    return broken_rules(j, "markup", line, F.col("marked"), {"soft: round trip": F.trim(T.strip_to_source(F.col("marked"))) != F.trim(T.collapse(F.col("text")))})


def check_walk(terms: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """Every term has a decision."""
    return broken_rules(terms.join(dealt(decided.select(*keys).distinct()), keys, "left_anti"), "walk", keys, F.lit(""), {"undecided": F.lit(True)})


def check_topography(scenes: DataFrame, unit: list[str], order: str, region: str = "region") -> DataFrame:
    """Every scene has a region; a region that comes back after another one is noted (soft)."""
    none = broken_rules(scenes, "topography", [*unit, order], F.lit(""), {"no region": F.col(region).isNull()})
    i = islands(scenes.where(F.col(region).isNotNull()), F.col(region), unit, [F.col(order)])
    n = i.groupBy(*unit, region).agg(F.count_distinct("island").alias("_n"))
    return none.unionByName(broken_rules(n, "topography", unit, F.col(region), {"soft: recurs": F.col("_n") > 1}))


def check_presence(figures: DataFrame, roster: DataFrame, scenes: DataFrame, scene: list[str]) -> DataFrame:
    """Figures (scene, who, status, basis_start, basis_end) against the closed roster (scene, who): each exactly once, whatever the spelling."""
    f = figures.withColumn("_fold", T.fold_key(F.col("who")))
    r = roster.select(*scene, F.col("who").alias("_name"), T.fold_key(F.col("who")).alias("_fold")).dropDuplicates([*scene, "_fold"])
    j = f.join(dealt(r), [*scene, "_fold"], "left").join(dealt(scenes.select(*scene, "lo", "hi")), scene, "left")
    listed = F.col("_name").isNotNull()
    rows = broken_rules(j, "presence", scene, F.col("who"), {
        "status not in vocabulary": ~F.col("status").isin(*V.STATUSES),
        "not in the roster": ~listed,
        "basis outside the scene": listed & F.coalesce(_outside("lo", "hi", "basis_start", "basis_end"), F.lit(True)),
    })
    n = j.where(listed).groupBy(*scene, "_fold").agg(F.count(F.lit(1)).alias("_n"))
    each = r.join(dealt(n), [*scene, "_fold"], "left")
    return rows.unionByName(broken_rules(each, "presence", scene, F.col("_name"), {"labelled twice": F.coalesce(F.col("_n") > 1, F.lit(False)), "not labelled": F.col("_n").isNull()}))


def check_picks(picks: DataFrame, pool: DataFrame, units: DataFrame, keys: list[str], layer: str, who: str, once: bool = False) -> DataFrame:
    """Picks (keys, ``who``, basis_start, basis_end) come from the pool (keys, who), at least one a unit (keys, lo, hi), with a basis inside; with ``once`` none twice."""
    p = picks.withColumn("_fold", T.fold_key(F.col(who)))
    c = pool.select(*keys, T.fold_key(F.col("who")).alias("_fold"), F.lit(True).alias("_in")).distinct()
    j = p.join(dealt(c), [*keys, "_fold"], "left").join(dealt(units.select(*keys, "lo", "hi")), keys, "left")
    rows = broken_rules(j, layer, keys, F.col(who), {"not a candidate": F.col("_in").isNull(), "basis outside": _outside("lo", "hi", "basis_start", "basis_end")})
    out = rows.unionByName(broken_rules(units.join(dealt(picks.select(*keys).distinct()), keys, "left_anti"), layer, keys, F.lit(""), {"no pick": F.lit(True)}))
    if not once:
        return out
    n = j.where("_in").groupBy(*keys, "_fold").agg(F.count(F.lit(1)).alias("_n"), F.min(who).alias("_first"))
    return out.unionByName(broken_rules(n, layer, keys, F.col("_first"), {"picked twice": F.col("_n") > 1}))


def check_addressee(picks: DataFrame, pool: DataFrame, spans: DataFrame, span: list[str]) -> DataFrame:
    return check_picks(picks, pool, spans, span, "addressee", "addressee")


def check_cohort(picks: DataFrame, pool: DataFrame, scenes: DataFrame, scene: list[str]) -> DataFrame:
    return check_picks(picks, pool, scenes, scene, "cohort", "cohort", once=True)


def check_coverage(scenes: DataFrame, layers: dict[str, DataFrame], scene: list[str]) -> DataFrame:
    """Scenes that a layer does not have."""
    return all_of(*(broken_rules(scenes.join(dealt(df.select(*scene).distinct()), scene, "left_anti"), "lock", scene, F.lit(name), {"scene missing in layer": F.lit(True)}) for name, df in layers.items()))


def check_lock(scenes: DataFrame, scene: list[str], locations: DataFrame, presence: DataFrame, speech: DataFrame, cohort: DataFrame, region: str = "region") -> DataFrame:
    """Before a lock is written: one region a scene (scene, lo, hi, region), bases inside (a carried location's apart), speech begins inside, all layers there."""
    s = dealt(scenes.select(*scene, "lo", "hi"))
    inside = lambda df, what, detail: broken_rules(df.join(s, scene), "lock", scene, detail, {f"{what} basis outside the scene": _outside("lo", "hi", "basis_start", "basis_end")})
    begins = broken_rules(speech.join(s, scene), "lock", scene, F.col("quote_id"), {"speech begins outside the scene": ~F.col("start").between(F.col("lo"), F.col("hi"))})
    return all_of(
        broken_rules(scenes, "lock", scene, F.lit(""), {"not in one region": F.col(region).isNull()}),
        inside(locations.where("it is not null"), "location", F.col("it")),
        inside(presence, "presence", F.col("who")),
        begins,
        check_coverage(scenes, {"location": locations, "presence": presence, "cohort": cohort}, scene),
    )
