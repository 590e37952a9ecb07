"""Registered queries: every operator group over the driver tables, each with DuckDB SQL of the same result.

Outputs are integers, strings, booleans and rounded doubles; arrays are joined to strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import checks as C
from ..operators import coreference as CO
from ..operators import identity as I
from ..operators import intervals as IV
from ..operators import regions as R
from ..operators import scan as SC
from ..operators import scene as S
from ..operators import verbs as VB

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lst(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def fold_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), '^(?:l''|''l)\\s*', ''), '^(?:{'|'.join(V.ARTICLES)})\\s+', ''))"


TOKEN = r"[\p{L}']+"
TOKENS_SQL = "SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[\\p{L}'']+')) AS tok FROM documents"


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("tok"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted before folding, so the expressions run once a spelling."""
    n = doc_tokens(spark, sf_dir).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("fold", T.fold_key(F.col("tok")))


COUNTS_SQL = f"n AS (SELECT tok, {fold_sql('tok')} AS fold, count(*) AS n FROM ({TOKENS_SQL}) GROUP BY tok)"


# --- identity -------------------------------------------------------------------------------------------------


@query(f"WITH {COUNTS_SQL} SELECT fold, arg_max(tok, {{'n': n, 't': tok}}) AS canonical, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_spellings FROM n GROUP BY fold")
def registry_fold(spark, sf_dir):
    """Tokens to folds, each with its most frequent spelling."""
    return I.canonical(token_counts(spark, sf_dir), label="tok")


@query(
    f"WITH t AS (SELECT lang, tok, {fold_sql('tok')} AS fold FROM ({TOKENS_SQL})) "
    "SELECT fold, lang, tok, count(*) AS n, CAST(GROUPING(lang) AS INTEGER) AS all_langs FROM t GROUP BY GROUPING SETS ((fold, tok), (fold, lang, tok))"
)
def registry_grain(spark, sf_dir):
    """The same counts at two grains from one pass."""
    n = doc_tokens(spark, sf_dir).groupBy("lang", "tok").agg(F.count(F.lit(1)).alias("n")).withColumn("fold", T.fold_key(F.col("tok")))
    f, lang, tok = F.col("fold"), F.col("lang"), F.col("tok")
    g = n.groupingSets([[f, tok], [f, lang, tok]], f, lang, tok)
    return g.agg(F.sum("n").alias("n"), F.grouping("lang").cast("int").alias("all_langs"))


@query(f"WITH {COUNTS_SQL} SELECT fold, count(*) AS n_spellings, string_agg(tok, '|' ORDER BY tok) AS spellings, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY fold HAVING count(*) > 1")
def variant_groups(spark, sf_dir):
    """Folds of more than one spelling."""
    g = token_counts(spark, sf_dir).groupBy("fold").agg(F.count(F.lit(1)).alias("n_spellings"), F.array_join(F.array_sort(F.collect_list("tok")), "|").alias("spellings"), F.sum("n").alias("total"))
    return g.where("n_spellings > 1")


@query(f"WITH n AS (SELECT lang, tok, count(*) AS n FROM ({TOKENS_SQL}) GROUP BY ALL) SELECT lang, CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_labels, count(*) FILTER (WHERE n = 1) AS singletons FROM n GROUP BY lang")
def label_stats(spark, sf_dir):
    """Totals, distinct labels and singletons."""
    n = doc_tokens(spark, sf_dir).groupBy("lang", "tok").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_labels"), F.count_if(F.col("n") == 1).alias("singletons"))


@query(f"SELECT tok, count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(DISTINCT source) AS n_sources FROM ({TOKENS_SQL}) GROUP BY tok ORDER BY n DESC, tok LIMIT 15")
def label_top(spark, sf_dir):
    """The 15 most frequent labels with the scenes and units they occur in."""
    t = doc_tokens(spark, sf_dir)
    top = t.groupBy("tok").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tok").limit(15)
    # only 15 labels' rows reach the distinct counts
    d = t.join(F.broadcast(top), "tok").groupBy("tok", "n", "doc_id", "source").agg(F.lit(1).alias("one"))
    return d.groupBy("tok", "n").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("source").alias("n_sources")).orderBy(F.desc("n"), "tok")


@query(f"WITH {COUNTS_SQL} SELECT * FROM (SELECT fold, arg_max(tok, {{'n': n, 't': tok}}) AS canonical, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY fold) WHERE total >= 2 AND NOT regexp_matches(canonical, '^\\p{{Lu}}[\\p{{L}}\\p{{N}}_'']*$') AND NOT regexp_matches(canonical, '^[^''\\p{{Lu}}]*\\p{{Ll}}[^''\\p{{Lu}}]*''\\p{{Lu}}[\\p{{L}}\\p{{N}}_'']*$')")
def epithet_nodes(spark, sf_dir):
    """Repeated nodes that are no capitalised name."""
    c = I.canonical(token_counts(spark, sf_dir), label="tok")
    return c.where((F.col("total") >= 2) & ~F.coalesce(T.is_capitalized_name(F.col("canonical")), F.lit(False))).select("fold", "canonical", "total")


_ALIASES = (("Brand#1", "Brand#2"), ("Brand#10", "Brand#20"), ("BRAND#7", "brand#8"))


@query(f"WITH a(alias, target) AS (VALUES {', '.join(f'({lst([a.lower()])}, {lst([b.lower()])})' for a, b in _ALIASES)}) SELECT coalesce(target, lower(p_brand)) AS fold, p_type, count(*) AS n FROM part LEFT JOIN a ON alias = lower(p_brand) GROUP BY ALL")
def alias_merge(spark, sf_dir):
    """Nodes re-keyed by a hand-kept alias table, counts added."""
    n = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).withColumn("fold", T.fold_key(F.col("p_brand")))
    return I.apply_aliases(n, spark.createDataFrame(_ALIASES, "alias string, canonical string"), ["fold", "p_type"])


@query("SELECT doc_id, coalesce('q' || quality, source) AS source FROM documents LEFT JOIN labels USING (doc_id)")
def overlay_override(spark, sf_dir):
    """Corrections override by key."""
    o = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("source"))
    return I.override(table(spark, sf_dir, "documents").select("doc_id", "source"), o, ["doc_id"], "source")


_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_SETS_SQL = f"""
WITH l AS (SELECT DISTINCT {_W1} || ', ' || CASE WHEN p_size % 2 = 0 THEN upper({_W2}[1]) || {_W2}[2:] ELSE {_W2} END AS label FROM part),
k AS (SELECT DISTINCT {_W1} AS fold FROM part WHERE {_W1} < 'g'),
p AS (SELECT label, unnest(string_split(label, ', ')) AS piece, generate_subscripts(string_split(label, ', '), 1) AS pos FROM l)
SELECT label, string_agg(piece, ' | ' ORDER BY pos) AS members FROM p LEFT JOIN k ON fold = lower(piece)
GROUP BY label HAVING bool_and(fold IS NOT NULL OR regexp_matches(piece, '^\\p{{Lu}}[\\p{{L}}]*$')) AND count(*) >= 2"""


@query(_SETS_SQL)
def set_members(spark, sf_dir):
    """Comma labels whose pieces are all known or names."""
    p = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b"), "p_size")
    labels = p.select(F.concat("a", F.lit(", "), F.when(F.col("p_size") % 2 == 0, F.initcap("b")).otherwise(F.col("b"))).alias("label"))
    known = p.where("a < 'g'").select(T.fold_key(F.col("a")).alias("fold"))
    return I.set_members(labels, known).select("label", F.array_join("members", " | ").alias("members"))


_LABELS_SQL = f"SELECT DISTINCT p_name AS l FROM part UNION SELECT DISTINCT {_W1} FROM part UNION SELECT DISTINCT p_name || ' ' || lower(p_type) FROM part"


def _part_labels(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    return p.select(F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat_ws(" ", "p_name", F.lower("p_type")))).alias("label")).distinct()


@query(f"WITH l AS ({_LABELS_SQL}), t AS (SELECT l, list_distinct(list_filter(regexp_extract_all(lower(l), '\\p{{L}}+'), lambda x: length(x) >= 2 AND x NOT IN ({lst(V.CONTENT_STOP)}))) AS k FROM l) SELECT a.l AS shorter, b.l AS longer FROM t a JOIN t b ON len(a.k) < len(b.k) AND list_has_all(b.k, a.k) WHERE len(a.k) > 0")
def near_dupes(spark, sf_dir):
    """Labels whose tokens are a proper subset of another's."""
    return I.near_duplicates(_part_labels(spark, sf_dir))


_BARE_SQL = f"""
WITH p AS (SELECT DISTINCT upper({_W1}[1]) || {_W1}[2:] AS a, upper({_W2}[1]) || {_W2}[2:] AS b FROM part),
l AS (SELECT a AS l FROM p UNION SELECT b FROM p UNION SELECT a || ' ' || b FROM p UNION SELECT a || ' di ' || b FROM p),
t AS (SELECT l, unnest(string_split(l, ' ')) AS tok, generate_subscripts(string_split(l, ' '), 1) AS i, string_split(l, ' ') AS w FROM l)
SELECT DISTINCT b.l AS bare, t.l AS fuller FROM l b JOIN t ON t.tok = b.l AND t.l <> b.l
WHERE b.l NOT LIKE '% %' AND b.l <> 'Dio' AND (i = 1 OR lower(w[i - 1]) NOT IN ({lst(V.GOVERNORS)}))"""


@query(_BARE_SQL)
def bare_targets(spark, sf_dir):
    """Bare names and the fuller names they head."""
    p = table(spark, sf_dir, "part").select(F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("a"), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("b")).distinct()
    return I.bare_targets(p.select(F.explode(F.array("a", "b", F.concat_ws(" ", "a", "b"), F.concat_ws(" di ", "a", "b"))).alias("label")))


#: white space and word characters as the generated code has them
_WS = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}"
_NAME_SQL = rf"""
WITH r AS (SELECT unnest(regexp_extract_all(text, '(?:^|[{_WS}])((?:[^{_WS}]+[{_WS}]+)?\p{{Lu}}[^{_WS}]*(?:[{_WS}]+\p{{Lu}}[^{_WS}]*)*)', 1)) AS raw FROM documents),
h AS (SELECT trim(regexp_replace(raw, '[{_WS}]+', ' ', 'g')) AS label, count(*) AS n FROM r GROUP BY label),
w AS (SELECT label, unnest(string_split(label, ' ')) AS w, generate_subscripts(string_split(label, ' '), 1) AS i FROM h),
k AS (SELECT label, CASE WHEN lower(w) IN ({lst(V.PREPOSITIONS + V.TITLES)}) THEN 1 WHEN i > 1 AND lower(w) IN ({lst(V.INFIX_ARTICLES)}) THEN 1
 WHEN regexp_matches(w, '^\p{{Lu}}[\p{{L}}\p{{M}}\p{{N}}_'']*$') OR (regexp_matches(w, '^[^''\p{{Lu}}]*''\p{{Lu}}[\p{{L}}\p{{M}}\p{{N}}_'']*$') AND regexp_matches(w, '^[^'']*\p{{Ll}}')) THEN 2 ELSE 0 END AS kind FROM w)
SELECT h.label, any_value(n) AS n, min(kind) > 0 AND max(kind) = 2 AS is_name, lower(string_split(h.label, ' ')[1]) IN ({lst(V.DEICTIC_HEADS)}) AS deictic
FROM h JOIN k ON k.label = h.label GROUP BY h.label"""


@query(_NAME_SQL)
def name_class(spark, sf_dir):
    """Every capitalised stretch of the texts with the word before it: is it a name, is it led by a demonstrative. Counted before classifying."""
    d = table(spark, sf_dir, "documents").select(F.explode(T.capitalised_runs(F.col("text"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return d.select("label", "n", T.is_capitalized_name(F.col("label")).alias("is_name"), T.is_deictic(F.col("label")).alias("deictic"))


# --- marks and lines ------------------------------------------------------------------------------------------

_PRON = "the|der|la|que"
_LINES_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents"
_MARKED_SQL = f"SELECT doc_id, no, line, regexp_replace(regexp_replace(translate(line, '[]{{}}', ''), '(^| )({_PRON})( |$)', '\\1[\\2]\\3', 'g'), '(\\p{{Lu}}\\p{{L}}*)', '{{\\1}}', 'g') AS m FROM ({_LINES_SQL})"
_MARK_SQL = "'\\[[^\\]]*\\]|\\{[^}]*\\}'"


def doc_lines(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)


def marked_lines(spark, sf_dir) -> DataFrame:
    """Lines with function words as ``[..]`` and capitalised words as ``{..}``."""
    plain = F.translate("line", "[]{}", "")
    m = F.regexp_replace(F.regexp_replace(plain, rf"(^| )({_PRON})( |$)", "$1[$2]$3"), r"(\p{Lu}\p{L}*)", r"{$1}")
    return doc_lines(spark, sf_dir).withColumn("m", m)


@query(
    f"""WITH m AS (SELECT doc_id, no, m, regexp_extract_all(m, {_MARK_SQL}) AS k, regexp_split_to_array(m, {_MARK_SQL}) AS p FROM ({_MARKED_SQL})),
e AS (SELECT doc_id, no, k, p, unnest(generate_series(1, len(k))) AS i FROM m)
SELECT doc_id, CAST(no AS INTEGER) AS line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no, i) AS INTEGER) AS tag_no, CASE WHEN k[i][1] = '{{' THEN 'name' ELSE 'pron' END AS kind, k[i][2:-2] AS surface,
CAST(length(regexp_replace(regexp_replace(array_to_string(list_transform(generate_series(1, i), lambda j: coalesce(k[j - 1][2:-2], '') || p[j]), ''), '\\s+', ' ', 'g'), '^ ', '')) AS INTEGER) AS col FROM e"""
)
def mark_number(spark, sf_dir):
    """Marks numbered in reading order with kind, surface and source column."""
    m = marked_lines(spark, sf_dir).select("doc_id", "no", T.marks(F.col("m")).alias("k"), T.mark_gaps(F.col("m")).alias("g"))
    e = m.select("doc_id", "no", F.posexplode(F.arrays_zip("k", F.slice("g", F.lit(1), F.size("k")).alias("g"))).alias("pos", "x"))
    # both windows read one sort by document, line and place
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("no", "pos"))
    col = F.sum("x.g").over(Window.partitionBy("doc_id", "no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return e.select("doc_id", F.col("no").alias("line"), n.alias("tag_no"), T.mark_kind(F.col("x.k")).alias("kind"), T.mark_surface(F.col("x.k")).alias("surface"), col.alias("col"))


@query(
    f"""WITH m AS (SELECT doc_id, no, regexp_extract_all(m, {_MARK_SQL}) AS k, regexp_split_to_array(m, {_MARK_SQL}) AS p FROM ({_MARKED_SQL})),
b AS (SELECT *, coalesce(sum(len(k)) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m),
t AS (SELECT doc_id, no, len(k) AS n, array_to_string(list_transform(generate_series(1, len(p)), lambda j: p[j] || coalesce(k[j][1] || CAST(before + j AS BIGINT) || ':' || k[j][2:], '')), '') AS s FROM b)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_tags, md5(string_agg(no || ' ' || s, chr(10) ORDER BY no)) AS digest FROM t GROUP BY doc_id"""
)
def mark_splice(spark, sf_dir):
    """Whole texts with every mark numbered in reading order inside its delimiters, as numbered lines."""
    m = marked_lines(spark, sf_dir).select("doc_id", "no", "m", F.size(T.marks(F.col("m"))).alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("text", T.splice_marks(F.col("m"), F.coalesce(before, F.lit(0))))
    g = m.groupBy("doc_id").agg(F.sum("n").cast("long").alias("n_tags"), F.collect_list(F.struct(F.col("no").alias("line"), "text")).alias("x"))
    return g.select("doc_id", "n_tags", F.md5(T.numbered_source(F.col("x"))).alias("digest"))


@query(
    f"""WITH s AS (SELECT doc_id, no, line, regexp_replace(regexp_replace(regexp_replace(m, '\\[([^\\]]*)\\]|\\{{([^}}]*)\\}}', '\\1\\2', 'g'), '\\s+', ' ', 'g'), '^ ', '') AS src FROM ({_MARKED_SQL}))
SELECT doc_id, count(*) AS n_lines, CAST(sum(length(src)) AS BIGINT) AS n_chars, count(*) FILTER (WHERE trim(src) <> trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS n_broken FROM s GROUP BY doc_id"""
)
def mark_strip(spark, sf_dir):
    """Lines stripped of their marks, and whether they round-trip."""
    m = marked_lines(spark, sf_dir).withColumn("src", T.strip_to_source(F.col("m")))
    broken = F.trim("src") != T.collapse(F.col("line"))
    return m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("src")).alias("n_chars"), F.count_if(broken).alias("n_broken"))


_ELIDE_O = "|".join(sorted({w[:-1] for w in V.ELIDABLE if w.endswith("o")}, key=len, reverse=True))
_ELIDE_A = "|".join(sorted({w[:-1] for w in V.ELIDABLE if w.endswith("a")}, key=len, reverse=True))


@query(rf"SELECT doc_id, md5(regexp_replace(text, '(?i)(^|[^{_WORD}])(?:({_ELIDE_O})o|({_ELIDE_A})a)[{_WS}]+([{V.VOWELS}][{_WORD}]*)', '\1\2\3''\4', 'g')) AS digest FROM documents")
def elision(spark, sf_dir):
    """Elidable determiners contracted before a vowel, in whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fix_elision(F.col("text"))).alias("digest"))


@query(
    rf"""WITH t AS (SELECT doc_id, text, list_distinct(list_transform(regexp_extract_all(text, '\p{{Lu}}\p{{L}}+'), lambda x: lower(x))) AS terms, regexp_extract_all(text, '[{_WORD}]+|[^{_WORD}]+') AS k FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, text, terms, unnest(k) AS tok, generate_subscripts(k, 1) AS i FROM t),
n AS (SELECT *, lag(tok) OVER w AS before, lead(tok) OVER w AS after FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, string_agg(CASE WHEN list_contains(terms, lower(tok)) AND coalesce(before, '') NOT LIKE '%*' AND coalesce(after, '') NOT LIKE '*%' THEN '*' || tok || '*' ELSE tok END, '' ORDER BY i) AS marked FROM n GROUP BY doc_id)
SELECT t.doc_id, CAST(length(coalesce(marked, '')) - length(text) AS INTEGER) AS added, md5(coalesce(marked, '')) AS digest, true AS stable FROM t LEFT JOIN m ON m.doc_id = t.doc_id"""
)
def italic_mark(spark, sf_dir):
    """Licensed terms (each text's own names, all of them) wrapped once; a second pass changes nothing."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    terms = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+"), F.lit(0)))
    d = d.withColumn("terms", terms).withColumn("marked", T.mark_terms(F.col("text"), F.col("terms")))
    again = T.mark_terms(F.col("marked"), F.col("terms"))
    return d.select("doc_id", (F.length("marked") - F.length("text")).alias("added"), F.md5("marked").alias("digest"), (again == F.col("marked")).alias("stable"))


# --- intervals ------------------------------------------------------------------------------------------------

_SCENES_SQL = f"SELECT doc_id, CAST((no - 1) // 10 * 10 + 1 AS INTEGER) AS s, CAST(max(no) AS INTEGER) AS e, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM ({_LINES_SQL}) GROUP BY doc_id, (no - 1) // 10"


def scenes(spark, sf_dir) -> DataFrame:
    s = doc_lines(spark, sf_dir).withColumn("k", F.expr("(no - 1) div 10"))
    return s.groupBy("doc_id", "k").agg((F.first("k") * 10 + 1).cast("int").alias("s"), F.max("no").alias("e"), F.sum(F.length("line")).alias("n_chars")).drop("k")


@query(_SCENES_SQL)
def scene_segments(spark, sf_dir):
    """Texts in scenes of ten lines."""
    return scenes(spark, sf_dir).select("doc_id", "s", "e", "n_chars")


_SHIFT = "CASE WHEN s > 1 AND e % 4 = 0 THEN s + 1 WHEN s > 1 AND e % 4 = 1 THEN s - 1 ELSE s END"


@query(
    f"""WITH sc AS (SELECT doc_id, {_SHIFT} AS s, CASE WHEN e % 13 = 3 THEN e + 1 ELSE e END AS e FROM ({_SCENES_SQL})),
x AS (SELECT doc_id, s, e, coalesce(greatest(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 1), 1) AS want FROM sc),
t AS (SELECT doc_id, len(string_split(text, chr(10))) AS total FROM documents)
SELECT doc_id, 'reversed' AS problem, CAST(s AS BIGINT) AS at FROM x WHERE e < s UNION ALL
SELECT doc_id, 'gap', CAST(want AS BIGINT) FROM x WHERE s > want UNION ALL
SELECT doc_id, 'overlap', CAST(s AS BIGINT) FROM x WHERE s < want UNION ALL
SELECT doc_id, 'coverage', CAST(max(e) AS BIGINT) FROM sc JOIN t USING (doc_id) GROUP BY doc_id HAVING max(e) <> max(total)"""
)
def scene_check(spark, sf_dir):
    """Gaps, overlaps, reversals and coverage of scene partitions (some are shifted to be found)."""
    sc = scenes(spark, sf_dir).select("doc_id", F.expr(_SHIFT).alias("s"), F.expr("CASE WHEN e % 13 = 3 THEN e + 1 ELSE e END").alias("e"))
    total = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(F.split("text", "\n")).alias("total"))
    return IV.partition_problems(sc, ["doc_id"], "s", "e", total)


@query(
    f"""WITH sc AS ({_SCENES_SQL}), ed AS (SELECT doc_id, CAST(no AS INTEGER) AS lo, CAST(no + no % 3 AS INTEGER) AS hi FROM ({_LINES_SQL})),
m AS (SELECT ed.doc_id, lo, hi, s FROM ed LEFT JOIN sc ON sc.doc_id = ed.doc_id AND s <= lo AND hi <= e)
SELECT doc_id, lo, hi, count(s) AS n_hits, CASE WHEN count(s) = 1 THEN max(s) END AS scene FROM m GROUP BY doc_id, lo, hi"""
)
def edge_scene(spark, sf_dir):
    """The one scene that holds an edge's lines; none or several is a problem."""
    ed = doc_lines(spark, sf_dir).select("doc_id", F.col("no").alias("lo"), F.expr("no + no % 3").alias("hi"))
    sc = scenes(spark, sf_dir).select("doc_id", F.col("s").alias("scene"), "e")
    m = IV.contain_join(ed, sc, ["doc_id"], ("lo", "hi"), ("scene", "e"), width=10)
    return IV.exactly_one(m, ["doc_id", "lo", "hi"], "scene", "scene")


_POS = "date_diff('day', TIMESTAMP '2024-01-01', ts) * 24 + hour(ts)"
_ASSERT_SQL = f"""
WITH ev AS (SELECT event_id, user_id, event_type, CAST({_POS} AS BIGINT) AS p FROM events),
sp AS (SELECT user_id, p AS s, p AS e, min(event_type) AS speaker FROM ev GROUP BY user_id, p HAVING count(*) >= 2
 UNION ALL SELECT user_id, p // 24 * 24, p // 24 * 24 + 23, max(event_type) FROM ev GROUP BY user_id, p // 24 HAVING count(*) >= 3)
SELECT event_id, arg_min(speaker, {{'a': e - s, 'b': s}}) AS asserter FROM ev LEFT JOIN sp ON sp.user_id = ev.user_id AND s <= p AND p <= e GROUP BY event_id"""


@query(_ASSERT_SQL)
def kg_asserter(spark, sf_dir):
    """The speaker of the innermost span around a position (hours in days, by user)."""
    p = (F.datediff("ts", F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("long")
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", p.alias("p"))
    hours = ev.groupBy("user_id", F.col("p").alias("s")).agg(F.min("event_type").alias("speaker"), F.count(F.lit(1)).alias("n")).where("n >= 2").select("user_id", "s", F.col("s").alias("e"), "speaker")
    days = ev.groupBy("user_id", F.expr("p div 24 * 24").alias("s")).agg(F.max("event_type").alias("speaker"), F.count(F.lit(1)).alias("n")).where("n >= 3").select("user_id", "s", (F.col("s") + 23).alias("e"), "speaker")
    m = IV.contain_join(ev.select("event_id", "user_id", "p"), hours.unionByName(days), ["user_id"], ("p", "p"), ("s", "e"), width=24)
    return IV.innermost(m, ["event_id"], "speaker", F.col("e") - F.col("s"), F.col("s")).withColumnRenamed("speaker", "asserter")


_SPANS = "(5, 900, 0), (10, 150, 1), (210, 350, 1), (410, 550, 1), (430, 500, 2)"


@query(
    f"""WITH sp(a, b, depth) AS (VALUES {_SPANS}), pt AS (SELECT o_orderkey, o_orderkey // 1000 AS k, o_orderkey % 1000 AS p FROM orders)
SELECT o_orderkey, arg_max(a, depth) AS span FROM pt JOIN sp ON (p // 100, p % 100) > (a // 100, a % 100) AND (p // 100, p % 100) < (b // 100, b % 100) GROUP BY o_orderkey"""
)
def own_region(spark, sf_dir):
    """Points strictly between a span's markers, owned by the deepest span."""
    pt = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderkey div 1000").alias("k"), F.expr("cast(o_orderkey % 1000 div 100 as int)").alias("line"), F.expr("cast(o_orderkey % 100 as int)").alias("col"))
    spans = [tuple(int(x) for x in r.strip("() ").split(",")) for r in _SPANS.replace("),", ");").split(";")]
    names = ("quote_id", "start_line", "start_col", "end_line", "end_col", "depth")
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (a, a // 100, a % 100, b // 100, b % 100, d), strict=True)]) for a, b, d in spans])
    sp = pt.select("k").distinct().select("k", F.inline(each))
    return S.own_region(pt, sp, ["k"]).select("o_orderkey", F.col("quote_id").alias("span"))


# --- graph ----------------------------------------------------------------------------------------------------

_KG_SQL = """
WITH reg AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 0)
SELECT s.n_name AS subj_node, o.n_name AS obj_node, l_returnflag AS predicate, count(*) AS n, CAST(count(*) FILTER (WHERE s.n_name IS NULL) + count(*) FILTER (WHERE o.n_name IS NULL) AS BIGINT) AS unresolved
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN reg s ON s.n_nationkey = s_nationkey LEFT JOIN reg o ON o.n_nationkey = c_nationkey GROUP BY ALL"""


@query(_KG_SQL)
def kg_edges(spark, sf_dir):
    """Both ends of edges resolved to nodes, unresolved ends tallied."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pairs = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    # counted by key before names are looked up
    n = pairs.groupBy("s_nationkey", "c_nationkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    reg = table(spark, sf_dir, "nation").where("n_regionkey <> 0")
    subj, obj = (reg.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(x)) for k, x in (("s_nationkey", "subj_node"), ("c_nationkey", "obj_node")))
    e = n.join(subj, "s_nationkey", "left").join(obj, "c_nationkey", "left")
    lost = F.when(F.col("subj_node").isNull(), F.col("n")).otherwise(0) + F.when(F.col("obj_node").isNull(), F.col("n")).otherwise(0)
    return e.groupBy("subj_node", "obj_node", F.col("l_returnflag").alias("predicate")).agg(F.sum("n").alias("n"), F.sum(lost).alias("unresolved"))


_TREE_SQL = """
WITH RECURSIVE nd AS (SELECT 'r' || r_regionkey AS id, NULL AS up, CAST(r_regionkey AS BIGINT) AS ord FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer),
w AS (SELECT id, 0 AS depth, CAST(ord AS VARCHAR) AS path FROM nd WHERE up IS NULL UNION ALL SELECT nd.id, depth + 1, path || '.' || ord FROM nd JOIN w ON nd.up = w.id)
SELECT id AS node, CAST(depth AS INTEGER) AS depth, path FROM w"""


@query(_TREE_SQL)
def span_tree(spark, sf_dir):
    """Depth-first order of a forest, by path."""
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    key = lambda p, k: F.concat(F.lit(p), k)
    nodes = (
        r.select(key("r", "r_regionkey").alias("quote_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("ord"))
        .unionByName(n.select(key("n", "n_nationkey").alias("quote_id"), key("r", "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("long").alias("ord")))
        .unionByName(c.select(key("c", "c_custkey").alias("quote_id"), key("n", "c_nationkey").alias("parent_id"), F.col("c_custkey").alias("ord")))
    )
    return S.walk_spans(nodes, []).select(F.col("quote_id").alias("node"), "depth", F.array_join("path", ".").alias("path"))


# --- speech, presence, routing --------------------------------------------------------------------------------

_FORMS = {"strong": ("the", "der", "la", "que"), "weak": ("of", "die", "le", "de"), "plural": ("and", "und", "et", "y")}
_REF_SQL = f"""
w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM conversations),
r AS (SELECT conv_id, turn, w[i] AS surface, w[i + 1] AS who FROM (SELECT conv_id, turn, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w)),
g AS (SELECT c.conv_id, c.turn, {', '.join(f"list_sort(list(DISTINCT who) FILTER (WHERE surface IN ({lst(v)}))) AS {k}" for k, v in _FORMS.items())} FROM conversations c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn GROUP BY c.conv_id, c.turn)"""


def _referents(spark, sf_dir) -> DataFrame:
    """Each turn's word pairs: the first plays the surface, the second the referent."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    pairs = T.let(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("surface"), F.get(w, i + 1).alias("who"))))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode_outer(pairs).alias("p"))
    return c.select("conv_id", "turn", "p.surface", "p.who")


def _signals(spark, sf_dir) -> DataFrame:
    """Only the surfaces that count are shuffled, once each."""
    r = _referents(spark, sf_dir)
    keep = r.where(F.col("surface").isin(*[w for v in _FORMS.values() for w in v])).distinct()
    return table(spark, sf_dir, "conversations").select("conv_id", "turn").join(keep, ["conv_id", "turn"], "left")


@query(
    f"""WITH {_REF_SQL} SELECT conv_id, turn, CASE WHEN len(coalesce(strong, [])) = 1 THEN strong[1] WHEN len(coalesce(strong, [])) = 0 AND len(coalesce(weak, [])) = 1 THEN weak[1] ELSE '{V.UNATTRIBUTED}' END AS speaker,
CASE WHEN len(coalesce(strong, [])) = 1 THEN 'strong' WHEN len(coalesce(strong, [])) = 0 AND len(coalesce(weak, [])) = 1 THEN 'weak' ELSE 'none' END AS signal,
CASE WHEN len(coalesce(strong, [])) > 1 THEN 'multi(' || array_to_string(strong, ';') || ')' WHEN len(coalesce(strong, [])) = 0 AND len(coalesce(weak, [])) <> 1 AND len(coalesce(plural, [])) > 0 THEN 'plural' ELSE '-' END AS flags FROM g"""
)
def speech_attr(spark, sf_dir):
    """Speakers from first-person surfaces: strong, else weak, else none with flags."""
    a = S.attribute(_signals(spark, sf_dir), ["conv_id", "turn"], _FORMS)
    return a.select("conv_id", "turn", "speaker", "signal", F.when(F.size("flags") > 0, F.array_join("flags", ", ")).otherwise("-").alias("flags"))


_SPANS_SQL = f"""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM conversations),
pt AS (SELECT DISTINCT conv_id, turn AS line, i AS col, w[i] AS surface, w[i + 1] AS who FROM (SELECT conv_id, turn, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w)),
sp AS (SELECT DISTINCT conv_id, 'q' || turn AS quote_id, turn AS sl, 0 AS sc, turn + 2 AS el, 3 AS ec, 1 AS depth FROM conversations WHERE role = 'user'
 UNION ALL SELECT conv_id, 'all', -1, 0, 1000000, 0, 0 FROM (SELECT DISTINCT conv_id FROM conversations)),
own AS (SELECT pt.conv_id, line, col, surface, who, arg_max(quote_id, {{'d': depth, 'q': quote_id}}) AS quote_id FROM pt JOIN sp ON sp.conv_id = pt.conv_id AND (line, col) > (sl, sc) AND (line, col) < (el, ec)
 WHERE surface IN ({', '.join(lst(v) for v in _FORMS.values())}) GROUP BY ALL),
g AS (SELECT conv_id, quote_id, {', '.join(f"list_sort(list(DISTINCT who) FILTER (WHERE surface IN ({lst(v)}))) AS {k}" for k, v in _FORMS.items())} FROM own GROUP BY ALL),
sc AS (SELECT conv_id, turn // 3 AS no, turn // 3 * 3 AS lo, max(turn) AS hi FROM conversations GROUP BY ALL),
f AS (SELECT sp.*, coalesce(strong, []) AS s, coalesce(weak, []) AS w, coalesce(plural, []) AS p, a.no AS a, z.no AS z FROM sp LEFT JOIN g ON g.conv_id = sp.conv_id AND g.quote_id = sp.quote_id
 LEFT JOIN sc a ON a.conv_id = sp.conv_id AND a.lo <= sl AND sl <= a.hi LEFT JOIN sc z ON z.conv_id = sp.conv_id AND z.lo <= el AND el <= z.hi)
SELECT conv_id, quote_id, CASE WHEN len(s) = 1 THEN s[1] WHEN len(s) = 0 AND len(w) = 1 THEN w[1] ELSE '{V.UNATTRIBUTED}' END AS speaker,
CASE WHEN len(s) = 1 THEN 'strong' WHEN len(s) = 0 AND len(w) = 1 THEN 'weak' ELSE 'none' END AS signal,
coalesce(nullif(concat_ws(', ', CASE WHEN len(s) > 1 THEN 'multi(' || array_to_string(s, ';') || ')' WHEN len(s) = 0 AND len(w) <> 1 AND len(p) > 0 THEN 'plural' END, CASE WHEN a IS DISTINCT FROM z THEN 'cross-scene' END), ''), '-') AS flags FROM f"""


@query(_SPANS_SQL)
def speech_spans(spark, sf_dir):
    """Each quote's speaker from the surfaces of its own region, with the flag of quotes that leave their scene."""
    c = table(spark, sf_dir, "conversations")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    pairs = T.let(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.struct((i + 1).alias("col"), x.alias("surface"), F.get(w, i + 1).alias("who"))))
    points = c.select("conv_id", F.col("turn").alias("line"), F.inline(pairs)).distinct()
    at = lambda *x: [v.cast("int").alias(n) for v, n in zip(x, ("start_line", "start_col", "end_line", "end_col", "depth"), strict=True)]
    quotes = c.where("role = 'user'").select("conv_id", F.concat(F.lit("q"), "turn").alias("quote_id"), *at(F.col("turn"), F.lit(0), F.col("turn") + 2, F.lit(3), F.lit(1))).distinct()
    whole = c.select("conv_id").distinct().select("conv_id", F.lit("all").alias("quote_id"), *at(F.lit(-1), F.lit(0), F.lit(1_000_000), F.lit(0), F.lit(0)))
    no = F.expr("turn div 3")
    scenes = c.groupBy("conv_id", no.alias("scene")).agg((F.first(no) * 3).alias("lo"), F.max("turn").alias("hi"))
    a = S.attribute_spans(quotes.unionByName(whole), points, scenes, ["conv_id"], _FORMS)
    return a.select("conv_id", "quote_id", "speaker", "signal", F.when(F.size("flags") > 0, F.array_join("flags", ", ")).otherwise("-").alias("flags"))


@query(
    f"""WITH {_REF_SQL}, b AS (SELECT CASE WHEN len(coalesce(strong, [])) = 1 THEN 'strong-unique' WHEN len(coalesce(strong, [])) > 1 THEN 'multi-strong' WHEN len(coalesce(weak, [])) > 0 THEN 'weak-only' WHEN len(coalesce(plural, [])) > 0 THEN 'plural-only' ELSE 'none' END AS bucket FROM g) SELECT bucket, count(*) AS n FROM b GROUP BY bucket"""
)
def span_buckets(spark, sf_dir):
    """A10: spans by the evidence for their speaker."""
    n = lambda k: F.count_distinct(F.when(F.col("surface").isin(*_FORMS[k]), F.col("who")))
    g = _signals(spark, sf_dir).groupBy("conv_id", "turn").agg(n("strong").alias("s"), n("weak").alias("w"), n("plural").alias("p"))
    b = F.when(F.col("s") == 1, "strong-unique").when(F.col("s") > 1, "multi-strong").when(F.col("w") > 0, "weak-only").when(F.col("p") > 0, "plural-only").otherwise("none")
    return g.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_ROUTE_SQL = """
WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role),
p AS (SELECT c.conv_id, c.turn, f.role AS who, f.first FROM conversations c LEFT JOIN f ON f.conv_id = c.conv_id AND f.first <= c.turn AND f.role <> c.role)
SELECT conv_id, turn, count(who) AS n, coalesce(arg_min(who, first), '(none)') AS pick, CASE count(who) WHEN 0 THEN 'none' WHEN 1 THEN 'code' ELSE 'llm' END AS source FROM p GROUP BY conv_id, turn"""


@query(_ROUTE_SQL)
def addressee_route(spark, sf_dir):
    """Who a turn may address among those met so far: none, one by code, more by an oracle."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    cast = c.groupBy("conv_id", F.col("role").alias("who")).agg(F.min("turn").alias("first"))
    pool = S.candidates(cast, c, ["conv_id"], "who", "role").withColumn("_ok", F.col("_ok") & (F.col("first") <= F.col("turn")))
    return S.route(pool, ["conv_id", "turn"], "who", "first")


_COHORT_SQL = """
WITH k AS (SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) FILTER (WHERE event_type IN ('click', 'purchase', 'view')) AS n FROM events GROUP BY ALL)
SELECT CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'code' ELSE 'llm' END AS bucket, n AS size, count(*) AS n_scenes FROM k GROUP BY ALL"""


@query(_COHORT_SQL)
def cohort_route(spark, sf_dir):
    """Scenes (a user's day) by the number of their class candidates, reader forms left out."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    kinds = spark.createDataFrame([("click", "class"), ("purchase", "class"), ("view", "generic"), ("signup", "individual"), ("error", "class")], "event_type string, type string")
    ok = kinds.where(F.col("type").isin(*V.COHORT_TYPES) & (F.col("event_type") != "error")).select("event_type", F.lit(True).alias("ok"))
    k = e.join(ok, "event_type", "left").groupBy("user_id", "day").agg(F.count_distinct(F.when(F.col("ok"), F.col("event_type"))).alias("n"))
    b = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "code").otherwise("llm")
    return k.groupBy(b.alias("bucket"), F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("n_scenes"))


@query(
    """WITH c AS (SELECT n_nationkey, n_name, c_mktsegment FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000),
k AS (SELECT n_name, c_mktsegment, count(c_mktsegment) AS n FROM c GROUP BY ALL)
SELECT n_name AS region, coalesce(string_agg(c_mktsegment || ' (' || n || ')', ', ' ORDER BY n DESC, lower(c_mktsegment)) FILTER (WHERE n > 0), '(none)') AS cohorts FROM k GROUP BY n_name"""
)
def cohort_rollup(spark, sf_dir):
    """Cohorts folded onto regions, most frequent first, regions without any kept."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    n = table(spark, sf_dir, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    item = F.when(F.col("n").isNotNull(), F.struct((-F.col("n")).alias("k"), F.lower("c_mktsegment").alias("l"), F.concat("c_mktsegment", F.lit(" ("), "n", F.lit(")")).alias("s")))
    g = n.groupBy(F.col("n_name").alias("region")).agg(F.array_sort(F.collect_list(item)).alias("x"))
    return g.select("region", F.when(F.size("x") > 0, F.array_join(F.transform("x", lambda v: v["s"]), ", ")).otherwise("(none)").alias("cohorts"))


@query(
    """WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup' UNION SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'purchase' AND value > 10),
m AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_mentions FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, CAST(day AS VARCHAR) AS day, n_mentions FROM m SEMI JOIN a USING (user_id, day)"""
)
def presence_anchor(spark, sf_dir):
    """Figures only mentioned that an anchor (a speech or a literal action) says are present."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value")
    anchors = e.where("event_type = 'signup' or event_type = 'purchase' and value > 10").select("user_id", "day").distinct()
    m = e.where("event_type = 'error'").groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n_mentions"))
    return m.join(anchors, ["user_id", "day"], "left_semi").select("user_id", F.col("day").cast("string").alias("day"), "n_mentions")


@query(
    """WITH m AS (SELECT o_orderpriority AS scene, CASE WHEN o_orderkey % 3 = 0 THEN r_name ELSE n_name END AS label, o_orderkey AS ord FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
x AS (SELECT n_name AS label, n_name AS who FROM nation UNION ALL SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey)
SELECT scene, who, min(ord) AS ord FROM m JOIN x USING (label) GROUP BY ALL"""
)
def scene_roster(spark, sf_dir):
    """Figures of a scene by first mention, sets unrolled to their members."""
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    m = j.groupBy(F.col("o_orderpriority").alias("scene"), F.when(F.col("o_orderkey") % 3 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("canonical")).agg(F.min("o_orderkey").alias("ord"))
    none = F.array().cast("array<string>")
    sets = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("canonical")).agg(F.collect_list("n_name").alias("members")).withColumn("type", F.lit("set"))
    reg = n.select(F.col("n_name").alias("canonical"), none.alias("members"), F.lit("individual").alias("type")).unionByName(sets)
    return S.roster(m, reg, ["scene"])


_COREF_SQL = """
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id AS tag_no, event_type AS label FROM events),
n AS (SELECT user_id, day, string_agg(DISTINCT label, '|' ORDER BY label) AS candidates, min(label) AS pick FROM e WHERE label IN ('purchase', 'signup') GROUP BY ALL),
o AS (SELECT user_id, day, label, string_agg(tag_no::VARCHAR, '|' ORDER BY tag_no) AS tag_nos FROM e WHERE label IN ('error', 'view') GROUP BY ALL)"""


def _coref(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("tag_no"), F.col("event_type").alias("label"))
    labels = lambda *x: spark.createDataFrame([(v,) for v in x], "label string")
    epithets = labels("error", "view")
    return CO.occurrences(e, epithets, ["user_id", "day"]), CO.epithet_scenes(e, epithets, labels("purchase", "signup"), ["user_id", "day"])


@query(_COREF_SQL + " SELECT o.user_id, CAST(o.day AS VARCHAR) AS day, label, tag_nos, candidates FROM o JOIN n ON n.user_id = o.user_id AND n.day = o.day")
def coref_candidates(spark, sf_dir):
    """Epithets by scene with their tags and the named figures beside them."""
    occ, cand = _coref(spark, sf_dir)
    j = cand.join(occ, ["user_id", "day", "label"])
    return j.select("user_id", F.col("day").cast("string").alias("day"), "label", F.array_join(F.transform("tag_nos", lambda x: x.cast("string")), "|").alias("tag_nos"), F.array_join("candidates", "|").alias("candidates"))


@query(_COREF_SQL + " SELECT e.user_id, CAST(e.day AS VARCHAR) AS day, tag_no, pick AS label FROM e JOIN n ON n.user_id = e.user_id AND n.day = e.day WHERE e.label = 'error'")
def coref_overlay(spark, sf_dir):
    """Decisions expanded to the tags they correct; ``distinct`` corrects none."""
    occ, cand = _coref(spark, sf_dir)
    pick = F.when(F.col("label") == "error", F.get("candidates", F.lit(0))).otherwise(CO.DISTINCT)
    d = cand.select("user_id", "day", "label", pick.alias("pick"))
    return CO.overlay_rows(d, cand, occ, ["user_id", "day"]).select("user_id", F.col("day").cast("string").alias("day"), "tag_no", "label")


_TYPED_SQL = f"""
WITH t AS (SELECT p_partkey AS ord, CASE WHEN p_size % 3 = 0 THEN upper({_W1}[1]) || {_W1}[2:] WHEN p_size % 7 = 0 THEN 'quei ' || {_W1} ELSE {_W1} END || CASE WHEN p_size % 5 = 0 THEN upper({_W2}[1]) || {_W2}[2:] ELSE '' END AS label,
 CASE WHEN p_partkey % 4 = 0 THEN 'class' ELSE 'individual' END AS type FROM part),
k AS (SELECT *, regexp_matches(label, '^\\p{{Lu}}[\\p{{L}}]*$') AS named FROM t WHERE type = 'individual')
SELECT 'epithet' AS kind, label AS fold, label FROM k WHERE NOT named AND NOT starts_with(label, 'quei ') GROUP BY label
UNION ALL SELECT 'named', lower(label), arg_max(label, {{'o': ord, 'l': label}}) FROM k WHERE named GROUP BY lower(label)"""


@query(_TYPED_SQL)
def typed_candidates(spark, sf_dir):
    """Epithets, whose meaning is a scene's, and named individuals, of which the last spelling of a fold counts."""
    w = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    head = F.when(F.col("p_size") % 3 == 0, F.initcap(w(1))).when(F.col("p_size") % 7 == 0, F.concat(F.lit("quei "), w(1))).otherwise(w(1))
    label = F.concat(head, F.when(F.col("p_size") % 5 == 0, F.initcap(w(2))).otherwise(""))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), label.alias("label"), F.when(F.col("p_partkey") % 4 == 0, "class").otherwise("individual").alias("type"))
    return CO.epithets(t).select(F.lit("epithet").alias("kind"), F.col("label").alias("fold"), "label").unionByName(CO.named_individuals(t).select(F.lit("named").alias("kind"), "fold", "label"))


# --- regions --------------------------------------------------------------------------------------------------

_BY, _ORDER = ["user_id"], ["ts", "event_id"]
_OVER = "(PARTITION BY user_id ORDER BY ts, event_id)"
_WALK_SQL = f"""
w AS (SELECT *, coalesce(lag(event_type) OVER {_OVER} <> event_type, true) AS is_new FROM events),
k AS (SELECT *, sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM w)"""


def _walk(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    e = SC.prefix_scan(e, _BY, _ORDER, previous={"_p": F.col("event_type")}, keep_slices=True)
    return R.region_keys(e.withColumn("is_new", F.col("_p") != F.col("event_type")), _BY, _ORDER)


@query(f"WITH {_WALK_SQL} SELECT event_id, user_id, 'r' || CAST(no AS BIGINT) AS region_key FROM k")
def topo_walk(spark, sf_dir):
    """same/new decisions along a journey become region keys."""
    return _walk(spark, sf_dir).select("event_id", "user_id", "region_key")


@query(f"WITH {_WALK_SQL} SELECT user_id, CAST(no AS BIGINT) AS island, any_value(event_type) AS region, min(event_id) AS run_start, max(event_id) AS run_end, count(*) AS n FROM k GROUP BY user_id, no")
def topo_runs(spark, sf_dir):
    """Run-length encoding of the region sequence."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("region"))
    return R.region_runs(e, _BY, _BY, _ORDER, "event_id", "event_id")


_LABEL_SQL = f"""
WITH o AS (SELECT *, row_number() OVER {_OVER} AS rn FROM events),
g AS (SELECT *, (rn - 1) // 8 AS no FROM o),
c AS (SELECT user_id, no, event_type, count(*) AS n, min(rn) AS first FROM g GROUP BY ALL),
b AS (SELECT user_id, no, arg_min(event_type, {{'a': -n, 'b': first}}) AS base, min(first) AS first FROM c GROUP BY user_id, no),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, base ORDER BY first) AS k FROM b)
SELECT user_id, 'r' || (no + 1) AS region_key, CASE WHEN k = 1 THEN base ELSE base || ' #' || k END AS label FROM l"""


@query(_LABEL_SQL)
def topo_label(spark, sf_dir):
    """A region's most frequent surface (ties to the earliest), numbered where it repeats."""
    w = Window.partitionBy(*_BY).orderBy(*_ORDER)
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").withColumn("rn", F.row_number().over(w))
    e = e.withColumn("region_key", F.concat(F.lit("r"), F.expr("(rn - 1) div 8 + 1")))
    return R.region_labels(e, _BY, "event_type", "rn")


@query(
    f"""WITH v AS (SELECT event_id, user_id, ts, CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END AS x FROM events)
SELECT event_id, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS place,
coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM v"""
)
def carry_location(spark, sf_dir):
    """Settings carried forward, with and without the current scene."""
    e = table(spark, sf_dir, "events").withColumn("x", F.when(~F.col("event_type").isin("error", "view"), F.col("event_type")))
    e = SC.prefix_scan(e.select("event_id", "ts", "user_id", "x"), _BY, _ORDER, last={"place": F.col("x")}, before={"before": F.col("x")})
    return e.select("event_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("place", "before")])


@query(
    """WITH v AS (SELECT event_id, ts, event_type, CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END AS x, lag(event_type) OVER w AS p FROM events WINDOW w AS (ORDER BY ts, event_id))
SELECT event_id, coalesce(last_value(x IGNORE NULLS) OVER w, '') AS place, CAST(sum(CASE WHEN p IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER w AS BIGINT) AS run FROM v
WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def journey_scan(spark, sf_dir):
    """All events as one journey, its settings carried and its runs numbered, no task holding it whole."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.when(~F.col("event_type").isin("error", "view"), F.col("event_type")).alias("x"))
    e = SC.prefix_scan(e, [], _ORDER, last={"place": F.col("x")}, keep_slices=True)
    return SC.numbered_runs(e, [], _ORDER, F.col("event_type"), "run").select("event_id", F.coalesce("place", F.lit("")).alias("place"), "run")


@query(
    f"""WITH {_WALK_SQL}, p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, no ORDER BY ts, event_id) - 1) // 2 AS part FROM k),
q AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY no, part) AS paragraph FROM p)
SELECT user_id, paragraph, min(event_id) AS first_event, count(*) AS n FROM q GROUP BY user_id, paragraph"""
)
def paragraphs(spark, sf_dir):
    """A change of place, or too many scenes, opens a paragraph."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    p = R.paragraphs(e, _BY, "event_type", _ORDER, 2)
    return p.groupBy("user_id", "paragraph").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n"))


_REGION_SQL = f"""
WITH {_WALK_SQL}, o AS (SELECT *, row_number() OVER {_OVER} AS rn FROM k),
r AS (SELECT user_id, no, min(rn) AS ls, max(rn) AS le FROM o GROUP BY user_id, no)
SELECT event_id, max(CASE WHEN ls <= rn AND rn + 1 <= le THEN r.no END)::BIGINT AS whole, min(r.no)::BIGINT AS start FROM o LEFT JOIN r ON r.user_id = o.user_id AND ls <= rn AND rn <= le GROUP BY event_id"""


@query(_REGION_SQL)
def region_of(spark, sf_dir):
    """The region that holds a scene whole, and the one that holds its start."""
    w = Window.partitionBy(*_BY).orderBy(*_ORDER)
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    e = IV.islands(e, F.col("event_type"), _BY, [F.col(o) for o in _ORDER]).withColumn("rn", F.row_number().over(w))
    r = e.groupBy("user_id", F.col("island").alias("no")).agg(F.min("rn").alias("ls"), F.max("rn").alias("le"))
    j = IV.contain_join(e.select("event_id", "user_id", "rn"), r, ["user_id"], ("rn", "rn"), ("ls", "le"), width=16)
    return j.groupBy("event_id").agg(F.max(F.when(F.col("rn") + 1 <= F.col("le"), F.col("no"))).alias("whole"), F.min("no").alias("start"))


# --- assembly, measures, checks -------------------------------------------------------------------------------

_LOCK_SQL = """
WITH f AS (SELECT l_orderkey, l_returnflag || '/' || l_linestatus AS x, min(l_linenumber) AS o FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey, p_type AS x, min(l_linenumber) AS o FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
fl AS (SELECT l_orderkey, string_agg(x, ' | ' ORDER BY o, x) AS x FROM f GROUP BY l_orderkey),
sl AS (SELECT l_orderkey, string_agg(x, ' | ' ORDER BY o, x) AS x FROM s GROUP BY l_orderkey)
SELECT o_orderkey, c_name AS title, n_name AS region, coalesce(fl.x, '') AS relations, coalesce(sl.x, '') AS members
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN fl ON fl.l_orderkey = o_orderkey LEFT JOIN sl ON sl.l_orderkey = o_orderkey"""


@query(_LOCK_SQL)
def lock_scene(spark, sf_dir):
    """One record a scene, its child lists gathered first (first appearance, distinct), then joined."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = li.join(p, F.col("p_partkey") == F.col("l_partkey"), "left")
    lists = j.groupBy("l_orderkey").agg(
        S.ordered_distinct(F.col("l_linenumber"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).alias("rel"),
        S.ordered_distinct(F.col("l_linenumber"), F.col("p_type").alias("a")).alias("mem"),
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey")
    o = o.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left").join(lists.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    text = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), " | "), F.lit(""))
    return o.select("o_orderkey", F.col("c_name").alias("title"), F.col("n_name").alias("region"), text("rel", lambda x: F.concat_ws("/", x["a"], x["b"])).alias("relations"), text("mem", lambda x: x["a"]).alias("members"))


_NAME_RE = "[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'']*"
_CONF_SQL = f"""
WITH lic AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{_NAME_RE}'))) AS w FROM benchmark),
s AS (SELECT lang, source, unnest(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
t AS (SELECT lang, source, unnest(list_filter(regexp_extract_all(s, '{_NAME_RE}')[2:], lambda x: regexp_matches(x, '^\\p{{Lu}}') AND x NOT IN ({lst(V.SENTENCE_OPENERS)}))) AS w FROM s),
n AS (SELECT lang, source, lower(regexp_replace(w, '''s$', '')) AS w, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, source, CAST(sum(n) AS BIGINT) AS asserted, CAST(coalesce(sum(n) FILTER (WHERE lic.w IS NOT NULL), 0) AS BIGINT) AS in_lock FROM n LEFT JOIN lic ON lic.w = n.w GROUP BY ROLLUP (lang, source)"""


@query(_CONF_SQL)
def conformance(spark, sf_dir):
    """Asserted names against the licensed vocabulary, by unit and in total."""
    lic = table(spark, sf_dir, "benchmark").select(F.explode(T.name_tokens(F.col("text"))).alias("w")).select(F.lower("w").alias("w"), F.lit(True).alias("ok")).distinct()
    s = table(spark, sf_dir, "documents").select("lang", "source", F.explode(T.sentences(F.col("text"))).alias("s"))
    toks = T.name_tokens(F.col("s"))
    named = F.filter(F.slice(toks, 2, F.greatest(F.size(toks), F.lit(1))), lambda x: x.rlike(r"^\p{Lu}") & ~x.isin(*V.SENTENCE_OPENERS))
    n = s.select("lang", "source", F.explode(named).alias("w")).groupBy("lang", "source", F.lower(T.strip_possessive(F.col("w"))).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(lic, "w", "left").rollup("lang", "source").agg(F.sum("n").alias("asserted"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("in_lock"))


_VERB_SQL = """
WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}'']+')) AS w FROM documents WHERE lang = 'en'),
v AS (SELECT w, count(*) AS n FROM t WHERE length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|ous|is)$') AND w NOT LIKE '%''%' GROUP BY w),
b AS (SELECT *, CASE WHEN regexp_matches(w, 'ings$') THEN 'noun' WHEN regexp_matches(w, 'tions$') THEN 'discourse' ELSE 'diegetic' END AS bucket FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, w) AS k FROM b)
SELECT bucket, count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(n) FILTER (WHERE k <= 60) AS BIGINT) AS top_tokens FROM r GROUP BY bucket"""


@query(_VERB_SQL)
def verb_hist(spark, sf_dir):
    """Verb-like words by kind, and how much the sixty most frequent cover."""
    t = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("w"))
    v = t.where((F.length("w") > 3) & F.col("w").endswith("s") & ~F.col("w").rlike("(ss|ous|is)$") & ~F.col("w").contains("'")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    v = v.withColumn("bucket", F.when(F.col("w").rlike("ings$"), "noun").when(F.col("w").rlike("tions$"), "discourse").otherwise("diegetic"))
    # ranked within slices first, so that no bucket is sorted whole in one task
    order = (F.desc("n"), F.asc("w"))
    s = v.withColumn("slice", F.pmod(F.xxhash64("w"), F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("bucket", "slice").orderBy(*order)))
    top = s.where("r <= 60").withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where("k <= 60").groupBy("bucket").agg(F.sum("n").alias("top_tokens"))
    return v.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n_tokens")).join(top, "bucket")


_CLASS_SQL = rf"""
WITH l AS (SELECT unnest(regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x{{85}}\x{{2028}}\x{{2029}}]')) AS line FROM documents),
w AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(line), '[a-z][a-z''-]*')) AS word FROM l WHERE NOT regexp_matches(line, '^[{_WS}]*[*\-\[{{#]')) GROUP BY word),
h AS MATERIALIZED (SELECT word, n FROM w WHERE length(word) > 3 AND word LIKE '%s' AND NOT regexp_matches(word, '(ss|ous|is)$') AND word NOT LIKE '%''%' AND word NOT IN ({lst(V.NO_VERBS)})
 AND NOT regexp_matches(word, '(ings|tions)$') ORDER BY n DESC, word LIMIT {VB.TOP}),
c AS MATERIALIZED (SELECT DISTINCT w.word AS predicate, h.word FROM h JOIN w ON w.word = h.word[:-2] OR (h.word LIKE '%es' AND w.word = h.word[:-3]))"""


def _verb_classes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The head, and its words' classes: what is left without the ending, where the texts have that word too."""
    d = table(spark, sf_dir, "documents")
    n = VB.counts(d, "text").withColumn("bucket", F.when(F.col("word").rlike("(?:ings|tions)$"), "noun").otherwise("diegetic"))
    h = VB.head(n)
    without = lambda e: F.when(F.col("word").endswith(e), F.expr(f"substring(word, 1, length(word) - {len(e)})"))
    stems = h.select("word", F.explode(F.array_compact(F.array(without("s"), without("es")))).alias("predicate"))
    words = d.select(F.explode(T.prose(F.col("text"))).alias("line")).select(F.explode(T.latin_words(F.col("line"))).alias("predicate"))
    # twice as many stems as the head has words, at most
    return h, stems.join(words.join(F.broadcast(stems.select("predicate")), "predicate", "left_semi").distinct(), "predicate")


@query(_CLASS_SQL + " SELECT predicate, string_agg(h.word, ',' ORDER BY h.word) AS verbs, CAST(sum(n) AS BIGINT) AS n FROM h LEFT JOIN c ON c.word = h.word GROUP BY predicate")
def verb_classes(spark, sf_dir):
    """The most frequent verb-like words of the prose lines by synonym class; a word may have several."""
    h, c = _verb_classes(spark, sf_dir)
    return VB.by_predicate(h, c).withColumn("verbs", F.array_join("verbs", ","))


@query(
    _CLASS_SQL
    + f""" SELECT count(*) AS n_words, CAST(coalesce(sum(n) FILTER (WHERE ok), 0) AS BIGINT) AS covered, CAST(coalesce(sum(n), 0) AS BIGINT) AS total, coalesce(round(100 * sum(n) FILTER (WHERE ok) / sum(n), 1), 0) AS pct,
string_agg(word, ',' ORDER BY n DESC, word) FILTER (WHERE NOT ok) AS uncovered, (SELECT count(DISTINCT predicate) FROM c) AS n_predicates, (SELECT count(DISTINCT predicate) FROM c) <= {VB.MOST_PREDICATES} AS tractable FROM (SELECT word, n, word IN (SELECT word FROM c) AS ok FROM h)"""
)
def verb_coverage(spark, sf_dir):
    """How much of the head the classes cover, what they leave, and whether they are few enough for one list."""
    h, c = _verb_classes(spark, sf_dir)
    return VB.coverage(h, c).withColumn("uncovered", F.array_join("uncovered", ","))


@query(f"WITH t AS (SELECT lang, source, tok FROM ({TOKENS_SQL}) GROUP BY ALL) SELECT lang, source, count(DISTINCT tok) AS n_labels, CASE WHEN count(DISTINCT tok) < 1500 THEN 'PASS' ELSE 'FAIL' END AS gate FROM t GROUP BY ROLLUP (lang, source)")
def global_gates(spark, sf_dir):
    """Totals per unit and over all, with pass/fail gates."""
    t = doc_tokens(spark, sf_dir).select("lang", "source", "tok").distinct()
    g = t.rollup("lang", "source").agg(F.count_distinct("tok").alias("n_labels"))
    return g.withColumn("gate", F.when(F.col("n_labels") < 1500, "PASS").otherwise("FAIL"))


@query(
    f"""WITH v AS (SELECT DISTINCT lower(tok) AS w FROM ({TOKENS_SQL})),
t AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}'']+'))) AS w FROM benchmark)
SELECT item_id, count(*) AS n_tokens, CAST(count(v.w) AS BIGINT) AS n_seen, count(v.w) = 0 AS noise FROM t LEFT JOIN v ON v.w = t.w GROUP BY item_id"""
)
def noise_labels(spark, sf_dir):
    """Labels none of whose tokens occurs in the scene text."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)))).alias("w"))
    seen = doc_tokens(spark, sf_dir).select(F.lower("tok").alias("w")).distinct().withColumn("s", F.lit(1))
    return t.join(seen, "w", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count("s").alias("n_seen"), (F.count("s") == 0).alias("noise"))


@query(
    """SELECT conv_id, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'user'), 0) AS BIGINT) AS user_chars, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS assistant_chars, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'system'), 0) AS BIGINT) AS system_chars FROM conversations GROUP BY conv_id"""
)
def digest_pivot(spark, sf_dir):
    """One row a scene from one line a language; a missing one is empty."""
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").pivot("role", ["user", "assistant", "system"]).agg(F.sum(F.length("text")))
    return p.select("conv_id", *[F.coalesce(r, F.lit(0)).cast("long").alias(f"{r}_chars") for r in ("user", "assistant", "system")])


@query("SELECT doc_id, lang FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def resume_antijoin(spark, sf_dir):
    """Work that is not done, a block without a body counting as not done."""
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(done, "doc_id", "left_anti")


@query(
    """WITH c AS (SELECT conv_id, turn, role, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM conversations)
SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS context_chars, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS recap FROM c"""
)
def rolling_context(spark, sf_dir):
    """What went before a scene, and its predecessor's recap."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("_n"))
    c = SC.prefix_scan(c, ["conv_id"], ["turn"], total={"_all": F.col("_n")}, previous={"recap": F.col("role")})
    return c.select("conv_id", "turn", (F.col("_all") - F.coalesce("_n", F.lit(0))).cast("long").alias("context_chars"), F.coalesce("recap", F.lit("")).alias("recap"))


_PROBLEMS_SQL = """
WITH p AS (
SELECT 'orders' AS layer, o_orderkey::VARCHAR AS unit, 'status not in vocabulary' AS code FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL
SELECT 'lineitem', l_orderkey::VARCHAR, 'not exactly once' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) <> 1 UNION ALL
SELECT 'lineitem', l_orderkey::VARCHAR, 'basis before its scene' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate UNION ALL
SELECT 'documents', doc_id::VARCHAR, 'missing' FROM documents ANTI JOIN labels USING (doc_id) UNION ALL
SELECT 'part', p_partkey::VARCHAR, 'subject is object' FROM part WHERE p_size = p_partkey % 50)
SELECT layer, code, count(*) AS n, min(unit) AS first_unit FROM p GROUP BY ALL"""


@query(_PROBLEMS_SQL)
def problems_all(spark, sf_dir):
    """Constraint checks as one relation of problems."""
    o, li, d, p = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "documents", "part"))
    dated = li.select("l_orderkey", "l_shipdate").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    key = F.col("l_orderkey")
    status = C.rule(o, "orders", F.col("o_orderkey"), "status not in vocabulary", ~F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus"))
    found = C.all_of(
        status,
        C.repeated(li, ["l_orderkey", "l_linenumber"], "lineitem", "not exactly once", key, F.col("l_linenumber")),
        C.rule(dated, "lineitem", key, "basis before its scene", F.col("l_shipdate") < F.col("o_orderdate"), F.col("l_shipdate")),
        C.missing(d.select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"], "documents", "missing", F.col("doc_id"), F.lit("")),
        C.rule(p, "part", F.col("p_partkey"), "subject is object", F.col("p_size") == F.col("p_partkey") % 50, F.col("p_size")),
    )
    return found.groupBy("layer", "code").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("first_unit"))
