"""The thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    got = pack(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, and whether decoding gives the text back."""
    from .sentencepiece_fst import encode

    got = encode(_table(spark, sf_dir, "documents"), decoded=True)
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return got.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), same.alias("round_trip"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, shard, byte_offset, n_ids, ids_crc32 of every sequence, as read back from the shards that were written."""
    from .common import new_path
    from .token_store import read_slots, write_store

    store = write_store(_table(spark, sf_dir, "documents"), new_path(spark, "token-store"))
    return read_slots(spark, store).select("slot", "shard", "byte_offset", "n_ids", F.crc32("ids").alias("ids_crc32"))


def _bucket(mod: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, learn_profiles

    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(_bucket(4) == 2, F.lit(False))
    got = identify(docs, learn_profiles(docs.where(_bucket(4) != 2)))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    got = dedup_lines(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (what is kept), n_sentences, n_removed."""
    from .substring_dedup import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_bags

    docs = _table(spark, sf_dir, "documents")
    index, read = fit(docs, _table(spark, sf_dir, "labels").where(_bucket(5) != 0), docs)
    held = F.coalesce(_bucket(5) == 0, F.lit(False))
    return score_bags(read, index).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.transform("evidence", lambda e: e["doc_id"]).alias("nearest"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sanitise import find

    got = find(_table(spark, sf_dir, "documents"))
    base = F.array_join(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return got.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import group, noisy_words

    return group(noisy_words(_table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved by one, so that some neighbours are wrong on purpose."""
    from .hard_negatives import mine

    v = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(v.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    got = run(spark, sf_dir)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, u.line, u.pos,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents) u
), firsts AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), flagged AS (
  SELECT l.doc_id, l.pos, l.line, (f.first IS NOT NULL AND f.first <> l.doc_id) AS gone
  FROM lines l LEFT JOIN firsts f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

def _crc_table() -> list[int]:
    """The 256 remainders of the CRC-32 of IEEE 802.3, from its polynomial."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


_RUNS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00c0-\u00ff]+')"
#: bytes of '<doc_id>:<run>' as pairs of hexadecimal digits
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest({_RUNS}) AS run FROM documents
), r AS MATERIALIZED (
  SELECT id, run, count(*) AS n FROM d GROUP BY ALL
), x AS (
  SELECT run, n, hex(encode(id || ':' || run)) AS hx FROM r
), c AS (
  SELECT run, n, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(1, length(hx), 2), lambda i: CAST('0x' || hx[i:i + 1] AS UBIGINT))),
    lambda a, b: xor(a >> 8, CAST({_crc_table()}[CAST(xor(a & 255, b) AS BIGINT) + 1] AS UBIGINT))), CAST(4294967295 AS UBIGINT)) AS h FROM x
), f AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:CAST(h % length(run) AS BIGINT)] || run[CAST(h % length(run) AS BIGINT) + 2:] ELSE run END AS word, n FROM c
), w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM f WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), k AS MATERIALIZED (
  SELECT word, i, word[:i - 1] || word[i + 1:] AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS (
  SELECT a.word, b.word AS near FROM k a JOIN k b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, w.word FROM k JOIN w ON w.word = k.less
  UNION SELECT w.word, k.word FROM k JOIN w ON w.word = k.less
), b AS (
  SELECT near.word, count(*) AS n_near, arg_min(near, {{'a': -o.n, 'b': near}}) AS form, max(o.n) AS form_n FROM near JOIN w o ON o.word = near GROUP BY near.word
), g AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM w LEFT JOIN b ON b.word = w.word
), walk AS (
  SELECT word, word AS at FROM g UNION ALL SELECT walk.word, g.form FROM walk JOIN g ON g.word = walk.at WHERE g.form IS NOT NULL
)
SELECT g.word, g.form, walk.at AS root, g.n, g.n_near, g.form_n FROM g JOIN walk ON walk.word = g.word JOIN g e ON e.word = walk.at WHERE e.form IS NULL
"""

OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""

#: sets are compared once each, however many documents hold them
OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM d
), once AS MATERIALIZED (
  SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), e AS MATERIALIZED (
  SELECT id, n, unnest(s) AS x FROM once
), pairs AS (
  SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM e a JOIN e b ON a.x = b.x AND a.id < b.id WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.id, b.id
), links AS MATERIALIZED (
  SELECT unnest([a, b]) AS a, unnest([b, a]) AS b FROM pairs WHERE 100 * shared >= 90 * (na + nb - shared)
), walk AS (
  SELECT id, id AS at FROM once UNION SELECT walk.id, links.b FROM walk JOIN links ON links.a = walk.at
), roots AS (
  SELECT id, min(walk.at) AS root FROM walk GROUP BY id
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(root, sets.doc_id) AS component_id
FROM sets LEFT JOIN once ON once.s = sets.s LEFT JOIN roots ON roots.id = once.id
"""

OP8_SQL = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS len FROM u WHERE list_dot_product(e, e) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.98
), walk AS (
  SELECT vec_id, vec_id AS at FROM v UNION SELECT walk.vec_id, links.b FROM walk JOIN links ON links.a = walk.at
), roots AS (
  SELECT vec_id, min(walk.at) AS root FROM walk GROUP BY vec_id
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT x.vec_id, coalesce(n, 0) AS n_links, coalesce(root, x.vec_id) AS component_id, coalesce(root, x.vec_id) = x.vec_id AS kept
FROM embeddings x LEFT JOIN roots ON roots.vec_id = x.vec_id LEFT JOIN counts ON counts.a = x.vec_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_packing, op3_sentencepiece, op4_token_store, op5_langid, op6_substring_dedup, op7_line_dedup, op8_embed_dedup, op9_ann, op10_toxicity, op11_pii, op12_variants, op13_hard_negatives, pipeline)}
ORACLES: dict[str, str] = {"op1_ngram_join": OP1_SQL, "op8_embed_dedup": OP8_SQL, "op7_line_dedup": OP7_SQL, "op12_variants": OP12_SQL, "op13_hard_negatives": OP13_SQL}
