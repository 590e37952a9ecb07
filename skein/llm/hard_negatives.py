"""Hard-negative mining over one-dimensional distance keys.

Vectors are quantised to integers and get one more component, so that the largest inner product with an anchor is
the least distance to it. Every vector is filed under its nearest pivot, and the store is sorted by (pivot,
distance to it) and cut into groups of equal size, whatever the pivots hold. A search reads, around every pivot, the
annulus whose keys lie within a radius of the anchor's own distance, and widens the radius until the best found
lie within it: by the triangle inequality nothing outside can be nearer. Positives come first; the negatives of a
positive lie between two distances that its score gives, so their search begins at the nearer one.

Blocks of anchors meet groups of the store: a group's rows are held, the anchors' blocks stream past.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass, cut, drop

SCALE = 256
GROUP = 2048
BLOCK = 512
PIVOTS = 32
SAMPLE = 2048
_BYTES = 4 << 20  # of a group's components
_SLACK = 1e-9
_EXACT = 2.0**53


def quantised(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integers floor(scale * x)) for each length of vector that occurs, only of vectors that take part."""
    n = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.concatenate(([0], np.cumsum(n)))[:-1]
    for d in np.unique(n[n > 0]).tolist():
        rows = np.flatnonzero(n == d)
        m = np.floor(flat[start[rows][:, None] + np.arange(d)] * scale)
        with np.errstate(over="ignore", invalid="ignore"):
            ok = np.isfinite(m).all(1) & (np.einsum("ij,ij->i", m, m) < 2.0**62)
        yield rows[ok], m[ok].astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices; in doubles where they hold every sum."""
    x, y = a.astype(float), b.astype(float)
    most = math.sqrt(float(np.einsum("ij,ij->i", x, x).max(initial=0)) * float(np.einsum("ij,ij->i", y, y).max(initial=0)))
    return (x @ y.T).astype(np.int64) if most < _EXACT / 2 else a @ b.T


def first(score: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores among those that are ``ok``, largest first, ties to the smaller place."""
    at = np.flatnonzero(ok)
    if len(at) > k:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.argsort(-score[at], kind="stable")][:k]


def farthest(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` rows, each the farthest from those before it."""
    picked, near = [0], np.full(len(x), np.inf)
    while len(picked) < min(k, len(x)):
        gap = x - x[picked[-1]]
        near = np.minimum(near, np.einsum("ij,ij->i", gap, gap))
        if near.max() <= 0:
            break
        picked.append(int(near.argmax()))
    return x[picked]


class Keys:
    """Pivots in the space with the added component, by number of components; a length without a pivot has one key for all."""

    def __init__(self, sample: list[tuple[int, bytes]], top: float):
        self.top = top
        by: dict[int, list[np.ndarray]] = {}
        for dim, vec in sample:
            by.setdefault(dim, []).append(np.frombuffer(vec, "<i8").astype(float))
        self.pivots = {}
        for dim, rows in by.items():
            x = np.stack(rows)
            self.pivots[dim] = farthest(np.column_stack((x, self.added(x))), max(1, PIVOTS * len(rows) // len(sample)))

    def added(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.top - np.einsum("ij,ij->i", x, x)))

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """To each pivot; an anchor's added component is 0."""
        p = self.pivots.get(x.shape[1])
        if p is None:
            return np.zeros((len(x), 1))
        full = np.column_stack((x, np.zeros(len(x)) if query else self.added(x)))
        return np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", full, full)[:, None] + np.einsum("ij,ij->i", p, p) - 2 * full @ p.T))


def _vectors(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), -1)


def _rows(vectors: DataFrame, anchors: Column, scale: int, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in quantised(b.column(3), scale):
                cols = [b.column(i).take(pa.array(at)) for i in range(3)]
                x = m.astype(float)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(at), m.shape[1], np.int32)), pa.array(np.einsum("ij,ij->i", x, x)), pa.array([v.tobytes() for v in m.astype("<i8")], pa.binary())], ["vec_id", "label", "anchor", "dim", "sq", "vec"])

    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vec_col).alias("v"))
    read_ = arrow_pass(src.where("vec_id is not null and label is not null"), read, "vec_id long, label string, anchor boolean, dim int, sq double, vec binary")
    return cut(read_.dropDuplicates(["vec_id", "label", "vec"]), "integer-vectors")


def _place(rows: DataFrame, keys: Keys) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(b.schema.get_field_index("dim")).to_numpy()
            for d in np.unique(dims).tolist():
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                far = keys.distances(_vectors(part.column(part.schema.get_field_index("vec")).to_pylist()).astype(float), False)
                pivot = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(far)), pivot])], [*part.schema.names, "pivot", "key"])

    placed = arrow_pass(rows, place, "vec_id long, label string, anchor boolean, dim int, sq double, vec binary, pivot int, key double")
    order = ["dim", "pivot", "key", "vec_id"]
    return cut(placed.repartitionByRange(*order).sortWithinPartitions(*order), "distance-keys")


def _packs(placed: DataFrame, size: int) -> DataFrame:
    """Consecutive rows of a number of components as one row: the store's groups, or blocks of anchors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 32
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            spans: dict[int, list[float]] = {}
            for r in held:
                s = spans.setdefault(r["pivot"], [r["key"], r["key"]])
                s[0], s[1] = min(s[0], r["key"]), max(s[1], r["key"])
            held.sort(key=lambda r: r["vec_id"])
            row = {"pack": no, "dim": held[0]["dim"], "ids": [r["vec_id"] for r in held], "labels": [r["label"] for r in held], "vecs": b"".join(r["vec"] for r in held), "spans": [{"pivot": p, "lo": a, "hi": z} for p, (a, z) in spans.items()]}
            return pa.RecordBatch.from_pylist([row], schema=shape)

        shape = pa.schema([("pack", pa.int64()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("vecs", pa.binary()), ("spans", pa.list_(pa.struct([("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())])))])
        for b in batches:
            for r in b.to_pylist():
                if held and (r["dim"] != held[0]["dim"] or len(held) >= max(1, min(size, _BYTES // (8 * r["dim"])))):
                    yield out()
                    held, no = [], no + 1
                held.append(r)
        if held:
            yield out()

    return arrow_pass(placed, pack, "pack long, dim int, ids array<long>, labels array<string>, vecs binary, spans array<struct<pivot:int,lo:double,hi:double>>")


def _needs(blocks: DataFrame, state: DataFrame, keys: Keys, where: DataFrame) -> DataFrame:
    """(block, pack) pairs whose keys lie within a radius of an anchor of the block; ``state`` has (block, radius)s by place, a null radius asks nothing."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["vecs"], "<i8").reshape(len(r["ids"]), -1).astype(float)
                radius = np.array([-1.0 if v is None else v for v in r["radius"]])
                ask = radius >= 0
                if not ask.any():
                    continue
                d = keys.distances(x[ask], True)
                reach = radius[ask][:, None] * (1 + _SLACK) + _SLACK * math.sqrt(keys.top + 1)
                lo, hi = (d - reach).min(0), (d + reach).max(0)
                n = len(lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["pack"])), pa.array(np.full(n, r["dim"], np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(lo), pa.array(hi)], ["block", "dim", "pivot", "from_", "to_"])

    asked = arrow_pass(blocks.join(state, blocks["pack"] == state["block"]).select("pack", "dim", "ids", "vecs", "radius"), spans, "block long, dim int, pivot int, from_ double, to_ double")
    near = (asked["dim"] == where["dim"]) & (asked["pivot"] == where["pivot"]) & (where["lo"] <= asked["to_"]) & (where["hi"] >= asked["from_"])
    return asked.join(where, near).select("block", "pack").distinct()


def _meet(store: DataFrame, asked: DataFrame, pairs: DataFrame, k: int, least: int | None) -> DataFrame:
    """Of each pair of a group and a block: every anchor's first ``k`` of its label (``least`` None), or every positive's first ``k`` of other labels."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict = {}
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["vecs"], "<i8").reshape(len(r["ids"]), -1)
                if r["block"] is None:
                    group = {"x": x, "ids": np.array(r["ids"]), "labels": np.array(r["labels"], object)}
                    continue
                got: list[tuple] = []
                scores, ids = products(x, group["x"]), group["ids"]
                alike = {v: group["labels"] == v for v in set(r["labels"])}
                for i, (a, label) in enumerate(zip(r["ids"], r["labels"], strict=True)):
                    s, same = scores[i], alike[label] & (ids != a)
                    if least is None:
                        got += [(r["block"], i, None, None, int(ids[j]), int(s[j])) for j in first(s, same, k)]
                        continue
                    other = ~alike[label] & (ids != a)
                    for p in r["positives"][i] or ():
                        top = p["score"]
                        if top >= 0:
                            # 100 * score stays a long: scores are under 2 ** 62 / 100 or compared as doubles' exact integers
                            low = -(-least * top // 100)
                            got += [(r["block"], i, p["vec_id"], top, int(ids[j]), int(s[j])) for j in first(s, other & (s <= top) & (s >= low), k)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == 1 else pa.int64()) for n, c in enumerate(zip(*got, strict=True))], ["block", "place", "positive_id", "positive_score", "vec_id", "score"])

    none = F.lit(None)
    kind = "array<array<struct<vec_id:bigint,score:bigint>>>"
    data = store.join(pairs.select("pack").distinct(), "pack", "left_semi").select("pack", none.cast("long").alias("block"), "ids", "labels", "vecs", none.cast(kind).alias("positives"))
    queries = pairs.join(asked.withColumnRenamed("pack", "block"), "block").select("pack", "block", "ids", "labels", "vecs", F.col("positives").cast(kind).alias("positives"))
    both = data.unionByName(queries).repartition("pack").sortWithinPartitions("pack", F.col("block").asc_nulls_first())
    return arrow_pass(both, scan, "block long, place int, positive_id long, positive_score long, vec_id long, score long")


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, scale: int = SCALE, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that ``anchors`` picks, against all rows.

    Components become floor(scale * x); a score is the exact integer inner product; higher scores come first, ties by
    smaller id. An anchor's positives are the first ``positives`` other rows of its label; a positive's negatives are the
    first ``negatives`` rows of other labels with least / 100 * its score <= score <= its score. A positive of negative
    score has none, a positive without negatives gives no row.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part, nor do vectors
    whose integers' length is 2 ** 31 or more (their scores are no longs). Vectors meet only vectors of as many components.
    Rows that repeat id, label and vector count once; rows of one id with another vector or label are rows of their own (an
    anchor of several vectors pools its rows), but none is a positive or negative of its own id. Other columns are ignored; an
    empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = _rows(vectors, anchors, scale, id_col, label_col, vec_col)
    top = rows.agg(F.max("sq")).first()[0]
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if top is None:
        return spark.createDataFrame([], out)
    sample = rows.select("dim", "vec", F.xxhash64("vec_id", "vec").alias("h")).orderBy("h", "dim").limit(SAMPLE).collect()
    keys = Keys([(r["dim"], r["vec"]) for r in sample], float(top))
    placed = _place(rows, keys)
    drop(rows)
    store = cut(_packs(placed.drop("anchor", "sq"), GROUP), "groups")
    blocks = cut(_packs(placed.where("anchor").drop("anchor", "sq"), BLOCK), "anchors")
    where = store.select("pack", "dim", F.explode("spans").alias("s")).select("pack", "dim", "s.*")

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["vecs"], "<i8").reshape(len(r["ids"]), -1).astype(float)
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["pack"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(r["ids"], pa.int64()), pa.array(np.einsum("ij,ij->i", x, x))], ["block", "place", "anchor_id", "sq"])

    who = cut(arrow_pass(blocks.select("pack", "ids", "vecs"), squares, "block long, place int, anchor_id long, sq double"), "who")
    at = ["block", "place"]
    radius_of = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("sq") + F.lit(float(top)) - 2 * score))
    packed = lambda df, *cols: df.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", *cols))).alias("x"))
    whole = 2 * math.sqrt(2 * top) + 1

    def search(asked: DataFrame, radius: DataFrame, by: list[str], k: int, floor: int | None, bound: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Widen each anchor's ``radius`` (by place) until the one that ``bound`` needs for what is found lies within what was read."""
        done = found = None
        while True:
            state = packed(radius, "radius").select("block", F.transform("x", lambda v: v["radius"]).alias("radius"))
            pairs = _needs(blocks, state, keys, where)
            if done is not None:
                pairs = pairs.join(done, ["block", "pack"], "left_anti")
            pairs = cut(pairs, "pairs")
            if done is not None and not pairs.limit(1).count():
                return found
            got = _best(_meet(store, asked, pairs, k, floor), by, k).drop("rank")
            found = cut(_best(got if found is None else found.unionByName(got), by, k).drop("rank"), "found")
            done = pairs if done is None else done.unionByName(pairs)
            radius = bound(found)

    def last_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
        return found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") >= k)

    def positives_bound(found: DataFrame) -> DataFrame:
        return who.join(last_of(found, at, positives), at, "left").select(*at, F.when(F.col("low").isNotNull(), radius_of(F.col("low"))).otherwise(F.lit(whole)).alias("radius"))

    asked = blocks.select("pack", "ids", "labels", "vecs", F.lit(None).alias("positives"))
    pos = search(asked, who.select(*at, F.lit(0.0).alias("radius")), at, positives, None, positives_bound)
    lists = pos.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("vec_id", "score"))).alias("p"))
    lists = packed(who.join(lists, at, "left"), "p").select("block", F.transform("x", lambda v: v["p"]).alias("positives"))
    asked = cut(blocks.join(lists, blocks["pack"] == lists["block"]).select("pack", "ids", "labels", "vecs", "positives"), "asked")
    each = pos.where("score >= 0").select(*at, F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    of = [*at, "positive_id", "positive_score"]
    # no negative of a positive lies beyond the distance of its least admissible score
    edge = F.floor(F.col("positive_score") * (least / 100)) - 1

    def negatives_bound(found: DataFrame) -> DataFrame:
        low = F.greatest(F.coalesce("low", edge), edge)
        r = each.join(last_of(found, of, negatives), of, "left").join(who, at).groupBy(*at).agg(F.max(radius_of(low)).alias("radius"))
        return who.select(*at).join(r, at, "left").select(*at, "radius")

    near = each.join(who, at).groupBy(*at).agg(F.max(radius_of(F.col("positive_score"))).alias("radius"))
    neg = search(asked, who.select(*at).join(near, at, "left"), of, negatives, least, negatives_bound)
    named = neg.join(who.select(*at, "anchor_id"), at)
    # an anchor of several vectors pools what they found
    named = named.groupBy("anchor_id", "positive_id", "positive_score", "vec_id", "score").agg(F.lit(1).alias("one"))
    return _best(named, ["anchor_id", "positive_id", "positive_score"], negatives).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
