"""Approximate nearest neighbours by largest inner product: an NN-descent graph and greedy search over it.

Vectors are indexed once each, however many rows hold them (their ``k`` + 1 smallest ids stand for the
copies, which is all that a k-nearest list can show). Vectors fall into bands by length, an octave each, the longest
first. Each band has a graph of its own by cosine, so long vectors, which answer most queries, are not hidden among
short ones. A band's graph begins with exact neighbours within the leaves of random-projection trees; rounds of
NN-descent then join each vector with its neighbours and reverse neighbours, compare these with one another, and keep
each one's best. A query is compared with a sample of each band (``entries``); bands whose longest vector cannot reach the best found are left out. In the others it starts from the best of these, in its own
band from its own vector, and expands the best unexpanded vectors by inner product, a batch a round. Graph and search
compare directions in 8-bit precision, each vector's length apart as a float; the best of each query are scored again
from the original components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass, cut, drop, mix
from .vectors import blobs, directions, keys, matrices, rows

TOP = 20
NEIGHBOURS, REVERSE, BEST = 40, 32, 6
TREES, LEAF, SAMPLE = 4, 512, 20_000
ROUNDS, WIDTH, HELD, RESCORE = 4, 32, 256, 64
ENTRIES = 1024
#: vectors shorter than 2 ** -LAST_BAND of the longest are one band and walk as if of that length (floats end there); scores are exact
LAST_BAND = 100.0


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def _pack8(x: np.ndarray, length: np.ndarray) -> list[bytes]:
    """Per direction: its scale and the length (floats), its components (8 bits)."""
    q, scale = quantise(x)
    head = np.column_stack((scale, length.astype(np.float32)))
    return [a.tobytes() + b.tobytes() for a, b in zip(head, q, strict=True)]


def _unpack8(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(directions, lengths)."""
    raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    head = raw[:, :8].copy().view(np.float32)
    return raw[:, 8:].view(np.int8).astype(np.float32) * head[:, :1], head[:, 1]


def best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k distinct ids of largest similarity, ties to the smaller id."""
    order = np.lexsort((ids, -sims))
    ids, sims = ids[order], sims[order]
    keep = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[keep], sims[keep]


def _lists(ids: list[np.ndarray], sims: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([x.astype("<i8").tobytes() for x in ids], pa.binary()), pa.array([x.astype("<f4").tobytes() for x in sims], pa.binary())]


def _merge(k: int):
    """Rows (node, parts of (ids, sims)) to each node's best k."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sims = [], []
            for node, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                i = np.frombuffer(b"".join(p["ids"] for p in parts), "<i8")
                s = np.frombuffer(b"".join(p["sims"] for p in parts), "<f4")
                got = best(i[i != node], s[i != node], k)
                ids.append(got[0])
                sims.append(got[1])
            yield pa.RecordBatch.from_arrays([b.column(0), *_lists(ids, sims)], ["node", "ids", "sims"])

    return go


def _gather(parts: DataFrame, k: int) -> DataFrame:
    grouped = parts.groupBy("node").agg(F.collect_list(F.struct("ids", "sims")).alias("parts"))
    return arrow_pass(grouped, _merge(k), "node long, ids binary, sims binary")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [np.frombuffer(x, "<i8") for x in b.column(1).to_pylist()]
        flat = np.concatenate(ids) if ids else np.empty(0, "<i8")
        sims = np.frombuffer(b"".join(b.column(2).to_pylist()), "<f4")
        node = np.repeat(b.column(0).to_numpy(), [len(x) for x in ids])
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(flat), pa.array(sims)], ["node", "other", "sim"])


def _edges(graph: DataFrame) -> DataFrame:
    return arrow_pass(graph.select("node", "ids", "sims"), _explode, "node long, other long, sim float")


class Tree:
    """Random projections, split at the medians of a sample."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.split: list[list[tuple[np.ndarray, float]]] = []
        code = np.zeros(len(sample), np.int64)
        self.plane = [rng.standard_normal(sample.shape[1]).astype(np.float32) for _ in range(depth)]
        self.median: list[dict[int, float]] = []
        for d in range(depth):
            p = sample @ self.plane[d]
            cuts = {int(c): float(np.median(p[code == c])) for c in np.unique(code)}
            self.median.append(cuts)
            code = 2 * code + (p > np.array([cuts[int(c)] for c in code]))

    def codes(self, x: np.ndarray) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for plane, cuts in zip(self.plane, self.median, strict=True):
            found, back = np.unique(code, return_inverse=True)
            code = 2 * code + (x @ plane > np.array([cuts.get(int(c), 0.0) for c in found])[back])
        return code


def _index(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, h1, h2, dim, vec) of usable vectors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, m in matrices(b.column(1)):
                h1, h2 = keys(m)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at].astype(np.int64)), pa.array(h1), pa.array(h2), pa.array(np.full(len(m), m.shape[1], np.int32)), pa.array(blobs(m, "<f8"), pa.binary())], ["vec_id", "h1", "h2", "dim", "vec"])

    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where("vec_id is not null")
    return cut(arrow_pass(src, read, "vec_id long, h1 long, h2 long, dim int, vec binary"), "vectors")


def _copies(all_rows: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """(node, rank, vec_id): the smallest ids of each vector, at most top + 1; hot vectors are cut by slice first."""
    ids = all_rows.select("h1", "h2", "vec_id").distinct().withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    w = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
    ids = ids.withColumn("r", w("h1", "h2", "slice")).where(F.col("r") <= top + 1)
    ids = ids.withColumn("copy", w("h1", "h2")).where(F.col("copy") <= top + 1)
    return ids.join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("node", "copy", "vec_id")


def _start(eight: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """Exact neighbours within the leaves of the trees, which bands of fewer vectors use less deep."""
    n = sum(sizes.values())
    deep = {b: max(0, int(np.ceil(np.log2(m / LEAF)))) for b, m in sizes.items()}
    depth = max(deep.values())
    rate = min(1.0, SAMPLE / n)
    sample = _unpack8([r["q"] for r in eight.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) <= int(rate * (1 << 20))).orderBy(F.xxhash64("node")).limit(SAMPLE).select("q").collect()])[0]
    trees = [Tree(sample, depth, t) for t in range(TREES if depth else 1)]
    each = k if depth == 0 else max(8, -(-k // len(trees)) + 2)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unpack8(b.column(2).to_pylist())[0]
            less = np.array([depth - deep[i] for i in b.column(0).to_pylist()], np.int64)
            for t, tree in enumerate(trees):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array((tree.codes(x) >> less) * len(trees) + t), *b.columns[1:]], ["band", "leaf", "node", "q"])

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        x, node = _unpack8(pdf["q"].tolist())[0], pdf["node"].to_numpy(np.int64)
        m = min(each, len(x) - 1)
        if m < 1:
            return pd.DataFrame({"node": [], "ids": [], "sims": []})
        ids, sims = [], []
        for at in range(0, len(x), 1024):
            s = x[at : at + 1024] @ x.T
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
            near = np.argpartition(-s, m - 1, axis=1)[:, :m]
            ids += [node[i].astype("<i8").tobytes() for i in near]
            sims += [v.astype("<f4").tobytes() for v in np.take_along_axis(s, near, 1)]
        return pd.DataFrame({"node": node, "ids": ids, "sims": sims})

    placed = arrow_pass(eight.select("band", "node", "q"), leaves, "band int, leaf long, node long, q binary")
    # a leaf that many near copies fill is dealt out into parts
    parts = placed.groupBy("band", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * LEAF)).cast("int").alias("parts"))
    placed = placed.join(parts, ["band", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "leaf"), F.col("parts")))
    found = placed.select("band", "leaf", "part", "node", "q").groupBy("band", "leaf", "part").applyInPandas(exact, "node long, ids binary, sims binary")
    return cut(_gather(found, k), "graph")


def _descend(graph: DataFrame, eight: DataFrame, k: int) -> DataFrame:
    """One round: each vector's neighbours, reverse neighbours and itself are compared with one another."""
    edges = _edges(graph)
    w = Window.partitionBy("other").orderBy(F.desc("sim"), "node")
    back = edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= REVERSE).select(F.col("other").alias("node"), F.col("node").alias("other"))
    own = graph.select("node", F.col("node").alias("other"))
    around = edges.select("node", "other").unionByName(back).unionByName(own).distinct()
    around = around.join(eight.select(F.col("node").alias("other"), "q"), "other").groupBy("node").agg(F.collect_list(F.struct("other", "q")).alias("near"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, ids, sims = [], [], []
            for near in b.column(0).to_pylist():
                m = min(BEST, len(near) - 1)
                if m < 1:
                    continue
                who = np.array([x["other"] for x in near], "<i8")
                x = _unpack8([x["q"] for x in near])[0]
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                node.append(who)
                ids += [y.tobytes() for y in who[top]]
                sims += [y.astype("<f4").tobytes() for y in np.take_along_axis(s, top, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(node) if node else np.empty(0, "<i8")), pa.array(ids, pa.binary()), pa.array(sims, pa.binary())], ["node", "ids", "sims"])

    found = arrow_pass(around.select("near"), compare, "node long, ids binary, sims binary")
    out = cut(_gather(found.unionByName(graph), k), "graph")
    drop(graph)
    return out


def build_graph(nodes: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """((node, ids, sims) graph of all bands, (node, band, q) vectors in 8 bits, size of each band).

    Lengths are parts of the longest; band ``b`` holds those above 2 ** -(b + 1), up to 2 ** -b.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(directions(rows(b.column(0).to_pylist(), "<f8"))[1] if len(b) else [], pa.float64())], ["n"])

    longest = arrow_pass(nodes.select("vec"), lengths, "n double").agg(F.max("n").alias("n")).first()["n"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = directions(rows(b.column(1).to_pylist(), "<f8"))
            less = np.minimum(longest - n, LAST_BAND)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.floor(less).astype(np.int32)), pa.array(_pack8(x, np.exp2(-less)), pa.binary())], ["node", "band", "q"])

    eight = cut(arrow_pass(nodes.select("node", "vec"), pack, "node long, band int, q binary"), "eight-bit")
    sizes = {r["band"]: r["n"] for r in eight.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    graph = _start(eight, sizes, k)
    for _ in range(rounds):
        graph = _descend(graph, eight, k)
    return graph, eight, sizes


def entries(n: int) -> int:
    """How many vectors of a band of n a search is compared with before it walks the graph."""
    return min(ENTRIES, n, math.ceil(8 * math.sqrt(n)))


def _entries(eight: DataFrame, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(band, node, q), by band, of about ``entries`` vectors of each."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rate = np.array([entries(sizes[i]) / sizes[i] for i in b.column(1).to_pylist()])
            yield b.filter(pa.array((mix(b.column(0).to_numpy().view(np.uint64) + np.uint64(1)) >> np.uint64(11)) * 2.0**-53 < rate))

    got = sorted(arrow_pass(eight.select("node", "band", "q"), pick, "node long, band int, q binary").collect(), key=lambda r: (r["band"], r["node"]))
    return np.array([r["band"] for r in got], np.int32), np.array([r["node"] for r in got], np.int64), [bytes(r["q"]) for r in got]


def _search(queries: DataFrame, graph: DataFrame, eight: DataFrame, sizes: dict[int, int], top: int) -> DataFrame:
    """(node, ids, sims): for each query vector (node) and band that can matter the best ``HELD`` vectors found."""
    bands, nodes, packed = _entries(eight, sizes)
    edge = [(int(b), int(np.searchsorted(bands, b)), int(np.searchsorted(bands, b, "right"))) for b in np.unique(bands)]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, length = _unpack8(packed)
        y = y * length[:, None]
        for batch in batches:
            for at in range(0, len(batch), 256):
                b = batch.slice(at, 256)
                me, own, q = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
                x, mine = _unpack8(q)
                s = x @ y.T
                # what top others reach besides the query's own vector; 0.02 is more than 8 bits may add
                least = np.partition(s, -top - 1, axis=1)[:, -top - 1] if len(nodes) > top else np.full(len(b), -np.inf)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for r in range(len(b)):
                    for band, lo, hi in edge:
                        if (1 + 0.02) * 2.0**-band < least[r]:
                            break
                        i, v = nodes[lo:hi], s[r, lo:hi]
                        if band == own[r]:
                            i, v = np.append(i, me[r]), np.append(v, mine[r] * float(x[r] @ x[r]))
                        i, v = best(i, v, HELD)
                        for column, value in zip(out, (me[r], band, q[r], i, v, np.zeros(len(i), bool).tobytes()), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), *_lists(out[3], out[4]), pa.array(out[5], pa.binary()), pa.array([True] * len(out[0]))], ["node", "band", "q", "ids", "sims", "done", "open"])

    schema = "node long, band int, q binary, ids binary, sims binary, done binary, open boolean"
    state = cut(arrow_pass(queries.select("node").distinct().join(eight, "node").select("node", "band", "q"), begin, schema), "search")
    flat = _edges(graph).select("node", "other").join(eight.select(F.col("node").alias("other"), "q"), "other")
    # the graph's vectors beside its edges, dealt by node once for all steps
    near = flat.groupBy("node").agg(F.collect_list(F.struct("other", "q")).alias("near"))
    near = near.persist()

    def frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, band, q, to = [], [], [], []
            for node, k, vec, ids, done in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3, 5)), strict=True):
                ids, done = np.frombuffer(ids, "<i8"), np.frombuffer(done, bool)
                for x in ids[~done][:WIDTH].tolist():
                    who.append(node)
                    band.append(k)
                    q.append(vec)
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(band, pa.int32()), pa.array(q, pa.binary()), pa.array(to, pa.int64())], ["query", "band", "q", "node"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sims = [], []
            for q, near in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                y, length = _unpack8([y["q"] for y in near])
                ids.append(np.array([y["other"] for y in near], "<i8"))
                sims.append((y @ _unpack8([q])[0][0]) * length)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_lists(ids, sims)], ["node", "band", "ids", "sims"])

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out_i, out_s, flags, open_ = [], [], [], []
            for ids, sims, done, parts in zip(*(b.column(i).to_pylist() for i in (3, 4, 5, 6)), strict=True):
                ids, sims, done = np.frombuffer(ids, "<i8"), np.frombuffer(sims, "<f4"), np.frombuffer(done, bool)
                was = np.concatenate((ids[done], ids[~done][:WIDTH]))
                parts = parts or []
                i = np.concatenate([ids, *(np.frombuffer(p["ids"], "<i8") for p in parts)])
                s = np.concatenate([sims, *(np.frombuffer(p["sims"], "<f4") for p in parts)])
                i, s = best(i, s, HELD)
                out_i.append(i)
                out_s.append(s)
                seen = np.isin(i, was)
                flags.append(seen.tobytes())
                open_.append(not seen.all())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *_lists(out_i, out_s), pa.array(flags, pa.binary()), pa.array(open_, pa.bool_())], ["node", "band", "q", "ids", "sims", "done", "open"])

    # a walk ends: a vector is expanded once, and one that falls out of a list of ever better ones does not come back
    while state.where("open").limit(1).count():
        steps = arrow_pass(state.where("open"), frontier, "query long, band int, q binary, node long").join(near, "node").select("query", "band", "q", "near")
        found = arrow_pass(steps, look, "node long, band int, ids binary, sims binary").groupBy("node", "band").agg(F.collect_list(F.struct("ids", "sims")).alias("parts"))
        state = cut(arrow_pass(state.join(found, ["node", "band"], "left").select("node", "band", "q", "ids", "sims", "done", "parts"), advance, schema), "search")
    near.unpersist()
    return state.select("node", "ids", "sims")


def search(vectors: DataFrame, is_query: F.Column, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (over vec_id) its ``top`` nearest others found.

    Nearness is the inner product in double precision; equal scores go to the smaller vec_id. Vectors that are
    null, empty, zero, hold a null or non-finite component, or have no id take no part. Vectors are compared with those of
    as many components, each such length being an index of its own. Rows that repeat an id and vector count once. An id with
    several vectors is named once, with the best of their scores, and searches with all of them; it is never its own neighbour. With
    fewer candidates than ``top`` all are returned. Other columns are ignored; an empty table gives an empty one.
    """
    everything = _index(vectors, id_col, vec_col)
    dims = sorted(r["dim"] for r in everything.select("dim").distinct().collect())
    found = [_search_dim(everything.where(F.col("dim") == d), is_query, top) for d in dims]
    schema = "query_id long, rank int, vec_id long, score double"
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], schema)


def _search_dim(all_rows: DataFrame, is_query: F.Column, top: int) -> DataFrame:
    nodes = all_rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    # vectors have numbers apart from ids, which may repeat; the order of the numbers is that of the ids, so ties go to the smaller id
    order = ["least", "h1", "h2"]
    nodes = cut(nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "nodes")
    graph, eight, sizes = build_graph(nodes)
    asked = all_rows.where(is_query).select("vec_id", "h1", "h2").distinct().join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "node")
    found = _search(asked, graph, eight, sizes, top)

    def shortlist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for parts in b.column(1).to_pylist():
                i, s = (np.frombuffer(b"".join(p[c] for p in parts), kind) for c, kind in (("ids", "<i8"), ("sims", "<f4")))
                ids.append(best(i, s, max(RESCORE, 3 * top))[0])
            node = np.repeat(b.column(0).to_numpy(), [len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.concatenate(ids) if ids else np.empty(0, "<i8"))], ["node", "other"])

    found = found.groupBy("node").agg(F.collect_list(F.struct("ids", "sims")).alias("parts"))
    pairs = arrow_pass(found, shortlist, "node long, other long")
    pairs = pairs.join(nodes.select("node", F.col("vec").alias("a")), "node").join(nodes.select(F.col("node").alias("other"), F.col("vec").alias("b")), "other").select("node", "other", "a", "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (rows(b.column(i).to_pylist(), "<f8") if len(b) else np.empty((0, 1)) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", x, y))], ["node", "other", "score"])

    scored = arrow_pass(pairs, exact, "node long, other long, score double")
    copies = _copies(all_rows, nodes, top).withColumnsRenamed({"node": "other"})
    rows_ = asked.join(scored, "node").join(copies, "other").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
