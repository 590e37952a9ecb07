"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Equal vectors of a label are taken together first. A label of more than ``cell`` distinct vectors falls into
cells around pivots (the cover's top level, at most ``MAX_PIVOTS`` in all, so they can be sent to every task);
two cells meet in a task only if their covering radii leave room for a pair. A task grows a cover tree over
each cell's unit vectors (nested levels of centres, radii halving) and walks pairs of nodes: a pair whose
centres are farther apart than the threshold and both covering radii is dropped whole, a pair that lies within
it whole is taken whole, and leaves are compared by cosine. Links are counted with the vectors' numbers of copies
and shrunk to a forest, so no task emits more rows than it reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, cut, spread_join
from .components import Forest, connected
from .vectors import blobs, keys, matrices, rows, scaled

THRESHOLD = 0.98
CELL = 1024
MAX_PIVOTS = 4096
_LEAF = 8
_SLACK = 1e-6  # distances near 0 carry the rounding of a square root


class CoverTree:
    """Nodes hold contiguous runs of ``order``; ``radius`` is the measured distance to the farthest member."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.lo, self.hi, self.radius, self.centre, self.kids = [0], [len(x)], [0.0], [0], [[]]
        self.x = x
        if len(x):
            d = self._far(np.arange(len(x)), 0)
            self.radius[0] = float(d.max())
            self._grow()
        self.x = x[self.order]
        place = np.empty(len(x), np.int64)
        place[self.order] = np.arange(len(x))
        self.centre = place[self.centre] if len(x) else np.empty(0, np.int64)
        self.lo, self.hi, self.radius = np.array(self.lo), np.array(self.hi), np.array(self.radius)

    def _far(self, members: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[members] @ self.x[centre])))

    def _grow(self) -> None:
        todo = [(0, self.radius[0])]
        while todo:
            node, reach = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= _LEAF or self.radius[node] < 1e-7:
                continue
            reach = min(reach, self.radius[node]) / 2
            rest, at = self.order[lo:hi].copy(), lo
            first = self.centre[node]  # a centre stays a centre on every level below
            while len(rest):
                d = self._far(rest, first)
                mine = d <= reach
                mine[rest == first] = True
                got = rest[mine]
                self.order[at : at + len(got)] = got
                self.lo.append(at)
                self.hi.append(at + len(got))
                self.radius.append(float(d[mine].max()) if len(got) > 1 else 0.0)
                self.centre.append(int(first))
                self.kids.append([])
                self.kids[node].append(len(self.lo) - 1)
                todo.append((len(self.lo) - 1, reach))
                at += len(got)
                rest = rest[~mine]
                first = rest[0] if len(rest) else -1


class Links:
    """Weighted link counts and components, over positions 0..n-1."""

    def __init__(self, weight: np.ndarray):
        self.weight = weight
        self.count = np.zeros(len(weight))
        self.label = np.arange(len(weight))  # the least position of each one's component

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        apart = x != y
        if not apart.any():
            return
        n = len(self.label)
        forest = Forest()
        for v in np.unique(np.minimum(x, y)[apart] * n + np.maximum(x, y)[apart]).tolist():
            forest.join(v // n, v % n)
        to = np.arange(n)
        old, new = forest.links()
        to[old] = new
        self.label = to[self.label]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, self.weight[b])
        np.add.at(self.count, b, self.weight[a])
        self.tie(a, b)


def _walk(s: CoverTree, t: CoverTree, s_off: int, t_off: int, reach: float, near, links: Links) -> None:
    """All linked pairs between (or, if they are the same tree, within) two trees."""
    same = s is t
    if not len(s.x) or not len(t.x):
        return

    def take(u: int, v: int) -> None:
        p, q = np.arange(s.lo[u], s.hi[u]) + s_off, np.arange(t.lo[v], t.hi[v]) + t_off
        if same and u == v:
            links.count[p] += links.weight[p].sum() - links.weight[p]
        else:
            links.count[p] += links.weight[q].sum()
            links.count[q] += links.weight[p].sum()
        links.tie(np.full(len(p) + len(q), p[0]), np.concatenate((p, q)))

    apart = math.sqrt(max(0.0, 2 - 2 * float(s.x[s.centre[0]] @ t.x[t.centre[0]])))
    if apart + s.radius[0] + t.radius[0] < reach - _SLACK:
        take(0, 0)
        return
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        ka, kb = s.kids[a], t.kids[b]
        if not ka and not kb:
            p, q = near(s.x[s.lo[a] : s.hi[a]], t.x[t.lo[b] : t.hi[b]], s.lo[a] + s_off, t.lo[b] + t_off)
            if same and a == b:
                keep = p < q
                p, q = p[keep], q[keep]
            if len(p):
                links.pairs(p, q)
            continue
        ka, kb = np.array(ka or [a]), np.array(kb or [b])
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (s.x[s.centre[ka]] @ t.x[t.centre[kb]].T)))
        spread = s.radius[ka][:, None] + t.radius[kb][None, :]
        open_ = d - spread <= reach + _SLACK
        if same and a == b:
            open_ &= ka[:, None] <= kb[None, :]
        whole = open_ & (d + spread < reach - _SLACK)
        for i, j in np.argwhere(whole).tolist():
            take(int(ka[i]), int(kb[j]))
        single = (s.hi[ka] - s.lo[ka] == 1)[:, None] & (t.hi[kb] - t.lo[kb] == 1)[None, :]
        ones = np.argwhere(open_ & ~whole & single)
        if len(ones):
            p, q = s.lo[ka[ones[:, 0]]], t.lo[kb[ones[:, 1]]]
            if same:
                p, q = p[p != q], q[p != q]
            ok = near(s.x[p], t.x[q], p + s_off, q + t_off, True)
            links.pairs(p[ok] + s_off, q[ok] + t_off)
        todo += [(int(ka[i]), int(kb[j])) for i, j in np.argwhere(open_ & ~whole & ~single)]


def link_cells(raw: np.ndarray, weight: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted link counts and component roots of all pairs between side 0 and side 1, or within if all are 0."""
    length = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    unit = raw / length[:, None]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    s = CoverTree(unit[one])
    t = CoverTree(unit[two]) if len(two) else s
    at = np.concatenate((one[s.order], two[t.order])) if len(two) else one[s.order]
    x, n = raw[at], length[at]
    links = Links(weight[at].astype(float))

    def near(_a, _b, p, q, paired: bool = False):
        if paired:
            return np.einsum("ij,ij->i", x[p], x[q]) / (n[p] * n[q]) >= threshold
        u, v = np.arange(p, p + len(_a)), np.arange(q, q + len(_b))
        i, j = np.nonzero((x[u] @ x[v].T) / (n[u][:, None] * n[v][None, :]) >= threshold)
        return u[i], v[j]

    _walk(s, t, 0, len(one) if len(two) else 0, math.sqrt(max(0.0, 2 - 2 * threshold)), near, links)
    count, root = np.zeros(len(raw)), np.arange(len(raw))
    count[at] = links.count
    root[at] = at[links.label]
    return count.astype(np.int64), root


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["vec_id", "label", "dim", "h1", "h2", "vec"]
    for b in batches:
        k = len(b)
        dim, h1, h2 = np.zeros(k, np.int32), np.zeros(k, np.int64), np.zeros(k, np.int64)
        vec: list[bytes | None] = [None] * k
        for at, m in matrices(b.column(2)):
            dim[at] = m.shape[1]
            h1[at], h2[at] = keys(m)
            for i, x in zip(at.tolist(), blobs(scaled(m)[0], "<f8"), strict=True):
                vec[i] = x
        cols = [b.column(0), b.column(1), pa.array(dim), pa.array(h1), pa.array(h2), pa.array(vec, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine is at least
    ``threshold`` (above 0). A vector that is null, zero or holds a null or non-finite component links with
    nothing; neither does a row with a null label or id. Rows that repeat id, label and vector count once in
    ``n_links`` and are returned each. Rows of one id with another vector or label are vectors of their own: ``n_links`` counts
    other (id, vector)s, a shared id ties nothing, and ``kept`` may hold for one of them and not for another. Other columns are
    ignored; an empty table gives an empty one.
    """
    label = F.col(label_col).cast("string").alias("label")
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label, F.col(vec_col).alias("v"))
    read = arrow_pass(src, _read, "vec_id long, label string, dim int, h1 long, h2 long, vec binary")
    group = ["label", "dim", "h1", "h2"]
    good = read.where("dim > 0 and label is not null and vec_id is not null")
    once = good.groupBy(*group).agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("m"), F.first("vec").alias("vec"))
    # vectors have numbers apart from ids, which may repeat; the order of the numbers is that of the ids
    order = ["least", "h1", "h2", "label", "dim"]
    once = cut(once.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    cell = max(cell, -(-once.count() // MAX_PIVOTS))
    # labels of more than ``cell`` vectors: at most MAX_PIVOTS of them
    large = {(r["label"], r["dim"]): r["n"] for r in once.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).collect()}
    pivots: dict[tuple[str, int], np.ndarray] = {}
    if large:
        rate = F.create_map(*[x for (a, d), n in large.items() for x in (F.lit(f"{d}:{a}"), F.lit(2.0 / cell))])[F.concat_ws(":", "dim", "label")]
        pick = once.where(rate.isNotNull() & (F.pmod(F.col("h2"), F.lit(1 << 30)) < rate * (1 << 30)))
        for r in pick.select("label", "dim", "vec", "h1").orderBy("label", "dim", "h1").limit(4 * MAX_PIVOTS).collect():
            pivots.setdefault((r["label"], r["dim"]), []).append(np.frombuffer(r["vec"], "<f8"))
        pivots = {k: (x := np.stack(v)) / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] for k, v in pivots.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, far = np.zeros(len(b), np.int32), np.zeros(len(b))
            names, dims, vec = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist()
            for key in set(zip(names, dims, strict=True)) & pivots.keys():
                at = np.array([i for i, k in enumerate(zip(names, dims, strict=True)) if k == key])
                x = rows([vec[i] for i in at], "<f8")
                x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                sim = x @ pivots[key].T
                where[at] = sim.argmax(1)
                far[at] = np.sqrt(np.maximum(0.0, 2 - 2 * sim.max(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(where), pa.array(far)], ["label", "dim", "rep", "m", "vec", "cell", "far"])

    placed = arrow_pass(once.select("label", "dim", "rep", "m", "vec"), assign, "label string, dim int, rep long, m long, vec binary, cell int, far double")
    radii: dict[tuple[str, int], np.ndarray] = {k: np.full(len(p), -np.inf) for k, p in pivots.items()}
    if pivots:
        placed = cut(placed, "cells")
        for r in placed.groupBy("label", "dim", "cell").agg(F.max("far").alias("far")).where(F.concat_ws(":", "dim", "label").isin([f"{d}:{a}" for a, d in pivots])).collect():
            radii[r["label"], r["dim"]][r["cell"]] = r["far"]
    reach = math.sqrt(2 - 2 * threshold)

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}

        def of(key: tuple[str, int, int]) -> list[int]:
            if key not in cache:
                p, r = pivots.get(key[:2]), radii.get(key[:2])
                if p is None:
                    cache[key] = [key[2]]
                else:
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * (p @ p[key[2]])))
                    cache[key] = np.flatnonzero(d <= reach + r + r[key[2]] + _SLACK).tolist()
            return cache[key]

        for b in batches:
            got = [of(k) for k in zip(*(b.column(i).to_pylist() for i in (0, 1, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(got, pa.list_(pa.int32()))], ["label", "dim", "rep", "m", "vec", "cell", "others"])

    spread = arrow_pass(placed, partners, "label string, dim int, rep long, m long, vec binary, cell int, others array<int>")
    other = F.explode("others").alias("other")
    spread = spread.select("label", "dim", "rep", "m", "vec", "cell", other).select("label", "dim", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), (F.col("cell") > F.col("other")).cast("int").alias("side"), "rep", "m", "vec")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        rep = pdf["rep"].to_numpy(np.int64)
        order = np.argsort(rep)
        count, root = link_cells(rows(pdf["vec"].tolist(), "<f8")[order], pdf["m"].to_numpy()[order], pdf["side"].to_numpy()[order], threshold)
        rep = rep[order]
        out = pd.DataFrame({"rep": rep, "links": count, "root": rep[root]})
        return out[out["links"] > 0]

    found = cut(spread.groupBy("label", "dim", "i", "j").applyInPandas(compare, "rep long, links long, root long"), "vector-links")
    classes = cut(connected(found.where("rep <> root"), "rep", "root"), "classes")
    # the root is the component's smallest number, so its id is the smallest
    classes = spread_join(classes, once.select(F.col("rep").alias("root"), F.col("least").alias("first")), ["root"]).select(F.col("node").alias("rep"), "first")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = once.select(*group, "rep", "m", "least").join(counts, "rep", "left").join(classes, "rep", "left").select(*group, (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
    out = read.select("vec_id", *group).join(known, group, "left")
    mine = F.col("vec_id").isNotNull()
    component = F.when(mine, F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.when(mine, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
