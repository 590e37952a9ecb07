"""Connected components of a link table by alternating star contraction, all in joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, cut

_HELD = 1_000_000


class Forest:
    """Union-find over integers; a tree's root is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top and x != top:
            up[x] = top
            x = p
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        a = [x for x in self.up if self.up[x] != x]
        return np.array(a, np.int64), np.array([self.root(x) for x in a], np.int64)


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    out = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in forest.links()], ["u", "v"])
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.join(x, y)
        if len(forest.up) > _HELD:
            yield out()
            forest = Forest()
    yield out()


def connected(links: DataFrame, a: str = "a", b: str = "b", shrink: bool = True) -> DataFrame:
    """(node, root) for every node with a link; ``root`` is the smallest node it reaches.

    Each task first shrinks its links to a forest (without ``shrink`` they are taken as they are); then every round ties each node's larger neighbours, and
    then its smaller ones, to the smallest, until nothing changes (a number of rounds logarithmic in the
    longest path in practice). Only minima are aggregated and joins are left for Spark to split where a node
    is hot, so a star of any size needs no single task.
    """
    now = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = cut((arrow_pass(now, _shrink, "u long, v long") if shrink else now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")).distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        if not state["n"] or state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
