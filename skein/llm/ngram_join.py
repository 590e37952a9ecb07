"""N-gram Jaccard join over prefix trees.

A document's set are the hashes of its word shingles; equal sets are one throughout.

Two sets that link differ in a bounded number H of elements, which follows from the threshold and their sizes. The hash values are cut
into H + 1 ranges, so linked sets agree wholly in one range at least, and each set is filed under what it holds in every
range. Sizes fall into classes, each with its own H; a set that may link with one of the class below is filed there too. A
range of some ten elements is alike by chance in no two unrelated texts, however many texts hold each of its
shingles, so the candidates grow with the copies and not with the square of the corpus.

Where the threshold is so low that a range would hold fewer than ``FULL`` elements, sets are filed by single elements. All sets are in one global order then:
rare shingles first, by a sketch of how often each occurs in the corpus, then by hash. Of two sets with a Jaccard similarity of at
least t, the first n - ceil(t n) + 1 elements of both in that order have one in common (n: the set's size), so each
set is filed under these. The sketch is a table of ``WIDTH`` counters; it only orders, so whatever it counts together costs time,
never a link. A shingle that many texts share stands last and files almost nothing.

Sets filed alike are candidates, named around the least of them. Those of single elements are many; a bitmap of each set (a bit an element, two bits
of room each) bounds from above what two sets can share: elements of one whose bits the other lacks are not common. A group falls
apart into the parts that this bound still ties together. Only sets of candidates are read, and compared in prefix trees:

* the sets of a group, most common elements first, share their paths in a compressed tree;
* a probe walks the tree level by level with the overlap counted so far for each node, once for all sets below;
* a subtree is left where the overlap so far and what can remain, of the probe after the node's last element or
  of the longest set below, cannot reach what the shortest set below needs.

A group too large for a task is compared in blocks; first the members that link
with the group's least set are settled, and only the others are probed against all.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass, as_bytes, cut, drop, each_group, mix, shingles, spread_join
from .components import connected

BLOCK_ELEMENTS, MEMBERS = 1 << 21, 1 << 12
#: counters of the sketch, sent to every task as a byte each
WIDTH, _CHUNK = 1 << 20, 1 << 16
#: elements a range of hash values must hold on average for sets to be filed by ranges
FULL = 6
#: a table of 2 ** SOME bits tells which texts are read again
SOME = 24
_SALT, _ALL = np.uint64(0xA0761D6478BD642F), (1 << 64) - 1


def enough(overlap, a, b, num: int, den: int):
    """Is overlap / union at least num / den, in integers."""
    return den * overlap >= num * (a + b - overlap)


def set_id(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    with np.errstate(over="ignore"):
        a, b = int(mix(np.array([s.sum() + np.uint64(len(s))]))[0]), int(mix(s).sum())
    return a - (1 << 63), b - (1 << 63)


class Ranges:
    """Classes of set sizes for a threshold, and how many ranges of hash values each is cut into."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        up = lambda a: max(a + 1, (a - 1) * den // num + 1)  # noqa: E731  beyond what a set smaller than ``a`` links with
        low = [1]
        while low[-1] < 1 << 40:
            low.append(up(up(low[-1])))
        self.low = low
        # linked sets, the smaller of at most a elements, differ in at most (a + b) (den - num) / (den + num), b being the largest size that links with a
        self.parts = [((a - 1) + (a - 1) * den // num) * (den - num) // (den + num) + 1 for a in low[1:]]

    def files(self, s: np.ndarray) -> np.ndarray:
        """What a set is filed under: any two sets that link, unless equal, have one in common."""
        c = bisect_right(self.low, len(s)) - 1
        below = c and -(-self.num * len(s) // self.den) < self.low[c]
        found = [self._of(s, i) for i in ((c, c - 1) if below else (c,)) if self.parts[i] > 1]
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    def _of(self, s: np.ndarray, c: int) -> np.ndarray:
        k = self.parts[c]
        name, empty = _ranges(s, k, (c + 1) << 32)
        if not empty.any():
            return name
        # many sets agree in having nothing in a range; these are parted once more by other hash values
        again = np.sort(mix(s ^ _SALT))
        return np.concatenate((name[~empty], *(_ranges(again, k, (c + 1) << 32 | (i + 1) << 44)[0] for i in np.flatnonzero(empty).tolist())))


def _ranges(s: np.ndarray, k: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of what a sorted set holds in each of ``k`` equal ranges, told apart by range and ``tag``; and which are empty."""
    edge = np.concatenate(([0], np.searchsorted(s, np.arange(1, k, dtype=np.uint64) * np.uint64((1 << 64) // k)), [len(s)]))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)))
    name = mix(total[edge[1:]] - total[edge[:-1]] + mix(np.arange(k, dtype=np.uint64) + np.uint64(tag & _ALL)))
    return name, edge[1:] == edge[:-1]


def levels(counts: np.ndarray) -> np.ndarray:
    """A counter's place in the global order: 0 up to what chance puts into one (the median and three deviations), then one more for each doubling of the excess."""
    base = float(np.median(counts))
    unit = max(1.0, base**0.5)
    many = (counts - base - 3 * unit) / unit
    return np.where(many > 0, np.floor(np.log2(np.maximum(many, 1))) + 1, 0).astype(np.uint8)


def prefix(s: np.ndarray, level: np.ndarray, num: int, den: int) -> np.ndarray:
    """The elements of a set that it is filed under, rarest first."""
    n = len(s) - -(-num * len(s) // den) + 1
    return s[np.lexsort((s, level[s & np.uint64(len(level) - 1)]))[:n]]


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each element, at its low bits modulo a power of two, at least twice the set's size; half of it is the OR of its halves."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(s >> np.uint64(20)) & np.uint64(width - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(n: np.ndarray, bits: list[bytes], num: int, den: int) -> np.ndarray:
    """Least number of each set's part, where sets are tied if their bitmaps leave enough elements that may be common."""
    label = np.arange(len(n))
    width = np.array([len(x) for x in bits])
    for w in np.unique(width).tolist():
        # the sets that may link with one of this width and are not smaller
        at = np.flatnonzero((width >= w) & (num * width <= 2 * den * w))
        at = at[np.argsort(n[at], kind="stable")]
        b = np.stack([np.bitwise_or.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, w // 8), 0) for i in at])
        size = n[at]
        for i in range(1, len(at)):
            j = np.arange(np.searchsorted(size, -(-num * size[i] // den)), i)  # not larger, and large enough
            if not len(j):
                continue
            here, there = b[i], b[j]
            most = np.minimum(size[i] - np.bitwise_count(here & ~there).sum(1, dtype=np.int64), size[j] - np.bitwise_count(there & ~here).sum(1, dtype=np.int64))
            hit = at[j[enough(most, size[i], size[j], num, den)]]
            found = np.unique(np.append(label[hit], label[at[i]]))
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
    return label


class PrefixTree:
    """Compressed tree over sets of integers; every node knows the sizes below it."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        flat = np.concatenate(sets)
        self.vocab, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(self.vocab), np.int64)
        rank[np.lexsort((self.vocab, -n))] = np.arange(len(self.vocab))
        self.rank = rank
        edge = np.cumsum([0] + [len(s) for s in sets])
        rows = [np.sort(rank[inverse[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        order = sorted(range(len(rows)), key=lambda i: rows[i].astype(">i8").tobytes())
        parent, start, end, depth, leaf = [-1], [0], [0], [0], [-1]
        stack, flat_rank, used, last = [0], [], 0, np.empty(0, np.int64)
        for i in order:
            row = rows[i]
            k = min(len(row), len(last))
            differs = np.flatnonzero(row[:k] != last[:k])
            lcp = int(differs[0]) if len(differs) else k
            below = -1
            while depth[stack[-1]] > lcp:
                below = stack.pop()
            top = stack[-1]
            if depth[top] < lcp:  # part the edge into ``below`` where the paths part
                cutoff = start[below] + lcp - depth[top]
                parent.append(top)
                start.append(start[below])
                end.append(cutoff)
                depth.append(lcp)
                leaf.append(-1)
                top = len(parent) - 1
                parent[below], start[below] = top, cutoff
                stack.append(top)
            parent.append(top)
            start.append(used)
            used += len(row) - lcp
            end.append(used)
            depth.append(len(row))
            leaf.append(i)
            flat_rank.append(row[lcp:])
            stack.append(len(parent) - 1)
            last = row
        self.flat = np.concatenate(flat_rank)
        self.parent, self.start, self.end, self.depth, self.leaf = (np.array(x, np.int64) for x in (parent, start, end, depth, leaf))
        self.least = np.full(len(parent), np.iinfo(np.int64).max)
        self.most = np.zeros(len(parent), np.int64)
        has = self.leaf >= 0
        self.least[has] = self.most[has] = np.asarray(sizes)[self.leaf[has]]
        down = np.argsort(-self.depth, kind="stable")
        for v in down.tolist():  # children lie deeper than their parents
            if (p := parent[v]) >= 0:
                self.least[p] = min(self.least[p], self.least[v])
                self.most[p] = max(self.most[p], self.most[v])
        by = np.argsort(self.parent, kind="stable")[1:]
        self.kids = by
        at = np.searchsorted(self.parent[by], np.arange(len(parent) + 1))
        self.kid_lo, self.kid_hi = at[:-1], at[1:]
        self.tail = np.where(self.end > self.start, self.flat[np.maximum(self.end, 1) - 1], -1)

    def probe(self, s: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Numbers of the sets that link with a set of ``size`` elements, ``s`` being those to look up."""
        at = np.minimum(np.searchsorted(self.vocab, s), len(self.vocab) - 1)
        mine = self.rank[at[self.vocab[at] == s]]
        inside = np.zeros(len(self.vocab) + 1, np.int64)
        inside[mine] = 1
        so_far = np.concatenate(([0], np.cumsum(inside[self.flat])))
        after = np.concatenate((np.cumsum(inside[::-1])[::-1], [0]))  # the probe's elements from a rank on
        out = []
        nodes, have = np.array([0]), np.array([0])
        while len(nodes):
            n = self.kid_hi[nodes] - self.kid_lo[nodes]
            have = np.repeat(have, n)
            first = np.repeat(self.kid_lo[nodes] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            nodes = self.kids[first + np.arange(n.sum())]
            have = have + so_far[self.end[nodes]] - so_far[self.start[nodes]]
            rest = np.minimum(after[self.tail[nodes] + 1], self.most[nodes] - self.depth[nodes])
            need = -(-num * (size + self.least[nodes]) // (num + den))
            alive = have + np.maximum(rest, 0) >= need
            nodes, have = nodes[alive], have[alive]
            full = self.leaf[nodes] >= 0
            hit = nodes[full]
            ok = enough(have[full], size, self.depth[hit], num, den)
            out.append(self.leaf[hit[ok]])
        return np.concatenate(out) if out else np.empty(0, np.int64)


def link_sets(sets: list[np.ndarray], probes: np.ndarray, members: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least number of each set's component, given links between probes and members (boolean masks)."""
    label = np.arange(len(sets))
    at = np.flatnonzero(members)
    if not len(at) or not probes.any():
        return label
    tree = PrefixTree([sets[i] for i in at], np.array([len(sets[i]) for i in at]))
    for i in np.flatnonzero(probes).tolist():
        hit = at[tree.probe(sets[i], len(sets[i]), num, den)]
        found = np.unique(np.append(label[hit], label[i]))
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
    return label


def _sets(k: int, width: int):
    """Rows of documents (doc_id, n, h1, h2), then of the task's part of the sketch (chunk, counts)."""
    names = ["doc_id", "n", "h1", "h2", "chunk", "task", "counts"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.int64)
        for b in batches:
            n, h1, h2, found = [], [], [], []
            for text in as_bytes(b.column(1)):
                s = shingles(text, k)
                x = set_id(s) if len(s) else (None, None)
                n.append(len(s))
                h1.append(x[0])
                h2.append(x[1])
                found.append(s)
            if found:
                counts += np.bincount((np.concatenate(found) & np.uint64(width - 1)).astype(np.int64), minlength=width)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(b), pa.int32()), pa.nulls(len(b), pa.int32()), pa.nulls(len(b), pa.binary())], names)
        parts = {i: x for i, x in enumerate(np.split(counts, max(1, width // _CHUNK))) if x.any()}
        task = TaskContext.get().partitionId()
        cols = [pa.nulls(len(parts), pa.int64())] * 4 + [pa.array(list(parts), pa.int32()), pa.array([task] * len(parts), pa.int32())]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for x in parts.values()], pa.binary())], names)

    return go


def _filed(k: int, num: int, den: int):
    """Rows (doc_id, n, h1, h2, files); no files without a doc_id."""
    ranges = Ranges(num, den)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, out = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                s = shingles(text, k)
                x = set_id(s) if len(s) else (None, None)
                n.append(len(s))
                h1.append(x[0])
                h2.append(x[1])
                out.append(ranges.files(s).view(np.int64) if len(s) and doc is not None else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in out]), pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists], ["doc_id", "n", "h1", "h2", "files"])

    return go


def _sketch(found: DataFrame, width: int) -> np.ndarray:
    """The counters' levels, from all tasks' parts; summed by groups of tasks first."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in pdf["counts"])
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    parts = found.where("chunk is not null").select("chunk", F.pmod("task", F.lit(1024)).alias("some"), "counts")
    parts = parts.groupBy("chunk", "some").applyInPandas(add, "chunk int, counts binary").groupBy("chunk").applyInPandas(add, "chunk int, counts binary")
    counts = np.zeros(width, np.int64)
    for r in parts.collect():  # width / _CHUNK rows at most
        x = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
        counts[r["chunk"] * len(x) : (r["chunk"] + 1) * len(x)] = x
    return levels(counts)


def _prefixes(k: int, num: int, den: int, level):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, h1, h2, bits, out = [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                s = shingles(text, k) if doc is not None else ()
                if len(s):
                    x = set_id(s)
                    docs.append(doc)
                    h1.append(x[0])
                    h2.append(x[1])
                    bits.append(bitmap(s))
                    out.append(prefix(s, level.value, num, den).view(np.int64))
            edge = np.cumsum([0] + [len(x) for x in out])
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bits, pa.binary()), lists], ["doc_id", "h1", "h2", "bits", "shingles"])

    return go


def _place() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << SOME))


def _some(ids: DataFrame) -> np.ndarray:
    """A table of ``2 ** SOME`` bits, those of the ids' hashes set."""
    at, piece = _place(), 1 << 15
    found = ids.select(F.floor(at / piece).alias("piece"), (at % piece).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << SOME) // 8, np.uint8)
    for r in found.collect():  # pieces of 4,096 bytes of one table
        out[4096 * r["piece"] : 4096 * (r["piece"] + 1)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _contents(k: int, bits):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column(2).to_numpy()
            b = b.filter(pa.array(bits.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1))
            got = [(doc, *set_id(s), s.tobytes()) for doc, s in zip(b.column(0).to_pylist(), (shingles(t, k) for t in as_bytes(b.column(1))), strict=True) if len(s)]
            cols = [pa.array([x[i] for x in got], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[3] for x in got], pa.binary())], ["doc_id", "h1", "h2", "elements"])

    return go


def _by_ranges(src: DataFrame, k: int, num: int, den: int, width: int, members: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, distinct sets, candidates), sets filed by ranges of hash values: one pass over the texts, one shuffle of the files."""
    found = cut(arrow_pass(src, _filed(k, num, den), "doc_id long, n long, h1 long, h2 long, files array<long>"), "filed-sets")
    sets = cut(found.drop("files"), "sets")
    filed = found.where("doc_id is not null and h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("files").alias("files"))
    filed = cut(filed.withColumn("id", F.monotonically_increasing_id()), "filed")
    drop(found)
    distinct = cut(filed.drop("files"), "distinct-sets")
    rows = filed.select("id", F.explode("files").alias("file")).withColumn("rep", F.min("id").over(Window.partitionBy("file")))
    near = cut(rows.where("id <> rep").select("rep", "id").distinct(), "candidates")
    drop(filed)
    return sets, distinct, near


def _by_elements(src: DataFrame, k: int, num: int, den: int, width: int, members: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, distinct sets, candidates), sets filed under the elements of their prefixes; bitmaps part the candidates."""
    spark = src.sparkSession
    found = cut(arrow_pass(src, _sets(k, width), "doc_id long, n long, h1 long, h2 long, chunk int, task int, counts binary"), "sets")
    level = spark.sparkContext.broadcast(_sketch(found, width))
    sets = found.where("chunk is null").select("doc_id", "n", "h1", "h2")
    distinct = sets.where("doc_id is not null and h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    distinct = cut(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-sets")
    filed = arrow_pass(src, _prefixes(k, num, den, level), "doc_id long, h1 long, h2 long, bits binary, shingles array<long>")
    filed = cut(filed.join(distinct, ["doc_id", "h1", "h2"]).select("id", "n", "bits", "shingles").dropDuplicates(["id"]), "filed")
    rows = filed.select("id", F.explode("shingles").alias("shingle"))
    files = cut(rows.groupBy("shingle").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select("shingle", "rep"), "files")
    pairs = cut(rows.join(files, "shingle").where("id <> rep").select("rep", "id").distinct(), "candidates")
    drop(files)

    def part(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        group = group.sort_by("id")
        id_, label = group.column("id").to_numpy(), may_link(group.column("n").to_numpy(), group.column("bits").to_pylist(), num, den)
        at = np.flatnonzero(label != np.arange(len(id_)))
        return id_[label[at]], id_[at]

    # groups that are too large for a task go on whole
    wide = cut(pairs.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= members), "wide-groups").select("rep")
    some = pairs.join(wide, "rep", "left_anti")
    some = some.unionByName(some.select("rep", F.col("rep").alias("id")).distinct()).join(filed.select("id", "n", "bits"), "id")
    near = each_group(some, ["rep"], part, "rep long, id long").unionByName(pairs.join(wide, "rep", "left_semi"))
    near = cut(near.distinct(), "parts")
    drop(filed, pairs)
    return sets, distinct, near


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_ELEMENTS, width: int = WIDTH, members: int = MEMBERS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row, linking texts with Jaccard similarity >= num / den (above 0).

    Words are runs without ASCII white space, A-Z lower-cased; sets hold distinct ``k``-word shingles, a shorter
    text is one shingle, and a null text or one without words has the empty set and links with nothing.
    ``component_id`` is the smallest doc_id reachable. Rows that repeat a doc_id are compared each by their own
    text. Rows without a doc_id get n_shingles, a null component and no links. Other columns are ignored;
    an empty table gives an empty one. Shingles are told apart by 64-bit hashes, sets by 128-bit ones.
    ``width`` (a power of two): counters of the sketch that orders shingles; ``members``, ``block``: sets, and elements, up to which
    a group is one task's.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    by_ranges = num >= FULL * (den - num)
    sets, distinct, near = (_by_ranges if by_ranges else _by_elements)(src, k, num, den, width, members)
    wanted = near.select("id").unionByName(near.select(F.col("rep").alias("id"))).distinct()
    wanted = cut(distinct.join(wanted, "id"), "wanted")
    # texts stay where they are: most that are not wanted go by a table of bits, the rest by the join
    bits = spark.sparkContext.broadcast(_some(wanted))
    contents = arrow_pass(src.select("doc_id", "text", _place().alias("place")), _contents(k, bits), "doc_id long, h1 long, h2 long, elements binary")
    key = ["doc_id", "h1", "h2"]
    contents = cut(contents.dropDuplicates(key).join(wanted, key).select("id", "n", "elements"), "contents")
    sized = near.unionByName(near.select("rep", F.col("rep").alias("id")).distinct()).join(contents.select("id", "n"), "id")
    weight = sized.groupBy("rep").agg(F.sum("n").alias("total"))
    large = cut(weight.where(F.col("total") > block), "large-groups")

    def compare(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        group = group.sort_by("id")
        own = [np.frombuffer(x, np.uint64) for x in group.column("elements").to_pylist()]
        probe, member = (group.column(c).to_numpy() if c in group.column_names else np.ones(len(own), bool) for c in ("probe", "member"))
        label = link_sets(own, probe, member, num, den)
        id_ = group.column("id").to_numpy()
        at = np.flatnonzero(label != np.arange(len(id_)))
        return id_[at], id_[label[at]]

    small = sized.join(large, "rep", "left_anti").select("rep", "id").join(contents, "id")
    links = each_group(small.select("rep", "id", "elements"), ["rep"], compare, "a long, b long")
    if large.limit(1).count():
        links = links.unionByName(_large_groups(sized.join(large, "rep"), contents, compare, num, den, block))
    classes = cut(connected(links, shrink=False), "classes")  # each group's links are a forest already
    drop(near, contents)
    known = cut(distinct.join(classes.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", "doc_id", F.coalesce("root", "id").alias("root")), "known-sets")
    least = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = cut(spread_join(known.select("h1", "h2", "root"), least, ["root"]).select("h1", "h2", "component_id"), "components")
    out = spread_join(sets, known, ["h1", "h2"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _large_groups(members: DataFrame, contents: DataFrame, compare, num: int, den: int, block: int) -> DataFrame:
    """Links of groups of more than ``block`` elements: those with the least set first, the rest in blocks."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append(bool(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), num, den)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ok)], ["rep", "id", "total", "ok"])

    full = members.select("rep", "id", "total").join(contents.select("id", "elements"), "id")
    heads = contents.select(F.col("id").alias("rep"), F.col("elements").alias("head")).join(members.select("rep").distinct(), "rep")
    settled = cut(arrow_pass(full.join(heads, "rep").select("rep", "id", "total", "elements", "head"), verify, "rep long, id long, total long, ok boolean"), "settled")
    star = settled.where("ok and id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    n_all = F.ceil(F.col("total") / F.lit(block)).cast("int")
    open_ = settled.where("not ok").join(contents.select("id", "n"), "id")
    n_open = open_.groupBy("rep").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("n_open"))
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    probes = open_.join(n_open, "rep").select("rep", "id", part(F.col("n_open")).alias("i"), F.explode(F.sequence(F.lit(0), n_all - 1)).alias("j"), F.lit(True).alias("probe"), F.lit(False).alias("member"))
    others = settled.join(n_open, "rep").select("rep", "id", F.explode(F.sequence(F.lit(0), F.col("n_open") - 1)).alias("i"), part(n_all).alias("j"), F.lit(False).alias("probe"), F.lit(True).alias("member"))
    rows = probes.unionByName(others).groupBy("rep", "i", "j", "id").agg(F.max("probe").alias("probe"), F.max("member").alias("member"))
    rest = each_group(rows.join(contents.select("id", "elements"), "id"), ["rep", "i", "j"], compare, "a long, b long")
    return star.unionByName(rest)
