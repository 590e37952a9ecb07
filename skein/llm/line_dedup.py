"""Line dedup: a sharded minimal perfect hash over the distinct line keys, probed by the documents.

1. every document gives its distinct line keys as 128-bit hashes; per key the smallest and the largest
   doc_id are combined before and after the shuffle, so a line that all documents hold costs one row a task;
2. each shard of the hash space builds a minimal perfect hash (levels of bit arrays with ranks) that indexes
   three compact arrays: fingerprint, document count (saturating at 2) and first doc_id;
3. documents send 24-byte probes to the shards; a shard that would get too many probes (a hot line) is read
   by several tasks, each with a copy of its arrays, so no line of text and no posting list is ever joined;
4. answers (only lines that go) are joined to the texts by doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, arrow_pass, as_bytes, cut, mix

MIN_CODE_POINTS = 10
KEYS_PER_SHARD = 1 << 16
PROBES_PER_TASK = 1 << 17
_GAMMA = 1.5
_TAIL = re.compile(rb"[\x80-\xbf]")


def line_key(line: bytes) -> bytes:
    return line.strip(WS).lower()  # bytes.lower() folds A-Z only


def _hash(key: bytes) -> tuple[int, int] | None:
    n = len(key)
    if n < MIN_CODE_POINTS or n < 4 * MIN_CODE_POINTS and n - len(_TAIL.findall(key)) < MIN_CODE_POINTS:
        return None
    v = xxhash.xxh3_128_intdigest(key)
    return (v >> 64) - (1 << 63), (v & (1 << 64) - 1) - (1 << 63)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, h1, h2 = [], [], []
        for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
            if doc is None or len(text) < MIN_CODE_POINTS:
                continue
            got = {_hash(k) for k in {line_key(x) for x in text.split(b"\n")}}
            got.discard(None)
            for a, c in got:
                ids.append(doc)
                h1.append(a)
                h2.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, h1, h2)], ["doc_id", "h1", "h2"])


class PerfectHash:
    """Maps n distinct 64-bit keys onto 0..n-1. Keys that collide in one bit array go on to the next."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.base = np.cumsum([0] + [int(x.sum()) for x in bits])
        self.rank = [np.cumsum(x) - 1 for x in bits]

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, level = [], 0
        while len(keys):
            size = int(len(keys) * _GAMMA) + 2
            at = cls._at(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            keys = keys[~alone[at]]
            level += 1
        return cls(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; of a key that was not in the build, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bit in enumerate(self.bits):
            at = self._at(keys[left], level, len(bit))
            hit = bit[at]
            out[left[hit]] = self.base[level] + self.rank[level][at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.bits], b"".join(np.packbits(x).tobytes() for x in self.bits)

    @classmethod
    def load(cls, sizes: list[int], blob: bytes) -> PerfectHash:
        bits, at = [], 0
        for n in sizes:
            nb = (n + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(blob, np.uint8, nb, at), count=n).astype(bool))
            at += nb
        return cls(bits)


def _place(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h1.astype(np.int64).view(np.uint64) ^ mix(h2.astype(np.int64).view(np.uint64))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _place(pdf["h1"].to_numpy(), pdf["h2"].to_numpy())
    mph = PerfectHash.build(keys)
    at = mph.slots(keys)
    n = len(keys)
    fp, count, first = np.zeros(n, np.int64), np.zeros(n, np.uint8), np.zeros(n, np.int64)
    fp[at], count[at], first[at] = pdf["h2"], np.where(pdf["first"] == pdf["last"], 1, 2), pdf["first"]
    sizes, blob = mph.dump()
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "sizes": [sizes], "bits": [blob], "fp": [fp.tobytes()], "cnt": [count.tobytes()], "first": [first.tobytes()], "probes": [int(pdf["n"].sum())]})


def _probe(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(probes) or not len(index):
        return pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "key": pd.Series([], dtype=object)})
    row = index.iloc[0]
    mph = PerfectHash.load(list(row["sizes"]), row["bits"])
    fp, count, first = np.frombuffer(row["fp"], np.int64), np.frombuffer(row["cnt"], np.uint8), np.frombuffer(row["first"], np.int64)
    h1, h2, doc = (probes[c].to_numpy() for c in ("h1", "h2", "doc_id"))
    at = mph.slots(_place(h1, h2))
    goes = (at >= 0) & (fp[at] == h2) & (count[at] > 1) & (first[at] != doc)
    packed = np.stack((h1[goes], h2[goes]), 1).astype("<i8")
    return pd.DataFrame({"doc_id": doc[goes], "key": [x.tobytes() for x in packed]})


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key): the line keys, as 16-byte hashes, that ``doc_id`` loses since a smaller doc_id holds them."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = arrow_pass(src, _keys, "doc_id long, h1 long, h2 long")
    keys = cut(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")), "line-keys")
    shards = max(1, -(-keys.count() // KEYS_PER_SHARD))
    shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")
    index = cut(keys.select(shard, "h1", "h2", "first", "last", "n").groupBy("shard").applyInPandas(_build, "shard int, sizes array<long>, bits binary, fp binary, cnt binary, first binary, probes long"), "line-index")
    copies = F.ceil(F.col("probes") / F.lit(PROBES_PER_TASK)).cast("int")
    # one short row a shard: joined, and broadcast by Spark only where its own size limit allows
    sizes = index.select("shard", copies.alias("copies"))
    probes = rows.select("doc_id", "h1", "h2", shard).join(sizes, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int").alias("copy"), "doc_id", "h1", "h2")
    spread = index.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("probes")
    return probes.groupBy("shard", "copy").cogroup(spread.groupBy("shard", "copy")).applyInPandas(_probe, "doc_id long, key binary")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = b.schema.names
        at = names.index("_text")
        texts, n_lines, n_dropped = [], [], []
        raw = b.column(at)
        for text, gone in zip(raw.to_pylist(), b.column(names.index("_gone")).to_pylist(), strict=True):
            if not gone:
                texts.append(text)
                n_lines.append((text or "").count("\n") + 1)
                n_dropped.append(0)
                continue
            gone = set(gone)
            lines = text.encode().split(b"\n")
            kept = []
            for x in lines:
                h = _hash(line_key(x))
                if h is None or np.array(h, "<i8").tobytes() not in gone:
                    kept.append(x)
            texts.append(b"\n".join(kept).decode())
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        cols = [b.column(i) for i, x in enumerate(names) if x not in ("_text", "_gone")]
        cols += [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, [x for x in names if x not in ("_text", "_gone")] + ["text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents without the lines that a smaller doc_id already holds: (doc_id, *keep, text, n_lines, n_dropped).

    A line's key is the line without ASCII white space at both ends and with A-Z lower-cased; keys under ten
    code points never go. Null text stays null and counts as one empty line. Rows without a doc_id pass
    through untouched. Rows that repeat a doc_id count as one document; each loses the same keys. Columns
    other than those to ``keep`` are ignored, whatever their names. An empty table gives an empty one.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias("_text"))
    gone = repeated_lines(docs, id_col, text_col).groupBy("doc_id").agg(F.collect_set("key").alias("_gone"))
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return arrow_pass(src.join(gone, "doc_id", "left").select("doc_id", *keep, "_text", "_gone"), _rewrite, f"doc_id long, {fields}text string, n_lines long, n_dropped long")
