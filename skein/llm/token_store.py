"""Training-order materialisation: fixed-length sequences in a keyed pseudo-random order.

Sequences get running numbers 0..n-1; a Feistel network keyed by the seed, with cycle-walking where it leaves
that range, maps each number to its slot, a permutation that needs no sort and no table. Ranges of slots
are written as shards, plain files of fixed-stride records, so slot s is at byte (s % per_shard) * stride of shard
s // per_shard, and a training run resumes from a slot alone. A record is the number of its ids (4 bytes), its ids, padded,
and a line feed (Spark's text writer ends each record with one). The store is written a range of shards at a time; each
range has a folder and, once whole, rows in the manifest, so writing resumes with the first range that is missing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, mix, setting
from .tokens import bpe, default_paths

LENGTH = 2048
PER_SHARD = 512
END_ID = 1
PAD_ID = 0
_ROUNDS = 6


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1, elementwise."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(_ROUNDS):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & (1 << 64) - 1)
            left, right = right, left ^ (mix(right + salt) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _dtype(vocab_size: int) -> str:
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


def sequences(docs: DataFrame, id_col: str, text_col: str, length: int, vocab: str, ranks: str) -> DataFrame:
    """(part, idx, n_ids, ids): the documents' ids, each document closed by END_ID, cut every ``length`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocab, ranks)
        kind = _dtype(len(coder.pieces))
        part, idx, held, size = TaskContext.get().partitionId(), 0, [], 0
        end = np.array([END_ID], "<u4")

        def out(rows: np.ndarray, n_ids: list[int]) -> pa.RecordBatch:
            nonlocal idx
            k = len(rows)
            cols = [pa.array([part] * k, pa.int32()), pa.array(range(idx, idx + k), pa.int64()), pa.array(n_ids, pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())]
            idx += k
            return pa.RecordBatch.from_arrays(cols, ["part", "idx", "n_ids", "ids"])

        for b in batches:
            for text in b.column(1).to_pylist():
                held += [np.frombuffer(coder.encode(text), "<u4"), end]
            size = sum(map(len, held))
            if size >= 64 * length:
                flat = np.concatenate(held)
                k = size // length
                yield out(flat[: k * length].astype(kind).reshape(k, length), [length] * k)
                held = [flat[k * length :]]
        flat = np.concatenate(held) if held else np.empty(0, "<u4")
        if len(flat):
            k = -(-len(flat) // length)
            full = np.full(k * length, PAD_ID, kind)
            full[: len(flat)] = flat
            yield out(full.reshape(k, length), [length] * (k - 1) + [len(flat) - (k - 1) * length])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_pass(src, run, "part int, idx long, n_ids int, ids binary")


RANGES, RANGE_BYTES, _FILES = 4, 64 << 30, 100_000
_HEAD, _END = 4, 1


@dataclass(frozen=True)
class Store:
    """A written store: where it is and its measures."""

    path: str
    n: int
    per_shard: int
    stride: int
    width: int  # bytes of an id


def _ranges(path: str) -> str:
    return f"{path}/manifest"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _told(docs: DataFrame, text_col: str) -> list[Column]:
    """Figures that tell one table of texts from another, whatever its order."""
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return [F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0)).alias("total")]


def write_store(docs: DataFrame, path: str, key: int = 20240601, length: int = LENGTH, per_shard: int = PER_SHARD, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, ranks: str | None = None) -> Store:
    """Write all sequences of ``docs`` to ``path`` in the order of ``key``; what a broken run has finished there is kept.

    Files: ``range=R/part-P-...-cC.txt``, C counting shards within the task; ``manifest/range=R`` (Parquet): shard, file, first_slot,
    n, stride, id_bytes, n_sequences, bytes. Records end with PAD_ID where a partition's ids ran out (their head tells). Null text counts
    as empty, and each document is closed by END_ID; an empty table gives no shard; a null doc_id needs no care, as ids take no part;
    repeated rows are written each; texts of any length are cut across sequences; other columns are ignored. The sequences are written once to
    the store's folder before the permutation, so a recomputed or resumed task sees the same numbers.

    ``parameters`` (Parquet) names key, length, per_shard, ranges, vocabulary and figures of the texts; a call on the same path
    with others raises ValueError. By default a range has at most ``RANGE_BYTES``, and there are ``RANGES`` or more. The sequences are
    dealt to the ranges' folders in one pass, and each range reads its own, so every sequence is read twice whatever the number of
    ranges; what has been read goes, so that beside the store no more than the sequences and one range's shuffle stands on disk.
    """
    if vocab is None or ranks is None:
        vocab, ranks = default_paths()
    spark = docs.sparkSession
    draft, named = f"{path}/sequences", f"{path}/parameters"
    pieces = bpe(vocab, ranks).pieces
    width = np.dtype(_dtype(len(pieces))).itemsize
    stride = _HEAD + width * length + _END
    given = {"key": key, "length": length, "per_shard": per_shard, "ranges": ranges or 0, "vocabulary": f"{len(pieces)}:{zlib.crc32(repr(pieces[:1000]).encode())}"}
    if _exists(spark, f"{named}/_SUCCESS"):
        before = spark.read.parquet(named).first().asDict()
        now = given | docs.agg(*_told(docs, text_col)).first().asDict()
        if differ := sorted(k for k in now if before[k] != now[k]):
            raise ValueError(f"{path} holds a store with other {', '.join(differ)}")
    else:
        seen = Observation()
        sequences(docs.observe(seen, *_told(docs, text_col)), id_col, text_col, length, vocab, ranks).write.mode("overwrite").parquet(draft)
        row = given | seen.get
        spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` {'string' if k == 'vocabulary' else 'long'}" for k in row)).coalesce(1).write.mode("overwrite").parquet(named)
    if _exists(spark, f"{path}/_DONE/_SUCCESS"):
        return Store(path, spark.read.parquet(f"{path}/_DONE").first()["n"], per_shard, stride, width)
    dealt, counted = f"{path}/dealt", f"{path}/counted"
    if not _exists(spark, f"{dealt}/_SUCCESS"):
        _deal(spark, draft, dealt, counted, key, per_shard, ranges, stride)
        _delete(spark, draft)
    n, ranges, each = spark.read.parquet(counted).select("n", "ranges", "each").first()
    shards = -(-n // per_shard)
    for r in range(ranges):
        if not _exists(spark, f"{_ranges(path)}/range={r}/_SUCCESS"):
            lo, hi = r * each, min(shards, (r + 1) * each)
            if lo < hi:
                _write_range(spark.read.schema("slot long, record binary").parquet(f"{dealt}/range={r}"), path, r, lo, hi, n, per_shard, stride)
        _delete(spark, f"{dealt}/range={r}")
    spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/_DONE")
    _delete(spark, draft, dealt)
    return Store(path, n, per_shard, stride, width)


def _delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _deal(spark: SparkSession, draft: str, dealt: str, counted: str, key: int, per_shard: int, ranges: int | None, stride: int) -> None:
    """Number the sequences of the draft, and write each with its slot to its range's folder; a shuffle only where tasks would write too many files."""
    seqs = spark.read.schema("part int, idx long, n_ids int, ids binary").parquet(draft)
    # one number for each input partition
    sizes = sorted((r["part"], r["n"]) for r in seqs.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    first, n = {}, 0
    for part, k in sizes:
        first[part] = n
        n += k
    shards = -(-n // per_shard)
    ranges = min(shards, ranges or max(RANGES, -(-n * stride // RANGE_BYTES)))
    each = -(-shards // ranges) if shards else 1
    spark.createDataFrame([(n, ranges, each)], "n long, ranges long, each long").coalesce(1).write.mode("overwrite").parquet(counted)
    slots = _slots(seqs, first, n, key).withColumn("range", F.floor(F.col("slot") / F.lit(per_shard * each)).cast("int"))
    if ranges * len(sizes) > _FILES:
        slots = slots.repartition("range", F.pmod(F.xxhash64("slot"), F.lit(64)))
    slots.write.mode("overwrite").partitionBy("range").parquet(dealt)


_MANIFEST = "shard long, file string, first_slot long, n long, stride int, n_sequences long, bytes long"


def _slots(seqs: DataFrame, first: dict[int, int], n: int, key: int) -> DataFrame:
    """(slot, record) of every sequence."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([first[p] for p in b.column(0).to_pylist()], np.int64) + b.column(1).to_numpy()
            head = b.column(2).to_numpy().astype("<u4")
            rows = [k.tobytes() + i for k, i in zip(head, b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(feistel(at, n, key)), pa.array(rows, pa.binary())], ["slot", "record"])

    return arrow_pass(seqs, place, "slot long, record binary")


def _write_range(slots: DataFrame, path: str, r: int, lo: int, hi: int, n: int, per_shard: int, stride: int) -> None:
    """Shards lo..hi-1, whose slots ``slots`` holds, dealt by shard, sorted by slot, a file a shard."""
    spark = slots.sparkSession
    parts = max(1, min(hi - lo, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    per_part = -(-(hi - lo) // parts)
    dealt = slots.repartitionById(parts, ((F.col("slot") - lo * per_shard) / F.lit(per_shard * per_part)).cast("int")).sortWithinPartitions("slot")
    folder = f"{path}/range={r}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        dealt.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", per_shard).option("lineSep", "\n").text(folder)
    files = _files(spark, folder).select(F.col("file"), "bytes")
    number = F.regexp_extract("file", r"part-(\d+)-.*-c(\d+)\.txt$", 1).cast("long") * per_part + F.regexp_extract("file", r"part-(\d+)-.*-c(\d+)\.txt$", 2).cast("long") + lo
    rows = files.where("bytes > 0").select(number.alias("shard"), "file", (number * per_shard).alias("first_slot"), (F.col("bytes") / stride).cast("long").alias("n"), F.lit(stride).alias("stride"), F.lit(n).cast("long").alias("n_sequences"), "bytes")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{_ranges(path)}/range={r}")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, content) of a folder; only what is selected is read."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), "path", "content")


def manifest(spark: SparkSession, store: Store) -> DataFrame:
    """(shard, file, first_slot, n, stride, n_sequences, bytes, range) of a store."""
    return spark.read.schema(_MANIFEST + ", range int").parquet(_ranges(store.path)) if store.n else spark.createDataFrame([], _MANIFEST + ", range int")


def read_slots(spark: SparkSession, store: Store, start: int = 0, stop: int | None = None) -> DataFrame:
    """(slot, shard, byte_offset, n_ids, ids) for start <= slot < stop, reading only the files of their shards; ids are those of the record, padding included."""
    stop = store.n if stop is None else min(stop, store.n)
    if start >= stop:
        return spark.createDataFrame([], "slot long, shard long, byte_offset long, n_ids int, ids binary")
    near = manifest(spark, store).where(F.col("shard").between(start // store.per_shard, (stop - 1) // store.per_shard))
    wanted = [f"{store.path}/range={r['range']}/{r['file']}" for r in near.select("range", "file").collect()] if stop - start < store.n else None
    if wanted is not None and len(wanted) <= 1000:
        found = spark.read.format("binaryFile").load(wanted)
    else:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.txt").option("recursiveFileLookup", "true").load(store.path)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    i = F.col("i")
    rows = found.join(near.select("file", "shard", "first_slot", "n"), "file").select("shard", "first_slot", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    head = F.hex(F.expr(f"substring(content, cast(i * {store.stride} + 1 as int), {_HEAD})"))
    head = F.conv(F.concat(*(F.substring(head, 2 * k + 1, 2) for k in reversed(range(_HEAD)))), 16, 10)  # little-endian
    ids = F.expr(f"substring(content, cast(i * {store.stride} + {_HEAD + 1} as int), {store.stride - _HEAD - _END})")
    rows = rows.select((F.col("first_slot") + i).alias("slot"), "shard", (i * store.stride).alias("byte_offset"), head.cast("int").alias("n_ids"), ids.alias("ids"))
    return rows.where((F.col("slot") >= start) & (F.col("slot") < stop))
