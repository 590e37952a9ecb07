"""Shared plumbing: lineage cuts, Arrow passes, byte-level hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WS = b" \t\n\x0b\x0c\r"
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A temporary one is made only where none is configured and all run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="skein-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors.

    The job's shuffle files go as soon as the table stands; the table goes when the driver ends, or by ``drop``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no plan reads any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._skein_path)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """Left join to ``right`` (one row a key), where a key may hold a large part of ``left`` (a table that is cheap to read again).

    The keys that hold more than 1 / ``share`` of the rows are fewer than ``share``, so their rows of ``right`` are
    broadcast; the others are joined by shuffle.
    """
    least = left.count() // share
    hot = left.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).select(*keys)
    hot = cut(hot.join(right, keys, "left"), "hot-keys")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right, keys, "left")
    return rest.unionByName(left.join(F.broadcast(hot), keys))


def arrow_pass(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches bounded by bytes, since one text may be very long.

    Workers are used again by the next stage, so a pass gives back at its end the memory that its allocators hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != str(8 << 20):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df.mapInArrow(run, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def each_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], schema: str) -> DataFrame:
    """``fn`` over the rows of each value of ``keys`` (longs), one group in memory at a time; it gives two columns of longs.

    As ``applyInPandas``, but without its cost a group, for many small groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for group in _groups(batches, keys):
            got = fn(group)
            if len(got[0]):
                made.append(got)
                size += len(got[0])
            if size > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names)
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names)

    names = [x.split()[0] for x in schema.split(",")]
    return arrow_pass(df.repartition(*keys).sortWithinPartitions(*keys), run, schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    last: list[int] | None = None
    for b in batches:
        if not len(b):
            continue
        key = np.stack([b.column(b.schema.get_field_index(k)).to_numpy() for k in keys])
        edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(b)]
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            now = key[:, i].tolist()
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    target = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(target).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(0x5EED)
    byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    fold = np.arange(256)
    fold[65:91] += 32
    byte = byte[fold]
    space = np.zeros(256, bool)
    space[list(WS)] = True
    return byte, space, fold


_BYTE, _SPACE, _FOLD = _tables()
_CHUNK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers 0..n of an odd base and of its inverse, modulo 2 ** 64; up to a million are kept."""

    def __init__(self, base: int):
        self.base, self.kept = base, (np.empty(0, np.uint64),) * 2

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.kept[0]) > n:
            return self.kept
        size = max(n + 1, 1 << 14)
        got = _powers(self.base, size), _powers(pow(self.base, -1, 1 << 64), size)
        if size <= 1 << 20:
            self.kept = got
        return got


_of_bytes = Powers(0x9E3779B97F4A7C15)


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    power, back = _of_bytes(n)
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[:n], dtype=np.uint64)))
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)), start, end


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (a run without ASCII white space; A-Z count as a-z), in text order, with its first and last byte + 1.

    Works in blocks cut at white space, so a very long text needs bounded memory besides its hashes;
    a single word longer than a block is kept whole.
    """
    if len(text) <= _CHUNK:
        return _word_hashes(np.frombuffer(text, np.uint8))
    parts, at, raw = [], 0, np.frombuffer(text, np.uint8)
    while at < len(raw):
        end = min(len(raw), at + _CHUNK)
        while end < len(raw):
            gaps = np.flatnonzero(_SPACE[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(raw), end + _CHUNK)
        h, i, j = _word_hashes(raw[at:end])
        parts.append((h, i + at, j + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def word_hashes(text: bytes) -> np.ndarray:
    return words_of(text)[0]


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; a shorter text counts whole as one, no words as none."""
    w = word_hashes(text)
    if not len(w):
        return w
    m = max(1, len(w) - k + 1)
    out = np.zeros(m, np.uint64)
    for i in range(min(k, len(w))):
        out = out * np.uint64(0xD6E8FEB86659FD93) + w[i : i + m]
    return np.unique(mix(out + np.uint64(min(k, len(w)))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
