"""Order-preserving packing of token streams into windows.

Documents follow each other in input order within a partition. A dynamic programme over the cut points
(ends of documents and of sentences; inside long sentences also every ``LONG`` ids) minimises padding plus cut
penalties. With best[i] the least cost of cutting the stream at point i, at ids pos[i],

    best[j] = pen[j] + window - pos[j] + min(best[i] + pos[i])  over  pos[j] - window <= pos[i] < pos[j],

so the minimum slides with j and a monotone queue gives each in amortised constant time. A partition is
worked through in blocks; windows near a block's end stay open and join the next block, so memory is
bounded by a block and one document. No shuffle.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass
from .tokens import bpe, default_paths

WINDOW = 2048
END_ID = 1
LONG = 32
WORDS = 300_000  # kept by the coder
PENALTY = {"document": 0, "sentence": 2, "inside": 10}
_BLOCK = 1 << 20


def choose_cuts(pos: list[int], pen: list[int], window: int) -> list[int]:
    """Indices of the chosen cut points, the first and the last among them. Gaps must not exceed ``window``."""
    n = len(pos)
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(pos[0], pos[0], 0)])  # best[i] + pos[i], pos[i], i
    for j in range(1, n):
        p = pos[j]
        while p - queue[0][1] > window:
            queue.popleft()
        least, _, i = queue[0]
        back[j] = i
        v = best[j] = least + window - p + pen[j]
        v += p
        while queue and queue[-1][0] >= v:
            queue.pop()
        queue.append((v, p, j))
    out, j = [n - 1], n - 1
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


def powers(n: int) -> list[int]:
    """Lengths, each a power of two, largest first, that add up to n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    def __init__(self, ends: np.ndarray, window: int, part: int):
        self.ends, self.window = ends, window
        self.held: list[tuple[object, int, int, np.ndarray]] = []  # doc_id, start, ids in the document, ids
        self.size = 0
        self.next = part << 40

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple]:
        self.held.append((doc_id, 0, len(ids), ids))
        self.size += len(ids)
        if self.size >= _BLOCK:
            yield from self.flush(False)

    def _points(self) -> tuple[list[int], list[int]]:
        ids = np.concatenate([x[3] for x in self.held])
        pen = np.full(len(ids) + 1, -1, np.int64)
        pen[np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1] = PENALTY["sentence"]
        at = np.cumsum([len(x[3]) for x in self.held])
        pen[at - 1] = -1  # the point before a document's end mark is of no use
        pen[at] = PENALTY["document"]
        pen[0] = 0
        pos = np.flatnonzero(pen >= 0)
        gap = np.diff(pos)
        step = min(LONG, self.window)
        if (wide := np.flatnonzero(gap > step)).size:
            more = np.concatenate([np.arange(pos[i] + step, pos[i + 1], step) for i in wide])
            pen[more] = PENALTY["inside"]
            pos = np.flatnonzero(pen >= 0)
        return pos.tolist(), pen[pos].tolist()

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        pos, pen = self._points()
        cuts = [pos[i] for i in choose_cuts(pos, pen, self.window)]
        if last:
            tail = cuts.pop() - cuts[-1]
            for n in powers(tail) if tail < self.window else [tail]:
                cuts.append(cuts[-1] + n)
        else:
            while len(cuts) > 2 and pos[-1] - cuts[-1] < 4 * self.window:
                cuts.pop()
        yield from self._emit(cuts)

    def _emit(self, cuts: list[int]) -> Iterator[tuple]:
        at, offset, i = 0, 0, 1
        rest: list[tuple[object, int, int, np.ndarray]] = []
        for doc_id, start, total, ids in self.held:
            while len(ids) and i < len(cuts):
                n = min(len(ids), cuts[i] - at)
                yield doc_id, start, ids[:n], total, self.next, offset
                start, ids, at, offset = start + n, ids[n:], at + n, offset + n
                if at == cuts[i]:
                    i, offset, self.next = i + 1, 0, self.next + 1
            if len(ids):
                rest.append((doc_id, start, total, ids))
        self.held = rest
        self.size = sum(len(x[3]) for x in rest)


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocab: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its text's ids and ``END_ID``; null text counts as empty, so every row gives a piece. Every
    id lies in exactly one piece, pieces keep the input order within a partition, and no sequence mixes
    partitions. What is left at a partition's end is cut into powers of two, which need no padding. Repeated
    rows are packed each; a null doc_id is kept; other columns are ignored; an empty table gives no piece.
    """
    if vocab is None or ranks is None:
        vocab, ranks = default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocab, ranks, WORDS)
        packer = Packer(coder.ends, window, TaskContext.get().partitionId())
        end = np.array([END_ID], "<u4")
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            doc, start, ids, total, seq, offset = zip(*held, strict=True)
            cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def pieces() -> Iterator[tuple]:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield from packer.add(doc_id, np.concatenate((np.frombuffer(coder.encode(text), "<u4"), end)))
            yield from packer.flush(True)

        for x in pieces():
            held.append(x)
            size += len(x[2])
            if size > 1 << 20:
                yield out()
                size = 0
        if held:
            yield out()

    return arrow_pass(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, _SCHEMA)
