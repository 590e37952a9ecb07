"""Substring dedup by sliding spans of sentences.

A text falls into sentences: one ends behind a word whose end is a mark (``.``, ``!``, ``?``, closing quotes or brackets after it),
and at a line's end. Every run of ``run`` consecutive sentences is a span. A passage may also begin and end inside
sentences, so a sentence falls apart behind the word of least hash of every ``LONG`` words in a row (alike wherever the words
stand, into parts of at most ``LONG`` words), and the shortest run of at least two parts with at least ``min_words`` words
that begins, or ends, at a part is a span too; runs of sentences of that many words are made of these. Spans are hashed
from their words (white space and A-Z/a-z count alike; 96 bits) and joined over the whole corpus: a span's first document keeps
it, every other document loses the sentences and parts it covers, and a document that repeats a span within itself
keeps the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, arrow_pass, as_bytes, cut, drop, mix, words_of

RUN, MIN_WORDS, LONG, PARTS = 3, 16, 11, 2
_CLOSES, _ENDS = (np.isin(np.arange(256), list(x)) for x in (b"\"')]", b".!?"))
_ONE, _TWO = Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95)


def sentence_ends(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each word, whether its sentence ends behind it."""
    at = np.arange(len(raw))
    last = np.maximum.accumulate(np.where(_CLOSES[raw], -1, at))[end - 1]  # the word's last byte that closes nothing
    lines = np.concatenate(([0], np.cumsum(raw == 10)))
    out = (last >= start) & _ENDS[raw[np.maximum(last, 0)]]
    out[:-1] |= lines[start[1:]] > lines[end[:-1]]
    out[-1] = True
    return out


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return x if have == width else pick(x[: len(x) - width + have], x[width - have :])


def part_ends(hashes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Of each word, whether a part of a sentence ends behind it: it has the least hash of ``LONG`` words in a row of one sentence."""
    n = len(hashes)
    out = sentence.copy()
    if n < LONG:
        return out
    number = np.cumsum(sentence) - sentence
    least = np.where(number[: n - LONG + 1] == number[LONG - 1 :], _slide(hashes, LONG, np.minimum), np.uint64(0))
    pad = np.zeros(LONG - 1, np.uint64)
    return out | ((_slide(np.concatenate((pad, least, pad)), LONG, np.maximum) == hashes) & (hashes > 0))


def _runs(words: np.ndarray, size: int, least: int) -> np.ndarray:
    """First and last unit of the shortest runs of ``size`` units and ``least`` words that begin or end at each unit, as rows."""
    n = len(words)
    before = np.concatenate(([0], words[:-1]))
    i = np.arange(n)
    j = np.maximum(np.searchsorted(words, before + least), i + size - 1)  # last unit of the run that begins at i
    left = np.minimum(np.searchsorted(before, words - least, side="right") - 1, i - size + 1)
    ok = left >= 0
    at = np.unique(np.concatenate((i[j < n] * n + j[j < n], left[ok] * n + i[ok])))
    return np.stack((at // n, at % n))


def spans(text: bytes, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the parts (byte offsets), and for each span its hashes (64 and 32 bits), first and last part."""
    hashes, start, end = words_of(text)
    none = np.empty(0, np.int64)
    if not len(hashes):
        return np.array([len(text)] if text else [], np.int64), none.view(np.uint64), none.astype(np.int32), none, none
    raw = np.frombuffer(text, np.uint8)
    sentence = sentence_ends(raw, start, end)
    words = np.flatnonzero(part_ends(hashes, sentence)) + 1  # words up to each part's end
    ends = np.append(start[words[:-1]], len(text))
    before = np.concatenate(([0], words[:-1]))
    a, b = _runs(words, PARTS, min_words)
    whole = np.flatnonzero(sentence[words - 1])  # parts that end a sentence
    if len(whole) >= run:
        first = np.concatenate(([0], whole[:-1] + 1))[: len(whole) - run + 1]
        last = whole[run - 1 :]
        short = words[last] - before[first] < min_words  # longer ones are covered by runs of parts
        a, b = np.concatenate((a, first[short])), np.concatenate((b, last[short]))
    # a span's hash is its words' polynomial, taken from prefix sums and shifted to the span's start
    x, y, n = before[a], words[b], (words[b] - before[a]).astype(np.uint64)
    out = []
    for powers in (_ONE, _TWO):
        power, back = powers(len(hashes))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)], dtype=np.uint64)))
        out.append(mix((total[y] - total[x]) * back[x] + n))
    return ends, out[0], (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32), a, b


def _rows(run: int, min_words: int):
    """A row for each document: parts, whether it repeats a span, its distinct spans."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, again, one, two = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(2)), strict=True):
                ends, h, g, _, _ = spans(text, run, min_words)
                h, at = np.unique(h, return_index=True)
                again.append(len(at) < len(g))
                n.append(len(ends))
                if doc is None:
                    h, at = h[:0], at[:0]
                one.append(h.view(np.int64))
                two.append(g[at])
            edge = pa.array(np.cumsum([0] + [len(x) for x in one]), pa.int32())
            cat = lambda x, kind: pa.ListArray.from_arrays(edge, pa.array(np.concatenate(x) if x else [], kind))
            cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(again, pa.bool_()), cat(one, pa.int64()), cat(two, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "n", "again", "h", "g"])

    return go


def _cut_out(run: int, min_words: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_gone = [], []
            for doc, old, raw, again, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(1)), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if doc is None or not (again or gone.is_valid):
                    out.append(old)
                    n_gone.append(0)
                    continue
                ends, h, _, a, b = spans(raw, run, min_words)
                bad = np.isin(h.view(np.int64), gone.values.to_numpy()) if gone.is_valid else np.zeros(len(h), bool)
                # a repeat within the document goes unless it overlaps its first occurrence
                order = np.lexsort((a, h))
                head = order[np.searchsorted(h[order], h)]
                bad |= a > b[head]
                drop = np.zeros(len(ends) + 1, np.int64)
                np.add.at(drop, a[bad], 1)
                np.add.at(drop, b[bad] + 1, -1)
                lost = np.cumsum(drop[:-1]) > 0
                if lost.any():
                    starts = np.concatenate(([0], ends[:-1]))
                    out.append(b"".join(raw[s:e] for s, e in zip(starts[~lost], ends[~lost], strict=True)).decode())
                else:
                    out.append(old)
                n_gone.append(int(lost.sum()))
            cols = [batch.column(0), pa.array(out, pa.string()), batch.column(2), pa.array(n_gone, pa.int64()), *batch.columns[5:]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_sentences", "n_removed", *batch.schema.names[5:]])

    return go


def dedup_substrings(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, *keep): texts without the sentences that a non-first span covers.

    Counts are of sentences, each part of a divided one counting by itself. A span's first document is the one of smallest
    doc_id. Rows that repeat a doc_id count as one document and keep the same spans. Null texts stay null, empty ones empty;
    a text without words has no span. Rows without a doc_id pass through. Columns other than those to ``keep`` are ignored; an
    empty table gives an empty one.
    """
    doc, text = F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    mark = F.xxhash64("text").alias("mark")  # tells rows that repeat a doc_id apart
    src = docs.select(doc, text).select("doc_id", mark, "text")
    made = cut(arrow_pass(src, _rows(run, min_words), "doc_id long, mark long, n long, again boolean, h array<long>, g array<int>"), "spans")
    pair = F.explode(F.arrays_zip("h", "g")).alias("s")
    rows = made.where("doc_id is not null").select("doc_id", pair).select("doc_id", "s.h", "s.g")
    firsts = rows.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    firsts = cut(firsts.where("first <> last").select("h", "g", "first", "n"), "repeated-spans")
    # spans that hold over 1 / 1000 of all rows are fewer than 1000: broadcast, so no task gets all of a passage's documents
    total = made.agg(F.sum(F.size("h")).alias("n")).first()["n"] or 0
    hot = firsts.where(F.col("n") > total // 1000).drop("n")
    rest = firsts.where(F.col("n") <= total // 1000).drop("n")
    lost = rows.join(F.broadcast(hot), ["h", "g"]).unionByName(rows.join(F.broadcast(hot.select("h", "g")), ["h", "g"], "left_anti").join(rest, ["h", "g"]))
    gone = lost.where("doc_id <> first").groupBy("doc_id").agg(F.collect_list("h").alias("gone"))
    told = cut(made.select("doc_id", "mark", "n", "again").dropDuplicates(["doc_id", "mark"]).join(gone, "doc_id", "left"), "lost-spans")
    drop(made, firsts)
    whole = docs.select(doc, text, *keep).select("*", F.xxhash64("text").alias("_mark"))
    same = whole["doc_id"].eqNullSafe(told["doc_id"]) & (whole["_mark"] == told["mark"])
    fields = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    joined = whole.join(told, same, "left").select(whole["doc_id"], whole["text"], told["n"], told["again"], told["gone"], *(whole[c] for c in keep))
    return arrow_pass(joined, _cut_out(run, min_words), f"doc_id long, text string, n_sentences long, n_removed long{fields}")
