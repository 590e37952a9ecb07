"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased; every run of non-letters counts as one blank. Its n-grams (n = 1..3, blanks only at the
ends, so words are padded) are ranked by frequency; the first ``top`` ranks are compared to each
language's profile: the sum over the text's n-grams of how far each is out of place, an n-gram that the
profile lacks counting as ``top`` places. The nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass

TOP = 400
MAX_LANGS = 1000
UND = "und"
_BLOCK = 1 << 18
_SHARP = 24.0


@lru_cache(1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
    return table


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as integers (21 bits a character) and their counts, over the whole text in blocks."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, np.uint32(32))
    keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(c), _BLOCK):
        got = _block(c[at : at + _BLOCK + 2].astype(np.int64), _BLOCK)
        if at:
            keys, back = np.unique(np.concatenate((keys, got[0])), return_inverse=True)
            n = np.bincount(back, np.concatenate((n, got[1])), len(keys)).astype(np.int64)
        else:
            keys, n = got
    return keys, n


def _block(c: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that begin at one of the first ``starts`` characters."""
    word = c != 32
    one = c[:starts][word[:starts]]
    two = (c[:-1] << 21 | c[1:])[:starts][(word[:-1] | word[1:])[:starts]]
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[:starts][word[1:-1][:starts]]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                got = _grams(text)
                held.setdefault(lang, []).append(got)
                size += len(got[0])
        if size > 2_000_000:
            yield from out()
            size = 0
    yield from out()


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> pd.DataFrame:
    """(lang, gram, rank): each language's ``top`` n-grams, counted over all rows with text and language.

    Ties in count go to the smaller n-gram. The result has at most ``top`` rows a language and at most
    ``MAX_LANGS`` languages (more is an error), so it can be sent to every task.
    """
    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    n = arrow_pass(src, _counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # rank within hash slices first: no language's whole table of n-grams meets in one task
    part = n.withColumn("slice", F.pmod(F.xxhash64("gram"), F.lit(64)))
    order = (F.desc("n"), F.asc("gram"))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("r") <= top)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1).where(F.col("rank") < top)
    rows = best.select("lang", "gram", "rank").limit(top * MAX_LANGS + 1).toPandas()
    if len(rows) > top * MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return rows


class Ranker:
    def __init__(self, profiles: pd.DataFrame, top: int = TOP):
        self.top = top
        self.langs = sorted(profiles["lang"].unique()) if len(profiles) else []
        self.grams = np.unique(profiles["gram"].to_numpy(np.int64)) if len(profiles) else np.empty(0, np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        if len(profiles):
            at = {x: i for i, x in enumerate(self.langs)}
            self.ranks[np.searchsorted(self.grams, profiles["gram"].to_numpy(np.int64)), [at[x] for x in profiles["lang"]]] = profiles["rank"].to_numpy()

    def __call__(self, text: str | None) -> tuple[str, float]:
        keys, n = _grams(text) if text else (np.empty(0, np.int64),) * 2
        if not len(keys) or not self.langs:
            return UND, 0.0
        if len(keys) > self.top:
            # the top-th count is found by selection; only its ties are put in order
            keep = n >= -np.partition(-n, self.top - 1)[self.top - 1]
            keys, n = keys[keep], n[keep]
        keys = keys[np.lexsort((keys, -n))][: self.top]
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        at = np.where(self.grams[at] == keys, at, len(self.grams))
        ranks = self.ranks[at]
        far = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(keys))[:, None])).sum(0) / (self.top * len(keys))
        best = int(np.argmin(far))
        w = np.exp(-_SHARP * (far - far[best]))
        return self.langs[best], float(w[best] / w.sum() * min(1.0, 2 * (1 - far[best])))


def identify(docs: DataFrame, profiles: pd.DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, *keep, lang_pred, score) of every row, from its text alone.

    Null text and text without a letter give ``und`` with score 0; so does every text where no profile was
    learned. Equal distances go to the first language by name. Repeated rows are predicted each; columns
    other than those to ``keep`` are ignored.
    """
    ranker = Ranker(profiles, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [ranker(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
    return arrow_pass(src, run, f"{fields}, lang_pred string, score double")
