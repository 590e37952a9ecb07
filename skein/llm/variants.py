"""Spelling variant grouping by Aho-Corasick halves.

One edit leaves one half of a word whole: its first half at the beginning of the other word, or its second half at the
end. Automata hold both halves of every word; all words are scanned, a find counts if the segment lies at its
offset and the lengths are at most one apart, and the rest is then verified. Automata are sharded by segment kind, word
length and the segment's outer two letters, which a scanned word must share, so a word visits six shards whatever
the vocabulary; a shard of more than ``SHARD`` words is split by its segments, and each part is scanned by the shard's words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, cut, drop

RUN = re.compile("[A-Za-zÀ-ÿ]+")
NOISE = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
SHARD = 20_000
_HELD = 300_000
_FEW = 12


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, some with one code point deleted by a hash of document and run, counted.

    A run of which crc32 of ``<id>:<run>`` is divisible by 97 loses the code point at that hash modulo its length. A null id
    counts as an empty one; a null text has no words; repeated rows count each. What is left empty is no word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                seed = zlib.crc32(b"%s:" % (key or "").encode())
                # bytes.lower knows A-Z only
                for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if not h % NOISE:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    held[word] += n
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    return arrow_pass(src, count, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def shortened(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def apart_by_one(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Rests:
    """What the words of one segment have besides it; many are looked up by what is left when one letter goes."""

    def __init__(self) -> None:
        self.words: list[tuple[str, str, int]] = []
        self.by: dict[str, list[int]] | None = None

    def near(self, rest: str) -> Iterator[tuple[str, int]]:
        words = self.words
        if len(words) <= _FEW:
            at = range(len(words))
        else:
            if self.by is None:
                self.by = {}
                for i, (r, _, _) in enumerate(words):
                    for s in {r, *shortened(r)}:
                        self.by.setdefault(s, []).append(i)
            at = {i for s in {rest, *shortened(rest)} for i in self.by.get(s, ())}
        return ((words[i][1], words[i][2]) for i in at if apart_by_one(words[i][0], rest))


def _half(word: str) -> int:
    return len(word) // 2


class Shard:
    """An automaton over the halves of one kind, all of words of one length."""

    def __init__(self, head: bool, words: list[tuple[str, int]]):
        self.head, self.length, self.trie = head, len(words[0][0]), ahocorasick.Automaton()
        for w, n in words:
            k = _half(w)
            seg, rest = (w[:k], w[k:]) if head else (w[k:], w[:k])
            at = self.trie.get(seg, None)
            if at is None:
                at = (seg, Rests())
                self.trie.add_word(seg, at)
            at[1].words.append((rest, w, n))
        self.trie.make_automaton()

    def scan(self, word: str) -> Iterator[tuple[str, int]]:
        if abs(len(word) - self.length) > 1:
            return
        for end, (seg, rests) in self.trie.iter(word):
            if self.head:
                if end + 1 == len(seg):
                    yield from rests.near(word[end + 1 :])
            elif end + 1 == len(word):
                k = len(word) - len(seg)
                # a word whose first half is whole too was met by that half
                yield from ((w, n) for w, n in rests.near(word[:k]) if not word.startswith(w[: _half(w)]))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words that one edit parts; ``words`` has distinct words of 4 letters or more with their n."""
    length = F.length("word")
    head, tail = F.struct(F.lit(True).alias("head"), F.left("word", F.lit(2)).alias("letters")), F.struct(F.lit(False).alias("head"), F.right("word", F.lit(2)).alias("letters"))
    each = words.select("word", "n", F.inline(F.array(head, tail)))
    own = each.withColumn("length", length)
    size = own.groupBy("head", "length", "letters").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts"))
    size = cut(size, "shards")
    shard = ["head", "length", "letters"]
    segment = F.when(F.col("head"), F.left("word", F.floor(length / 2).cast("int"))).otherwise(F.substring("word", F.floor(length / 2).cast("int") + 1, length))
    part = F.pmod(F.xxhash64(segment), F.col("parts")).cast("int")
    # fewer shards than pairs of letters, lengths and kinds, so the table of their sizes is looked up by shuffle only where it is large
    hold = own.join(size, shard).select(*shard, part.alias("part"), F.lit(False).alias("scan"), "word", "n")
    ask = each.withColumn("length", F.explode(F.array(length - 1, length, length + 1))).join(size, shard)
    ask = ask.select(*shard, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("scan"), "word", F.lit(None).cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, now = None, [], None
        for b in batches:
            got: tuple[list, list, list] = ([], [], [])
            for head_, length_, letters, part_, scan, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = (head_, length_, letters, part_)
                if key != last:
                    last, held, now = key, [], None
                if not scan:
                    held.append((word, n))
                    continue
                if now is None:
                    if not held:
                        continue
                    now, held = Shard(head_, held), []
                    last = key
                for near, near_n in now.scan(word):
                    for to, x in zip(got, (word, near, near_n), strict=True):
                        to.append(x)
            if got[0]:
                yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.string()), pa.array(got[1], pa.string()), pa.array(got[2], pa.int64())], ["word", "near", "near_n"])

    keys = [*shard, "part"]
    both = hold.unionByName(ask).repartition(*keys).sortWithinPartitions(*keys, "scan")
    return arrow_pass(both, run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, by doubling the steps; n at least doubles from word to form, so there is no ring and a chain is short."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = cut(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(now)
        now = then
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def group(counts: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``counts`` (word, n) that is long and frequent enough.

    Two words are near if one code point inserted, deleted or replaced parts them. A word's form is its near word of
    largest n, ties to the smallest in code-point order, if that n is at least twice the word's; else null. Its root is where forms
    lead, the word itself without a form. ``least_length`` is at least 4, so that a half has two letters. Null words go; an
    empty table gives an empty one. Other columns are ignored.
    """
    if least_length < 4:
        raise ValueError("halves of two letters need words of four")
    words = cut(counts.select("word", F.col("n").cast("long").alias("n")).where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    takes = F.col("best.near_n") >= 2 * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, F.col("best.near_n")).alias("form_n"))
    out = cut(out, "forms")
    return out.join(roots(out.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
