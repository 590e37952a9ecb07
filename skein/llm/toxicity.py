"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over an inverted index.

Fitting takes a bounded, documented sample of labelled rows (``max_toxic`` and ``max_clean`` rows, those of
least hash, and of these one row of a family of near copies: five-word shingles alike by 0.8 or more). All words of the examples are indexed; their document
frequencies are counted over the whole corpus. The words of most examples are rows of a small matrix, multiplied with a batch
of texts at a time; the postings of the others are added to that, and all examples whose sum may be among the k largest are compared
in full, in double precision. Neighbours vote with the square of their cosine and their class's sampling weight; votes are
calibrated by isotonic regression on leave-one-out votes of the examples.

Since a text's subject has far more words than its insults, a second vote is taken over the words alone that mark toxic
examples beyond chance (likelihood ratio). The log odds of both votes are weighed by logistic regression and the sum is calibrated
in the same way, so a text without such a word is still judged by all of its words. A text with an example's wording has its label.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, cut, each_group, give_back, shingles

WORD = re.compile(r"[^\W\d_]+")
#: of UTF-8: ASCII that is no letter becomes a space
_PART = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
MAX_TOXIC, MAX_CLEAN, MAX_TERMS = 4096, 12288, 16384
MIN_LLR, MIN_LIFT, NEIGHBOURS = 24.0, 4.0, 15
#: words kept as rows of a matrix (at most DENSE * (MAX_TOXIC + MAX_CLEAN) floats); texts multiplied with it at a time
DENSE, BATCH = 640, 256
#: what single precision may err by; postings up to which they are gathered by number
_ROUND, _SHORT = 1e-5, 256
#: words to a shingle, and the similarity from which labelled texts are one family
WORDS, ALIKE = 5, 0.8


def log_likelihood_ratio(a: float, b: float, na: float, nb: float) -> float:
    out, n, k = 0.0, na + nb, a + b
    for x, m in ((a, na), (b, nb)):
        for seen, want in ((x, k * m / n), (m - x, (n - k) * m / n)):
            if seen:
                out += seen * math.log(seen / want)
    return 2 * out


def isotonic(raw: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(knots, levels): means of raw values and of labels in the pools of a monotone fit; equal raw values are in one pool, whatever their order."""
    values, at = np.unique(np.round(raw, 10), return_inverse=True)
    pools: list[list[float]] = []  # sum of raw, sum of labels, weight
    for x, y, w in zip(values.tolist(), np.bincount(at, labels * weight).tolist(), np.bincount(at, weight).tolist(), strict=True):
        pools.append([x * w, y, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def log_odds(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


@dataclass
class Index:
    terms: dict[str, int]
    idf: np.ndarray
    prior: float
    doc_ids: list = field(default_factory=list)
    toxic: np.ndarray = field(default_factory=lambda: np.empty(0))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    rare: float = 0.0
    tf: np.ndarray | None = None
    edge: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    packed: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    term: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    full: np.ndarray = field(default_factory=lambda: np.empty(0))
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    column: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    head: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))
    query: np.ndarray = field(default_factory=lambda: np.empty(0))
    marks: Index | None = None  # the same examples by the words that mark toxic ones
    marking: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # of each term, its number there or -1
    mixed: tuple[float, float] = (1.0, 1.0)
    both: tuple[np.ndarray, np.ndarray] | None = None

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights; words in no example add to the length (as words of one document) only."""
        return self.of_bag(*bag(text, self.terms))

    def of_bag(self, t: np.ndarray, tf: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
        return self.unit(t, tf, other * self.rare * self.rare)

    def unit(self, t: np.ndarray, tf: np.ndarray, more: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The vector of terms, in their order, of length 1 together with the square ``more``."""
        w = (1 + np.log(tf)) * self.idf[t]
        return t, w / math.sqrt(float(w @ w) + more) if len(w) else w

    def __getstate__(self) -> dict:
        """Counts, packed, in place of postings and weights, which the receiver makes again: every executor keeps a copy on disk."""
        made = ("edge", "packed", "start", "term", "full", "column", "head", "query")
        state = {k: v for k, v in self.__dict__.items() if k not in made}
        state["terms"] = zlib.compress("\n".join(sorted(self.terms, key=self.terms.__getitem__)).encode(), 1)
        size = np.diff(self.start).astype("<i4")
        if self.tf is None:
            return state | {"full": self.full, "packed": (size, self.term)}
        return state | {"tf": None, "packed": tuple(zlib.compress(x.tobytes(), 1) for x in (size, np.diff(self.term, prepend=np.int32(0)).astype("<i4"), self.tf.astype("<i4")))}

    def __setstate__(self, state: dict) -> None:
        packed, full = state.pop("packed"), state.pop("full", None)
        self.__dict__.update(state)
        words = zlib.decompress(state["terms"]).decode()
        self.terms = {x: i for i, x in enumerate(words.split("\n"))} if words else {}
        if full is not None:
            self.file(packed[1], full, np.concatenate(([0], np.cumsum(packed[0], dtype=np.int64))))
            return
        size, step, tf = (np.frombuffer(zlib.decompress(x), "<i4") for x in packed)
        self.count(np.cumsum(step, dtype=np.int32), tf, np.concatenate(([0], np.cumsum(size, dtype=np.int64))))

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        term = np.concatenate([t for t, _ in vectors]).astype(np.int32) if vectors else np.empty(0, np.int32)
        self.file(term, np.concatenate([w for _, w in vectors]) if vectors else np.empty(0), np.concatenate(([0], np.cumsum([len(t) for t, _ in vectors], dtype=np.int64))))

    def count(self, term: np.ndarray, tf: np.ndarray, start: np.ndarray) -> None:
        """Examples by their counts; weights are made one example at a time, so no second copy of them stands."""
        full = np.empty(len(term))
        for i, j in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            full[i:j] = self.unit(term[i:j], tf[i:j].astype(np.float64))[1]
        self.file(term, full, start)
        self.tf = tf

    def file(self, term: np.ndarray, full: np.ndarray, start: np.ndarray) -> None:
        """Files the weights of all examples, one behind the other, under their terms."""
        self.term, self.full, self.start, self.tf = term, full, start, None
        n = len(start) - 1
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(start))
        size = np.bincount(self.term, minlength=len(self.terms))
        # the words of most examples, as rows of a matrix
        dense = np.sort(np.argsort(-size, kind="stable")[:DENSE])
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[dense] = np.arange(len(dense))
        at = self.column[self.term]
        self.query = np.zeros(len(self.terms))  # scratch: one text's weights
        self.head = np.zeros((len(dense), n), np.float32)
        self.head[at[at >= 0], owner[at >= 0]] = self.full[at >= 0]
        # postings of the others
        few = np.flatnonzero(at < 0).astype(np.int32)
        del at
        few = few[np.argsort(self.term[few], kind="stable")]
        # example number (high) and weight (low) of each posting
        self.packed = owner[few].astype(np.int64)
        self.packed <<= 32
        self.packed |= self.full[few].astype(np.float32).view(np.uint32)
        size[dense] = 0
        self.edge = np.concatenate(([0], np.cumsum(size)))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k examples of largest positive cosine, nearest first, ties to the smaller example number.

        ``skip``: an example for each vector that it must not find (its own).
        """
        out = []
        for at in range(0, len(vectors), BATCH):
            some = vectors[at : at + BATCH]
            q = np.zeros((len(some), len(self.head)), np.float32)
            for i, (t, w) in enumerate(some):
                c = self.column[t]
                q[i, c[c >= 0]] = w[c >= 0]
            begun = q @ self.head
            out += [self._nearest(t, w, begun[i], k, skip[at + i] if skip else -1) for i, (t, w) in enumerate(some)]
        return out

    def _nearest(self, t: np.ndarray, w: np.ndarray, acc: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.start) - 1
        if not len(t) or not n:
            return np.empty(0, np.int64), np.empty(0)
        if 0 <= skip < n:
            acc[skip] = -2.0
        lo, size = self.edge[t], self.edge[t + 1] - self.edge[t]
        now = np.flatnonzero(size)
        if len(now):
            # short postings are gathered by number, long ones copied
            now = now[np.argsort(size[now] > _SHORT, kind="stable")]
            m, a = size[now], lo[now]
            short = int((m <= _SHORT).sum())
            at = np.arange(m[:short].sum()) + np.repeat(a[:short] - np.cumsum(m[:short]) + m[:short], m[:short])
            got = np.concatenate([self.packed[at], *(self.packed[i:j] for i, j in zip(a[short:].tolist(), (a + m)[short:].tolist(), strict=True))])
            acc = acc + np.bincount(got >> 32, got.view(np.float32)[::2] * np.repeat(w[now].astype(np.float32), m), n)
        least = np.partition(acc, n - k)[n - k] - _ROUND if n > k else 0.0
        ids = np.flatnonzero((acc >= least) & (acc > 0))
        ids = ids[ids != skip]
        # in full and in double precision, over the words that the text has too
        a, e = self.start[ids], self.start[ids + 1]
        edge = np.concatenate(([0], np.cumsum(e - a)))
        if not edge[-1]:
            return np.empty(0, np.int64), np.empty(0)
        self.query[t] = w
        q = self.query[np.concatenate([self.term[i:j] for i, j in zip(a.tolist(), e.tolist(), strict=True)])]
        self.query[t] = 0
        at = np.flatnonzero(q)
        of = np.searchsorted(edge, at, "right") - 1
        sims = np.bincount(of, q[at] * self.full[at + (a - edge[:-1])[of]], len(ids))
        ids, sims = ids[sims > 0], sims[sims > 0]
        order = np.lexsort((ids, -np.round(sims, 12)))[:k]
        return ids[order], sims[order]

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        w = sims * sims * self.weight[ids]
        # one vote of the prior keeps far and few neighbours from deciding
        base = 0.05 * float(self.weight[ids].max()) if len(ids) else 1.0
        return float((w @ self.toxic[ids] + base * self.prior) / (w.sum() + base))

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
        """Leave-one-out levels of the examples."""
        near = self.nearest(vectors, k, list(range(len(vectors))))
        if near:
            self.knots, self.levels = isotonic(np.array([self.vote(*x) for x in near]), self.toxic, self.weight)
        return np.array([self.level(*x) for x in near])

    def level(self, ids: np.ndarray, sims: np.ndarray) -> float:
        raw = self.vote(ids, sims)
        if len(ids):
            return float(np.interp(raw, self.knots, self.levels))
        # without evidence the level is that of the examples up to the prior, not between them and the next
        return float(self.levels[max(0, np.searchsorted(self.knots, raw, "right") - 1)])

    def join(self, own: np.ndarray, marks: np.ndarray) -> None:
        """Weighs the log odds of the examples' leave-one-out levels by logistic regression and calibrates the sum."""
        x = np.column_stack((log_odds(own), log_odds(marks), np.ones(len(own))))
        c = np.array([0.5, 0.5, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            pull = x.T @ (self.weight * (self.toxic - p)) - c
            c = c + np.linalg.solve((x * (self.weight * p * (1 - p))[:, None]).T @ x + np.eye(3), pull)
        self.mixed = (max(0.0, float(c[0])), max(0.0, float(c[1])))
        self.both = isotonic(self.mixed[0] * x[:, 0] + self.mixed[1] * x[:, 1], self.toxic, self.weight)

    def score(self, bags: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text's bag: score, nearest examples, their cosines."""
        near = self.nearest([self.of_bag(*x) for x in bags], k)
        out = [self.level(*x) for x in near]
        if self.marks is not None and self.both is not None:
            few = []
            for t, tf, _ in bags:
                m = self.marking[t]
                few.append(self.marks.unit(m[m >= 0], tf[m >= 0]))
            some = [i for i, (t, _) in enumerate(few) if len(t)]
            marked = dict(zip(some, self.marks.nearest([few[i] for i in some], k), strict=True))
            none = (np.empty(0, np.int64), np.empty(0))
            q = np.array([self.marks.level(*marked.get(i, none)) for i in range(len(few))])
            out = np.interp(self.mixed[0] * log_odds(np.array(out)) + self.mixed[1] * log_odds(q), *self.both).tolist() if out else out
        for i, (ids, sims) in enumerate(near):
            same = ids[sims > 1 - 1e-9]
            if len(same):  # the wording of labelled examples
                out[i] = float(self.toxic[same].mean())
        return [(min(1.0, max(0.0, p)), *x) for p, x in zip(out, near, strict=True)]


def words_of(text: str | None) -> Counter:
    """The counts of a text's words: parted at ASCII that is no letter, and by ``WORD`` where a part has other marks."""
    parts = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PART)
    n = Counter(parts.decode("utf-8", "surrogatepass").split())
    for odd in [x for x in n if not x.isalpha()]:
        k = n.pop(odd)
        for w in WORD.findall(odd):
            n[w] += k
    return n


def bag(text: str | None, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Term numbers and counts of a text's words, in order of term, and the sum of (1 + log count) squared of the words that no example has."""
    n = words_of(text)
    t = np.fromiter(map(terms.get, n, repeat(-1)), np.int64, len(n))
    tf = np.fromiter(n.values(), np.float64, len(n))
    known = t >= 0
    other = float(((1 + np.log(tf[~known])) ** 2).sum())
    t, tf = t[known], tf[known]
    order = np.argsort(t)
    return t[order], tf[order], other


def pack(t: np.ndarray, tf: np.ndarray) -> tuple[bytes, bytes]:
    """Steps between term numbers, and counts in 16 bits, or 32 where one needs them."""
    return np.diff(t, prepend=0).astype("<i4").tobytes(), tf.astype("<u2" if not len(tf) or tf.max() < 1 << 16 else "<u4").tobytes()


def unpack(t: bytes, tf: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(t, "<i4")), np.frombuffer(tf, "<u2" if 2 * len(tf) == len(t) else "<u4").astype(np.float64)


def bags(docs: DataFrame, terms) -> DataFrame:
    """(doc_id, t, tf, other) of every text; ``terms`` is a broadcast of term numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.value
        for b in batches:
            ts, tfs, others = [], [], []
            for text in b.column(1).to_pylist():
                t, tf, other = bag(text, number)
                t, tf = pack(t, tf)
                ts.append(t)
                tfs.append(tf)
                others.append(other)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ts, pa.binary()), pa.array(tfs, pa.binary()), pa.array(others, pa.float64())], ["doc_id", "t", "tf", "other"])

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, t binary, tf binary, other double")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text, and the least of them; both null for a text without words."""
    for b in batches:
        found = [shingles((text or "").lower().encode(), WORDS) for text in b.column(2).to_pylist()]
        family = pa.array([int(s[0].astype(np.int64)) if len(s) else None for s in found], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), family, pa.array([s.tobytes() if len(s) else None for s in found], pa.binary())], ["doc_id", "toxic", "family", "s"])


def _unlike(group: pa.Table) -> tuple[np.ndarray]:
    """Of texts of one least shingle those that are not alike to one kept before them, by id."""
    kept: list[np.ndarray] = []
    ids = []
    group = group.sort_by("doc_id")
    for doc_id, raw in zip(group.column("doc_id").to_pylist(), group.column("s").to_pylist(), strict=True):
        s = np.frombuffer(raw or b"", "<u8")
        for x in kept:
            if min(len(x), len(s)) < ALIKE * max(len(x), len(s)):
                continue
            both = len(np.intersect1d(x, s, assume_unique=True))
            if both >= ALIKE * (len(x) + len(s) - both):
                break
        else:
            kept.append(s)
            ids.append(doc_id)
    return (np.array(ids, np.int64),)


def one_of_each_family(rows: DataFrame) -> DataFrame:
    """(doc_id) of a bounded sample (doc_id, toxic, text; an id once): texts of a label with the same least shingle are compared.

    The smallest id of texts alike stays; texts without words are kept. Two that are alike but differ in their least shingle both stay.
    """
    sets = arrow_pass(rows.select("doc_id", "toxic", "text"), _sets, "doc_id long, toxic int, family long, s binary")
    # equal sets are one row of their group
    once = sets.groupBy("toxic", F.coalesce("family", F.xxhash64("doc_id")).alias("family"), "s").agg(F.min("doc_id").alias("doc_id"), F.collect_list(F.when(F.col("s").isNull(), F.col("doc_id"))).alias("bare"))
    wordless = once.where("s is null").select(F.explode("bare").alias("doc_id"))
    return each_group(once.where("s is not null").select(F.col("toxic").cast("long").alias("toxic"), "family", "doc_id", "s"), ["toxic", "family"], _unlike, "doc_id long").unionByName(wordless)


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_terms: int = MAX_TERMS, k: int = NEIGHBOURS) -> tuple[Index, DataFrame]:
    """(index, bags of ``corpus``): learn from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text); term statistics come from all of ``corpus``.

    The driver gets at most ``max_toxic`` + ``max_clean`` sparse vectors and their words; at most
    ``max_terms`` words take part in the second vote, all in the first. A doc_id with
    labels that disagree counts as toxic; the places of near copies are not filled again; null labels are ignored. Without labels of both kinds every score
    is the share of toxic labels (0 if there are none).
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).limit(16).collect()}
    prior = total.get(1, 0) / max(1, sum(total.values()))
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, max_toxic).unionByName(pick(0, max_clean))
    # the sample's size is bounded by parameters
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    # of rows that repeat a doc_id the first text is the example
    rows = cut(rows.groupBy("doc_id").agg(F.min(F.struct("toxic", "text")).alias("d")).select("doc_id", "d.*"), "sample")
    rows = rows.join(F.broadcast(cut(one_of_each_family(rows), "examples")), "doc_id")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Index({}, np.empty(0), float(prior), knots=np.array([0.0, 1.0]), levels=np.array([prior, prior])), bags(corpus, spark.sparkContext.broadcast({}))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y].update(set(WORD.findall((text or "").lower())))
        both = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([n[1][t] for t in both], pa.int64()), pa.array([n[0][t] for t in both], pa.int64())], ["term", "a", "b"])

    found = arrow_pass(rows.select("toxic", "text"), words, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    words_, a, b = found.column("term").to_pylist(), found.column("a").to_numpy(), found.column("b").to_numpy()
    if not words_:
        return Index({}, np.empty(0), float(prior), levels=np.array([prior, prior])), bags(corpus, spark.sparkContext.broadcast({}))
    terms = {t: i for i, t in enumerate(sorted(words_))}
    need = MIN_LLR / (2 * math.log((n1 + n0) / n1))  # a term seen in toxic examples only needs so many
    often = np.flatnonzero((a / n1 > MIN_LIFT * (b / n0)) & (a >= math.ceil(need)))
    ranked = sorted((-log_likelihood_ratio(int(a[i]), int(b[i]), n1, n0), words_[i]) for i in often)
    marking = {t: i for i, t in enumerate(sorted(t for x, t in ranked[:max_terms] if -x > MIN_LLR))}
    del found, words_, a, b, often, ranked
    give_back()
    shared = spark.sparkContext.broadcast(terms)

    # every text's words are read once, for the frequencies and for its score
    read = cut(bags(corpus, shared), "bags")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs_seen = np.zeros(len(shared.value), np.int64), 0
        for b in batches:
            docs_seen += len(b)
            t = [np.cumsum(np.frombuffer(x, "<i4")) for x in b.column(0).to_pylist()]
            if t:
                n += np.bincount(np.concatenate(t), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], at)), pa.int32()), pa.array(np.concatenate(([docs_seen], n[at])))], ["t", "n"])

    counts = arrow_pass(read.select("t"), frequency, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(terms) + 1, np.int64)
    seen[counts.column("t").to_numpy()] = counts.column("n").to_numpy()
    n_docs = int(seen[-1])
    idf = np.log((1 + n_docs) / (1 + seen[:-1])) + 1
    index = Index(terms, idf, float(prior), rare=math.log((1 + n_docs) / 2) + 1)

    got = bags(rows, shared).join(rows.select("doc_id", "toxic"), "doc_id").toArrow().sort_by("doc_id")
    index.doc_ids = got.column("doc_id").to_pylist()
    index.toxic = got.column("toxic").to_numpy().astype(float)
    share = np.array([total.get(0, 0) / n0, total.get(1, 0) / n1])
    index.weight = share[index.toxic.astype(int)]
    size = pc.binary_length(got.column("t")).to_numpy() // 4
    edge = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    t, tf = np.empty(edge[-1], np.int32), np.empty(edge[-1], "<i4")
    for i, (x, y) in enumerate(zip(got.column("t"), got.column("tf"), strict=True)):
        t[edge[i] : edge[i + 1]], tf[edge[i] : edge[i + 1]] = unpack(x.as_py(), y.as_py())
    del got
    give_back()
    index.count(t, tf, edge)
    known_vectors = [(index.term[i:j], index.full[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
    own = index.calibrate(known_vectors, k)
    if marking:
        at = np.array([terms[t] for t in sorted(marking)])
        number = np.full(len(terms), -1, np.int64)
        number[at] = np.arange(len(at))
        marks = Index(marking, idf[at], float(prior), index.doc_ids, index.toxic, index.weight)
        few = []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            m = number[t[i:j]]  # in order, as both number the words by name
            few.append(marks.unit(m[m >= 0], tf[i:j][m >= 0].astype(np.float64)))
        marks.build(few)
        index.join(own, marks.calibrate(few, k))
        index.marks, index.marking = marks, number
    give_back()
    return index, read


def score(docs: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score, evidence) of any texts (doc_id, text); those of the corpus that was learned from have their bags already."""
    return score_bags(bags(docs, docs.sparkSession.sparkContext.broadcast(index.terms)), index, k)


def score_bags(read: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score, evidence): ``evidence`` lists up to five nearest examples with cosine and label.

    Null and empty texts, and texts without a word of any example, have no neighbour and get the calibrated prior.
    Repeated rows are scored each; other columns are ignored; an empty table gives an empty one.
    """
    broad = read.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = broad.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for b in batches:
            got = []
            for at in range(0, len(b), 512):
                some = b.slice(at, 512)
                got += ix.score([(*unpack(t, tf), other) for t, tf, other in zip(*(some.column(i).to_pylist() for i in (1, 2, 3)), strict=True)], k)
            proof = [[{"doc_id": ix.doc_ids[i], "cosine": float(s), "toxic": int(ix.toxic[i])} for i, s in zip(ids[:5].tolist(), sims[:5], strict=True)] for _, ids, sims in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.float64()), pa.array(proof, kind)], ["doc_id", "score", "evidence"])

    return arrow_pass(read, run, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")
