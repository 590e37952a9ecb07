import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import toxicity
from skein.llm.queries import op10_toxicity

K = 15


def words(text):
    return Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def unit(weights, more=0.0):
    size = math.sqrt(sum(x * x for x in weights.values()) + more)
    return {t: x / size for t, x in weights.items()} if size else {}


def near(v, examples, skip=None):
    """Nearest examples by plain dot products."""
    found = []
    for i, e in enumerate(examples):
        s = sum(x * e[t] for t, x in v.items() if t in e)
        if i != skip and s > 0:
            found.append((-round(s, 12), i, s))
    return [(i, s) for _, i, s in sorted(found)[:K]]


def monotone(raw, y, w):
    """Neighbouring pools are merged as long as any two do not rise; equal values begin as one."""
    by = {}
    for x, a, b in zip(raw, y, w, strict=True):
        for held, new in zip(by.setdefault(round(x, 10), ([], [], [])), (x, a, b), strict=True):
            held.append(new)
    pools = [by[x] for x in sorted(by)]
    mean = lambda p, c: sum(a * b for a, b in zip(p[c], p[2], strict=True)) / sum(p[2])
    at = 0
    while at + 1 < len(pools):
        if mean(pools[at], 1) >= mean(pools[at + 1], 1):
            pools[at : at + 2] = [tuple(a + b for a, b in zip(*pools[at : at + 2], strict=True))]
            at = max(0, at - 1)
        else:
            at += 1
    return [mean(p, 0) for p in pools], [mean(p, 1) for p in pools]


class Vote:
    def __init__(self, examples, y, w, prior):
        self.examples, self.y, self.w, self.prior = examples, y, w, prior
        found = [near(e, examples, i) for i, e in enumerate(examples)]
        self.knots, self.levels = monotone([self.raw(f) for f in found], y, w)
        self.own = [self.level(f) for f in found]

    def raw(self, found):
        base = 0.05 * max(self.w[i] for i, _ in found) if found else 1.0
        mass = [s * s * self.w[i] for i, s in found]
        return (sum(m * self.y[i] for m, (i, _) in zip(mass, found, strict=True)) + base * self.prior) / (sum(mass) + base)

    def level(self, found):
        if found:
            return float(np.interp(self.raw(found), self.knots, self.levels))
        return self.levels[max(0, sum(x <= self.raw(found) for x in self.knots) - 1)]


def odds(p):
    p = min(max(p, 1e-3), 1 - 1e-3)
    return math.log(p / (1 - p))


def brute(docs, labels, ids):
    """Scores of ``docs`` from the examples ``ids``, with nothing of the library."""
    texts = dict(docs)
    bags = {i: words(t) for i, t in docs}
    n, df = len(docs), Counter(t for i, _ in docs for t in bags[i])
    y = [labels[i] for i in ids]
    total, held = Counter(labels.values()), Counter(y)
    w = [total[x] / held[x] for x in y]
    prior = total[1] / sum(total.values())
    vocab = {t for i in ids for t in bags[i]}
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    rare = math.log((1 + n) / 2) + 1
    weigh = lambda bag, keep: {t: (1 + math.log(c)) * idf[t] for t, c in bag.items() if t in keep}
    main = Vote([unit(weigh(bags[i], vocab)) for i in ids], y, w, prior)
    toxic, clean = (Counter(t for i, z in zip(ids, y, strict=True) if z == c for t in bags[i]) for c in (1, 0))
    n1, n0 = held[1], held[0]

    def ratio(t):
        out = 0.0
        for a, size in ((toxic[t], n1), (clean[t], n0)):
            p = (toxic[t] + clean[t]) / (n1 + n0)
            out += (a * math.log(a / size / p) if a else 0) + ((size - a) * math.log((size - a) / size / (1 - p)) if size > a else 0)
        return 2 * out

    marks = {t for t in vocab if toxic[t] / n1 > 4 * clean[t] / n0 and ratio(t) > 24}
    second = Vote([unit(weigh(bags[i], marks)) for i in ids], y, w, prior) if marks else None
    if second:
        x = np.array([[odds(a), odds(b), 1.0] for a, b in zip(main.own, second.own, strict=True)])
        c, yy, ww = np.zeros(3), np.array(y, float), np.array(w)
        for _ in range(60):  # penalised logistic regression
            p = 1 / (1 + np.exp(-x @ c))
            c += np.linalg.solve((x.T * (ww * p * (1 - p))) @ x + np.eye(3), x.T @ (ww * (yy - p)) - c)
        a, b = max(0.0, c[0]), max(0.0, c[1])
        knots, levels = monotone([a * r[0] + b * r[1] for r in x], y, w)
    out = {}
    for i in texts:
        more = sum((1 + math.log(c)) ** 2 for t, c in bags[i].items() if t not in vocab) * rare * rare
        found = near(unit(weigh(bags[i], vocab), more), main.examples)
        p = main.level(found)
        if second:
            p = float(np.interp(a * odds(p) + b * odds(second.level(near(unit(weigh(bags[i], marks)), second.examples))), knots, levels))
        same = [y[j] for j, s in found if s > 1 - 1e-9]
        out[i] = sum(same) / len(same) if same else p
    return out, marks


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    train = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    table = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()
    labels = {r.doc_id: r.toxic for r in table if train(r.doc_id)}
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int").join(d, "doc_id").select("doc_id", "toxic", "text")
    ids = sorted(r.doc_id for r in toxicity.one_of_each_family(rows).collect())
    want, marks = brute(docs, labels, ids)
    assert marks  # both votes are at work
    got = {r.doc_id: r for r in op10_toxicity(spark, sf).collect()}
    assert set(got) == set(want)
    assert all(abs(got[i].score - p) < 1e-6 for i, p in want.items())
    # only copies of a kept text of the same label are left out
    sets = {i: shingle_set(t) for i, t in docs if i in labels}
    gone = set(labels) & set(sets) - set(ids)
    assert gone
    for i in gone:
        assert any(labels[j] == labels[i] and j < i and sets[j] and jaccard(sets[i], sets[j]) >= 0.8 for j in ids)


def test_families_are_compared(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base), " ".join(base[:59] + ["z"])]
    texts += [" ".join(base[i : i + 12] + [f"x{i}{j}" for j in range(40)]) for i in range(0, 48, 4)]  # share a passage with the first, no more
    texts += ["", None, "!", "a b", "a b"]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)] + [(100, 0, texts[0])], "doc_id long, toxic int, text string")
    got = {r.doc_id for r in toxicity.one_of_each_family(df).collect()}
    n = len(texts)
    assert got - {2} == {0, *range(3, 15), n - 5, n - 4, n - 3, n - 2, 100}
    assert toxicity.one_of_each_family(df.where(F.lit(False))).count() == 0


@given(st.text(alphabet=st.sampled_from("aZ9_ .-'\n\t éßİ²½٣дж字—“”́\ud800"), max_size=40))
def test_words_are_those_of_the_pattern(text):
    assert toxicity.words_of(text) == words(text)
    assert toxicity.words_of(None) == Counter()


def test_families_are_many_small_groups_and_cost_no_data_frame_each(spark):
    df = spark.createDataFrame([(i, i % 2, f"some words of text {i}") for i in range(8)], "doc_id long, toxic int, text string")
    found = toxicity.one_of_each_family(df)
    assert "InPandas" not in found._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in found.collect()) == list(range(8))
