import random
import re
from itertools import combinations

import numpy as np
import pytest

from skein.llm import ngram_join as nj
from skein.llm.common import shingles, word_hashes
from skein.llm.components import connected

SF = "/root/testdata/sf0.01"


def _fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", _fold(text or ""))


def brute_sets(rows, k):
    out = []
    for _, t in rows:
        w = words(t)
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def brute(rows, k=3, num=90, den=100):
    sets = brute_sets(rows, k)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for e in s:
                by.setdefault(e, []).append(i)
    seen = {}
    for v in by.values():
        for p in combinations(v, 2):
            seen[p] = seen.get(p, 0) + 1
    for (i, j), n in seen.items():
        if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = root(i)
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(sets[i]), None if d is None else least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def got(df, **kw):
    return sorted((tuple(r) for r in nj.jaccard_components(df, **kw).collect()), key=repr)


def test_words_and_shingles_count_alike():
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["a", "B", "é", " ", "\n", "\x0b", "日", "b"]) for _ in range(rng.randrange(20)))
        w = words(t)
        h = word_hashes(t.encode())
        assert len(h) == len(w) and len(set(h.tolist())) == len(set(w))
        assert len(shingles(t.encode(), 3)) == len(brute_sets([(0, t)], 3)[0])


def test_long_texts_hash_alike_in_blocks(monkeypatch):
    t = ("some words of Text " * 500).encode() + b"x" * 300 + b" end"
    whole = word_hashes(t)
    monkeypatch.setattr("skein.llm.common._CHUNK", 64)
    assert np.array_equal(whole, word_hashes(t))


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(odd_docs) == brute(rows)
    assert got(no_docs) == []


def _copies(rng, n):
    rows = []
    for family in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 8, 21, 40, 90, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - rng.randrange(12))]
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_brute_force(spark, seed):
    rows = _copies(random.Random(seed), 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == brute(rows)
    assert got(df, block=600) == brute(rows)
    assert got(df, block=600, members=4) == brute(rows)


def test_pipeline_thresholds(spark):
    rows = _copies(random.Random(5), 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, k=5, num=80, den=100) == brute(rows, 5, 80, 100)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_tree_against_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64))
        sets, seen = [], set()
        for _ in range(25):
            s = np.unique(np.concatenate((rng.choice(base, rng.integers(1, len(base)), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 4)).astype(np.uint64))))
            if s.tobytes() not in seen:
                seen.add(s.tobytes())
                sets.append(s)
        tree = nj.PrefixTree(sets, np.array([len(s) for s in sets]))
        for s in sets:
            want = {i for i, t in enumerate(sets) if nj.enough(len(np.intersect1d(s, t)), len(s), len(t), 60, 100)}
            assert set(tree.probe(s, len(s), 60, 100).tolist()) == want


def test_linked_sets_share_a_prefix_element_whatever_the_sketch_says():
    rng = np.random.default_rng(11)
    for num, den in ((90, 100), (80, 100), (1, 3)):
        for n in [*range(1, 60), 150, 400]:
            for _ in range(6):
                level = rng.integers(0, 3, 64).astype(np.uint8)
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
                gone, more = rng.integers(0, 2 + n // 6, 2)
                b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 63, more).astype(np.uint64) * np.uint64(2))))
                if len(b) and nj.enough(len(np.intersect1d(a, b)), len(a), len(b), num, den):
                    assert set(nj.prefix(a, level, num, den).tolist()) & set(nj.prefix(b, level, num, den).tolist())


def test_bitmaps_never_part_linked_sets():
    rng = np.random.default_rng(21)
    for num, den in ((90, 100), (80, 100), (1, 2), (1, 4)):
        base = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2))
        sets = []
        for n in [*range(1, 40), *rng.integers(40, 300, 60)]:
            s = rng.permutation(base[: n + n // 5])[:n]
            sets.append(np.unique(np.concatenate((s, rng.integers(0, 1 << 63, n // 30).astype(np.uint64)))))
        label = nj.may_link(np.array([len(s) for s in sets]), [nj.bitmap(s) for s in sets], num, den)
        for i, j in combinations(range(len(sets)), 2):
            if nj.enough(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), num, den):
                assert label[i] == label[j]
    strangers = [np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(50)]
    assert nj.may_link(np.array([len(s) for s in strangers]), [nj.bitmap(s) for s in strangers], 80, 100).tolist() == list(range(50))


def test_frequent_shingles_come_last_and_links_do_not_depend_on_the_sketch(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(120):
        own = [f"d{i}w{j}" for j in range(rng.choice([3, 12, 60]))]
        rows.append((i, " ".join(own + passage if i % 2 else passage + own)))
    rows += [(200 + i, rows[i][1] + " tail") for i in range(0, 120, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    assert got(df) == want
    assert got(df, width=64) == want
    assert got(df, block=500) == want
    level = nj.levels(np.array([1, 1, 1, 1, 1, 1, 1, 400]))
    assert level.tolist() == [0] * 7 + [level[7]] and level[7] > 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    loose = [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(180)]
    edges = chain + star + [e for e in loose if e[0] != e[1]]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    nodes = {x for e in edges for x in e}
    assert {(r.node, r.root) for r in connected(df).collect()} == {(x, root(x)) for x in nodes}
    assert connected(df.limit(0)).count() == 0


def test_linked_sets_share_a_file_and_strangers_of_common_shingles_do_not():
    rng = np.random.default_rng(17)
    new = lambda n: np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    for num, den in ((90, 100), (95, 100), (87, 100)):
        ranges = nj.Ranges(num, den)
        linked = 0
        for n in [*range(1, 80), 150, 400, 2000]:
            for _ in range(40):
                a = new(n)
                gone, more = rng.integers(0, 2 + n * (den - num) // den, 2)
                b = np.unique(np.concatenate((rng.permutation(a)[gone:], new(more))))
                if len(b) and not np.array_equal(a, b) and nj.enough(len(np.intersect1d(a, b)), len(a), len(b), num, den):
                    linked += 1
                    assert set(ranges.files(a).tolist()) & set(ranges.files(b).tolist()), (n, gone, more)
        assert linked > 300
    # ranges that hold nothing are no file of their own
    ranges = nj.Ranges(90, 100)
    few = [new(10) for _ in range(3000)]
    files = np.concatenate([ranges.files(s) for s in few])
    assert np.unique(files, return_counts=True)[1].max() <= 3
    # texts over a small vocabulary of shingles: by prefixes nearly all are candidates
    vocab = new(3000)
    some = [np.sort(rng.permutation(vocab)[:300]) for _ in range(200)]
    files = np.concatenate([ranges.files(s) for s in some])
    assert len(np.unique(files)) == len(files)
    prefixes = np.concatenate([nj.prefix(s, np.zeros(1, np.uint8), 90, 100) for s in some])
    assert len(np.unique(prefixes)) < len(prefixes) / 2


def test_candidates_grow_no_faster_than_the_texts(spark, monkeypatch):
    seen = {}
    cut = nj.cut

    def counted(df, name="cut"):
        out = cut(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(nj, "cut", counted)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(120))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, 400, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df) == brute(rows)
    assert seen["candidates"] <= 100  # 50 copies; by prefixes hundreds share a shingle
