import itertools
import random

import pytest

from skein.llm import variants as V


def apart(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    """{word: (form, root, n, n_near, form_n)}"""
    near = {w: [v for v in words if apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def made_words(seed, n=400):
    rng = random.Random(seed)
    words = {}
    for _ in range(n):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(5, 9)))
        words[w] = rng.choice([3, 3, 4, 6, 6, 12, 30, 100])
    return words


@pytest.mark.parametrize("shard,few", [(20_000, 12), (7, 12), (50, 0)])
def test_equal_to_brute_force(spark, monkeypatch, shard, few):
    monkeypatch.setattr(V, "SHARD", shard)
    monkeypatch.setattr(V, "_FEW", few)
    words = made_words(shard)
    got = V.group(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute(words) and len(got) == len(words)


def test_each_pair_once(spark):
    words = made_words(3)
    got = [(r["word"], r["near"]) for r in V.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in itertools.permutations(words, 2) if apart(a, b)}


def test_long_chain_and_lengths(spark):
    words = {"aaaaa" + "b" * i: 3 * 2**i for i in range(12)} | {"x" * 3000: 5, "x" * 3001: 50}
    got = V.group(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r["word"]: r["root"] for r in got} == {w: x[1] for w, x in brute(words).items()}


def test_noise_and_odd_rows(spark, odd_docs, no_docs):
    import re
    import zlib

    want = {}
    for r in odd_docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            w = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
            if w:
                want[w] = want.get(w, 0) + 1
    got = V.noisy_words(odd_docs)
    assert {r["word"]: r["n"] for r in got.collect()} == want
    assert not V.group(V.noisy_words(no_docs)).count()
    clash = got.selectExpr("word", "n", "1 as near", "2 as form", "3 as part", "'x' as letters")
    assert {r["word"]: r["root"] for r in V.group(clash).collect()} == {w: x[1] for w, x in brute({w: n for w, n in want.items() if len(w) >= 5 and n >= 3}).items()}
