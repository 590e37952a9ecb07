import pickle
import random
import re
import zlib

import numpy as np
import pytest

from skein.llm import substring_dedup as sd
from skein.llm import toxicity
from skein.llm.common import word_hashes
from skein.llm.queries import op6_substring_dedup, op10_toxicity


def _parts(text):
    """(part texts, does a sentence end with it) by regular expressions and loops over windows."""
    words = list(re.finditer(r"[^ \t\n\x0b\x0c\r]+", text))
    if not words:
        return ([text], [True]) if text else ([], [])
    ends = []
    for w, after in zip(words, [*words[1:], None], strict=True):
        gap = text[w.end() : after.start() if after else len(text)]
        ends.append(after is None or "\n" in gap or bool(re.search(r"[.!?][\"')\]]*$", w.group())))
    order = word_hashes(text.encode()).tolist()
    cuts = set()
    for i in range(len(words) - sd.LONG + 1):
        if not any(ends[i : i + sd.LONG - 1]):
            least = min(order[i : i + sd.LONG])
            cuts |= {j for j in range(i, i + sd.LONG) if order[j] == least}
    out, whole, at = [], [], 0
    for j in range(len(words)):
        if ends[j] or j in cuts:
            stop = words[j + 1].start() if j + 1 < len(words) else len(text)
            out.append(text[at:stop])
            whole.append(ends[j])
            at = stop
    return out, whole


def _brute(rows, run, min_words):
    """What each document loses, over tuples of words."""
    docs = []
    for d, t in rows:
        parts, whole = _parts(t or "")
        text = [tuple(x.encode().lower().split()) for x in parts]
        n = len(text)
        size = [len(x) for x in text]
        want = set()
        for i in range(n):
            for j in range(i + 1, n):
                if sum(size[i : j + 1]) >= min_words:
                    want.add((i, j))
                    break
        for j in range(n):
            for i in range(j - 1, -1, -1):
                if sum(size[i : j + 1]) >= min_words:
                    want.add((i, j))
                    break
        ends = [j for j in range(n) if whole[j]]
        for k in range(len(ends) - run + 1):
            i, j = ends[k - 1] + 1 if k else 0, ends[k + run - 1]
            if sum(size[i : j + 1]) < min_words:
                want.add((i, j))
        found = [(sum(text[i : j + 1], ()), i, j) for i, j in sorted(want) if sum(size)]
        docs.append((d, t, parts, found))
    first = {}
    for d, _, _, found in docs:
        if d is not None:
            for w, _, _ in found:
                first[w] = min(d, first.get(w, d))
    out = []
    for d, t, parts, found in docs:
        gone = set()
        if d is not None:
            head = {}
            for w, i, j in found:
                head.setdefault(w, (i, j))
                if first[w] != d or i > head[w][1]:
                    gone |= set(range(i, j + 1))
        text = "".join(x for k, x in enumerate(parts) if k not in gone) if gone else t
        out.append((d, text, len(parts), len(gone)))
    return sorted(out, key=repr)


def _got(df, **kw):
    return sorted((tuple(r) for r in sd.dedup_substrings(df, **kw).collect()), key=repr)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert _got(odd_docs, run=2, min_words=4) == _brute(rows, 2, 4)
    assert _got(odd_docs) == _brute(rows, sd.RUN, sd.MIN_WORDS)
    assert _got(no_docs) == []


def test_planted_passages(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    sentence = lambda n=None: " ".join(word() for _ in range(n or rng.randrange(1, 18))).capitalize() + rng.choice(".!?")
    passages = [[sentence() for _ in range(9)] for _ in range(4)] + [[sentence(70)]]
    rows = []
    for d in range(60):
        own = [sentence() for _ in range(rng.randrange(0, 12))]
        if d % 3 == 0:
            p = passages[rng.randrange(5)]
            at = rng.randrange(len(own) + 1)
            own[at:at] = p
            if d % 9 == 0:
                own += p
        rows.append((d, rng.choice([" ", "\n", "  "]).join(own)))
    rng.shuffle(rows)
    got = _got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == _brute(rows, sd.RUN, sd.MIN_WORDS)
    texts = {r[0]: r[1] for r in got}
    for p in passages[:4]:
        whole = [d for d, t in rows if all(s in t for s in p)]
        assert all(all(s not in texts[d] for s in p) for d in whole if d != min(whole))
    clean = {d for d in range(60) if d % 3}
    assert all(r[3] == 0 for r in got if r[0] in clean)


def test_short_sentences(spark):
    three = "It rained all day. We stayed in bed. Nobody came by."
    rows = [(i, f"Number {i} begins {i}. {three} Then {i * 7} went home (see {i}).") for i in range(5)] + [(9, "Yes. No. Yes."), (10, "Yes. No. Why?")]
    got = _got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == _brute(rows, sd.RUN, sd.MIN_WORDS)
    assert [three in r[1] for r in sorted(got)] == [True] + [False] * 6
    assert [r[3] for r in sorted(got)] == [0, 3, 3, 3, 3, 0, 0]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op6_substring_dedup(spark, sf).select("doc_id", "text", "n_sentences", "n_removed").collect()), key=repr)
    assert got == _brute(rows, sd.RUN, sd.MIN_WORDS)


def test_passage_in_the_middle_of_other_sentences(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(7)) for _ in range(n))
    p = words(60)
    rows = [(i, f"{words(20)} {p} {words(25)}") for i in range(4)]
    got = _got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(len(set(r[1].split()) & set(p.split())) <= 30 for r in got if r[0] > 0)
    assert got[0][1] == rows[0][1]


def _index(rng, n_terms=40, n=300):
    ix = toxicity.Index({f"t{i}": i for i in range(n_terms)}, rng.random(n_terms) + 0.5, 0.1)
    vectors = []
    for _ in range(n):
        t = np.sort(rng.choice(n_terms, rng.integers(0, 6), replace=False))
        vectors.append(ix.unit(t, rng.integers(1, 5, len(t)).astype(float)))
    ix.toxic = rng.integers(0, 2, n).astype(float)
    ix.weight = np.ones(n)
    ix.doc_ids = list(range(n))
    ix.build(vectors)
    return ix, vectors


@pytest.mark.parametrize("dense", [384, 5, 0])
def test_nearest_is_exact(monkeypatch, dense):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(toxicity, "DENSE", dense)
    ix, vectors = _index(rng)
    dense = np.zeros((len(vectors), 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i, (t, w) in enumerate(vectors):
        for skip in (-1, i):
            s = np.round(dense @ dense[i], 12)
            if skip >= 0:
                s[skip] = 0
            want = sorted((-v, j) for j, v in enumerate(s) if v > 0)[:15]
            ids, sims = ix.nearest([(t, w)], 15, [skip])[0]
            assert ids.tolist() == [j for _, j in want] and np.allclose(sims, [-v for v, _ in want])


def test_calibration_is_monotone():
    ix, vectors = _index(np.random.default_rng(3))
    ix.calibrate(vectors, 15)
    assert (np.diff(ix.knots) >= 0).all() and (np.diff(ix.levels) >= 0).all()
    assert 0 <= ix.levels.min() and ix.levels.max() <= 1


def test_odd_rows_are_scored(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    train = spark.createDataFrame([(i, ("foul vile words here " if i % 2 else "kind calm words here ") + " ".join(chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + j) for j in range(60))) for i in range(40)], "doc_id long, text string")
    ix, _ = toxicity.fit(train, labels, train)
    got = {r.doc_id: r for r in toxicity.score(train.unionByName(spark.createDataFrame([(99, None), (98, "")], train.schema)), ix).collect()}
    assert got[1].score > 0.9 and got[2].score < 0.1 and 0 <= got[99].score < 0.5 and got[98].score == got[99].score
    assert got[1].evidence[0]["toxic"] == 1
    rest = toxicity.score(odd_docs, ix).collect()
    assert len(rest) == odd_docs.count() and all(0 <= r.score <= 1 for r in rest)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels.limit(0), no_docs)[0]).count() == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op10_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(p and y for p, y in held)
    assert hit >= 0.85 * sum(y for _, y in held) and hit >= 0.95 * sum(p for p, _ in held)


def test_all_words_count(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) + " the same end" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(60)], "doc_id long, toxic int")
    ix, read = toxicity.fit(docs, labels, docs)
    sent = pickle.loads(pickle.dumps(ix))
    assert sent.terms == ix.terms and sent.score([toxicity.bag(texts[5], sent.terms)], 15)[0][0] == ix.score([toxicity.bag(texts[5], ix.terms)], 15)[0][0]
    assert (sent.packed == ix.packed).all() and np.allclose(sent.full, ix.full, rtol=1e-12) and (sent.tf == ix.tf).all()
    assert sorted(toxicity.score_bags(read, ix).select("doc_id", "score").collect()) == sorted(toxicity.score(docs, ix).select("doc_id", "score").collect())
    t, tf = np.array([0, 3, 9]), np.array([1.0, 70000.0, 2.0])
    assert all((x == y).all() for x, y in zip(toxicity.unpack(*toxicity.pack(t, tf)), (t, tf), strict=True))
    part = " ".join(texts[2].split()[:40] + texts[30].split()[:20])
    asked = spark.createDataFrame([(100, texts[3]), (101, texts[20]), (102, part)], docs.schema)
    got = {r.doc_id: r for r in toxicity.score(asked, ix).collect()}
    assert got[100].score > 0.9 and got[101].score < 0.1  # no word marks the toxic ones
    assert [e.doc_id for e in got[100].evidence][0] == 3 and [e.doc_id for e in got[102].evidence][:2] == [2, 30]
    df = {}
    for x in texts:
        for w in set(x.split()):
            df[w] = df.get(w, 0) + 1
    vec = lambda x: {w: (1 + np.log(x.split().count(w))) * (np.log(61 / (1 + df[w])) + 1) for w in set(x.split())}
    cos = lambda a, b: sum(v * b.get(w, 0) for w, v in a.items()) / np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    want = sorted(((round(cos(vec(part), vec(x)), 9), -i) for i, x in enumerate(texts)), reverse=True)[:5]
    assert [(round(e.cosine, 9), -e.doc_id) for e in got[102].evidence] == want


def test_every_passage_of_fifty_words_holds_a_span():
    rng = random.Random(2)
    words = lambda n: ["".join(rng.choice("klmnopqr") for _ in range(7)) for _ in range(n)]

    def marked(w, low, high, first):
        """Sentences of low to high words, the first of ``first``."""
        out, left = [], first
        for x in w:
            left -= 1
            out.append(x + "." * (left == 0))
            left = left or rng.randrange(low, high + 1)
        return out

    for low, high in ((12, 30), (17, 32), (3, 14), (1, 60)):
        for _ in range(300):
            p = marked(words(50), low, high, rng.randrange(1, high + 1))
            a, b = (" ".join(marked(words(n := rng.randrange(40)), low, high, rng.randrange(1, high + 1))[:n] + p + words(rng.randrange(40))).encode() for _ in range(2))
            assert len(np.intersect1d(sd.spans(a, sd.RUN, sd.MIN_WORDS)[1], sd.spans(b, sd.RUN, sd.MIN_WORDS)[1])), (a, b)
