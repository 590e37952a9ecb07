import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from skein.llm import langid, line_dedup
from skein.llm.queries import op5_langid, op7_line_dedup

from .conftest import TEXTS

WS = " \t\n\x0b\x0c\r"


def _fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _brute_lines(rows):
    key = lambda line: _fold(line.strip(WS))
    first, seen = {}, {}
    for d, t in rows:
        if d is not None:
            for k in {key(x) for x in (t or "").split("\n")}:
                if len(k) >= 10:
                    first[k] = min(d, first.get(k, d))
                    seen.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(seen.get(key(x), ())) < 2 or first[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def _ngrams(text):
    """An n-gram (1 to 3 characters of a text whose runs of non-letters are one blank, blanks at the ends only) to its count."""
    c = " " + " ".join(re.sub(".", lambda m: m.group() if m.group().isalpha() else " ", text.lower(), flags=re.S).split()) + " "
    n = Counter(x for x in c if x != " ")
    n.update(a + b for a, b in zip(c, c[1:], strict=False))
    n.update(c[i : i + 3] for i in range(len(c) - 2) if c[i + 1] != " ")
    return n if c.strip() else Counter()


def _ranked(n, top=400):
    """Most frequent first; ties go by length and then by code points."""
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:top]


def brute_languages(train, texts, top=400):
    """Of each text the language of least out-of-place distance and whether any distance is below the greatest."""
    total = {}
    for text, lang in train:
        if lang is not None and text is not None:
            total.setdefault(lang, Counter()).update(_ngrams(text))
    profiles = {x: {g: i for i, g in enumerate(_ranked(n, top))} for x, n in sorted(total.items()) if n}
    out = []
    for t in texts:
        mine = _ranked(_ngrams(t or ""), top)
        if not mine or not profiles:
            out.append(("und", False))
            continue
        far = {x: sum(abs(p[g] - i) if g in p else top for i, g in enumerate(mine)) for x, p in profiles.items()}
        lang = min(far, key=far.get)
        out.append((lang, far[lang] < top * len(mine)))
    return out


def test_languages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    train = [(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    want = brute_languages(train, [r.text for r in rows])
    got = {r.doc_id: r for r in op5_langid(spark, sf).collect()}
    assert [(got[r.doc_id].lang_pred, got[r.doc_id].score > 0) for r in rows] == want
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())


def test_lines_against_brute_force(odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op7_line_dedup(odd_docs.sparkSession, str(tmp_path)).collect()), key=repr)
    assert got == _brute_lines([(r.doc_id, r.text) for r in odd_docs.collect()])
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(odd_docs).collect()}
    assert kept[0] is None and kept[4] == TEXTS[4] and kept[5] == "\tshort\nshort"


def test_hot_lines_are_read_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PROBES_PER_TASK", 7)
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 5)
    rows = [(i, f"the very same line\nline of {i} alone\nline of {i // 3} and others") for i in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    out = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got), key=repr)
    assert out == _brute_lines(rows)


def test_empty(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0
    p = langid.learn_profiles(no_docs)
    assert len(p) == 0 and langid.identify(no_docs, p).count() == 0


def test_perfect_hash_is_perfect():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        mph = line_dedup.PerfectHash.load(*line_dedup.PerfectHash.build(keys).dump())
        assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))


def _brute_grams(text):
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if g.strip() and " " not in g[1:-1] and (n > 1 or g != " "):
                out[g] += 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return {code(g): n for g, n in out.items()}


def test_grams_against_brute_force(monkeypatch):
    for block in (1 << 18, 5, 2):
        monkeypatch.setattr(langid, "_BLOCK", block)
        for t in ["", "a", "Ab 1 c", "déjà vu, Ñandú!", "  x", "🎉 日本語", "abcde fgh ij"]:
            keys, n = langid._grams(t)
            assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == _brute_grams(t), (t, block)


def test_undetermined(odd_docs):
    profiles = langid.learn_profiles(odd_docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd_docs, profiles).collect()}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2, 3, 10))
    assert all(0 <= x[1] <= 1 for x in got.values()) and got[4][0] == "en"
    blank = langid.identify(odd_docs, pd.DataFrame({"lang": [], "gram": [], "rank": []})).collect()
    assert {r.lang_pred for r in blank} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_langid(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
