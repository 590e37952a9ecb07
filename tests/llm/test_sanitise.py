import math
import random
import re

import pytest
from pyspark.sql import functions as F

from skein.llm import sanitise as S

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(v):
    return re.sub("[^0-9]", "", v)


def luhn(v):
    return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(v)))) % 10 == 0


PASS = {
    "email": lambda v: True,
    "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
    "card": lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v)),
    "phone": lambda v: 8 <= len(digits(v)) <= 15,
}


def base_of(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if PASS[k](m.group())]


def said_of(docs, window, least):
    """Disclosing terms by the definition: {(id, start, end)}."""
    edge = r"[\s,;:!?()\"']"
    term = re.compile(rf"(?<={edge})[^\W\d_]{{3,}}(?=\.?{edge})")
    at, both, entity, word = [], {}, {}, {}
    for i, text in docs:
        text = text or ""
        for w in set(re.findall(r"[^\W\d_]{3,}", text.lower())):
            word[w] = word.get(w, 0) + 1
        pairs, own = set(), set()
        for k, p in PLAIN.items():
            found = [m for m in re.finditer(p, text)]
            if k == "card":  # only chains of passing length part the text
                found = [m for m in found if 16 <= len(digits(m.group())) <= 19]
            for n, m in enumerate(found):
                if not PASS[k](m.group()):
                    continue
                e = f"{k}:" + (m.group().lower() if k == "email" else m.group() if k == "ip" else digits(m.group()))
                own.add(e)
                before = found[n - 1].end() if n else 0
                after = found[n + 1].start() if n + 1 < len(found) else len(text)
                left, right = (" " + text[before : m.start()])[-window:], (text[m.end() : after] + " ")[:window]
                for off, part in ((m.start() - len(left), left), (m.end(), right)):
                    for x in term.finditer(part):
                        pairs.add((e, x.group().lower()))
                        at.append((i, e, x.group().lower(), off + x.start(), off + x.end()))
        for x in pairs:
            both[x] = both.get(x, 0) + 1
        for e in own:
            entity[e] = entity.get(e, 0) + 1
    n = len(docs)

    def level(e, t):
        if both[e, t] < S.MIN_DOCS or entity[e] >= n:
            return 0
        return math.log(both[e, t] * n / (word[t] * entity[e])) / math.log(n / entity[e])

    return {(i, a, b) for i, e, t, a, b in at if level(e, t) >= least}


def made_docs():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "meier", "schön", "the", "of", "x.y", "12", "a@b", "9.9", "été"]
    things = ["anna.meier@mail.example.com", "A_B%c@d-e.f.g", "10.0.0.255", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111111111111", "+1 (212) 555-0199", "+49 30", "+1.2.3.4.5.6.7.8"]
    out = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(2, 40)):
            text.append(rng.choice(words) if rng.random() < 0.8 else rng.choice(things))
        if i % 6 == 0:
            text.append("Rosalind writes, from: 10.1.2.3 to Rosalind.")
        out.append((i, rng.choice([" ", "  ", ", ", "\n"]).join(text)))
    return out + [(200, None), (201, ""), (202, "1.2.3.4.5.6.7.8@x.y@z.w"), (203, "7" * 20000 + " " + "a" * 20000 + "@b" + ".c" * 5000), (204, "x@y.zé_d@e.f é@g.h")]


def test_patterns_and_disclosures_equal_brute_force(spark):
    docs = made_docs()
    got = S.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    texts = dict(docs)
    for r in got:
        assert [tuple(x) for x in r["base"]] == base_of(texts[r["doc_id"]]), r["doc_id"]
        assert [tuple(x) for x in r["spans"]][: len(r["base"])] == base_of(texts[r["doc_id"]])
    said = {(r["doc_id"], x["start"], x["end"]) for r in got for x in r["spans"] if x["kind"] == "term"}
    assert said == said_of(docs, S.WINDOW, S.GENERALISE)
    assert any(texts[i][a:b] == "Rosalind" for i, a, b in said)


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 10, 1000):
        x = list(range(1, n + 1))
        got = spark.createDataFrame([(x,)], "x array<bigint>").select(S.running(F.col("x"))).first()[0]
        assert got == [sum(x[: i + 1]) for i in range(n)]


def test_sanitised_text(spark):
    docs = [(i, f"filler{i} words by Rosalind at 10.1.2.3 today" if i < 5 else "nothing by anyone today") for i in range(200)]
    got = {r["doc_id"]: r for r in S.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0]["text"] == "filler0 words by  at <ip> today".replace("words", "") and got[0]["n_removed"] == 2  # words, Rosalind
    assert got[150]["text"] == docs[150][1] and got[150]["n_generalised"] == 0


def test_odd_rows(spark, odd_docs, no_docs):
    got = S.find(odd_docs).collect()
    assert len(got) == odd_docs.count() and not S.find(no_docs).count()
    assert all(not r["base"] and not r["spans"] for r in got)
    clean = {(r["doc_id"], r["text"]) for r in S.sanitise(odd_docs).collect()}
    assert clean == {(r["doc_id"], r["text"]) for r in odd_docs.collect()}


def test_no_python_in_the_plan(spark):
    plan = S.find(spark.createDataFrame(made_docs()[:9], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_digests(spark, tmp_path):
    import hashlib

    from skein.llm.queries import op11_pii

    docs = made_docs()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op11_pii(spark, str(tmp_path)).collect():
        base = base_of(dict(docs)[r["doc_id"]])
        joined = ",".join(":".join(map(str, x)) for x in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(x[0] == k for x in base) for k in PLAIN)
