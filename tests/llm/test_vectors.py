import numpy as np
import pytest

from skein.llm import ann, embed_dedup
from skein.llm.queries import op9_ann

SCHEMA = "vec_id long, embedding array<float>, label int, h1 string"


def _brute(rows, threshold=0.98):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    up = {i: i for i in ids}
    links = {i: set() for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    good = []
    for i, v, y, *_ in rows:
        if i is None or v is None or y is None or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        good.append((i, y, np.array(v, np.float64)))
    for a, (i, y, u) in enumerate(good):
        for j, z, v in good[:a]:
            if y == z and len(u) == len(v) and i != j and u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold:
                links[i].add(j)
                links[j].add(i)
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    out = []
    for i, *_ in rows:
        out.append((i, len(links[i]), root(i), root(i) == i) if i is not None else (None, 0, None, True))
    return sorted(out, key=repr)


def _rows(seed, n=260, dims=8):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((30, dims))
    rows = []
    for i in range(n):
        v = base[rng.integers(30)] * rng.choice([0.5, 1.0, 2.0])
        if rng.random() < 0.8:
            v = v + rng.standard_normal(dims) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)) if i % 3 else 1, "x"))
    rows += [(n + i, rows[7][1], 1, "copy") for i in range(40)]
    odd = [None, [], [0.0] * dims, [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [1.0, 2.0], [1.0, 2.0]]
    rows += [(n + 100 + i, v, 1, None) for i, v in enumerate(odd)]
    rows += [(n + 200, rows[0][1], None, "no label"), (None, rows[0][1], 1, "no id"), rows[5]]
    return rows


@pytest.mark.parametrize("cell", [10**6, 40])
def test_links_against_brute_force(spark, cell):
    rows = _rows(cell % 7)
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), cell=cell)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute(rows)


def test_links_of_ids_with_several_vectors(spark):
    e1, e2 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(3, e1), (3, e2), (3, [1.0, 0.01, 0.0]), (1, e1), (2, [1.0, 0.0, 0.01]), (4, [0.01, 1.0, 0.0]), (3, e2)]
    rng = np.random.default_rng(11)
    rows += [(int(rng.integers(20, 60)), (e + 0.08 * rng.standard_normal(3)).tolist()) for e in np.eye(3)[rng.integers(3, size=150)]]
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in rows]
    distinct = sorted({(i, tuple(v)) for i, v, _ in rows})
    x = np.array([v for _, v in distinct])
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = x @ x.T >= 0.98
    root = np.arange(len(x))
    while True:
        least = np.where(near, root[None, :], len(x)).min(1)
        if (least == root).all():
            break
        root = least
    want = {v: (near[k].sum() - 1, distinct[root[k]][0]) for k, v in enumerate(distinct)}
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((i, *want[i, tuple(v)], i == want[i, tuple(v)][1]) for i, v, _ in rows)


def test_search_of_ids_with_several_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(90)), [float(np.float32(c)) for c in v]) for v in rng.standard_normal((160, 4))] + [(3, [3.0, 0.0, 0.0, 0.0]), (3, [0.0, 3.0, 0.0, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), ann.F.col("vec_id") % 10 == 0, top=5).collect()
    want = set()
    for q in sorted({i for i, _ in rows if i % 10 == 0}):
        score = {}
        for i, v in rows:
            if i != q:
                score[i] = max([score.get(i, -np.inf), *(float(np.dot(u, v)) for j, u in rows if j == q)])
        want |= {(q, k + 1, i, round(s, 9)) for k, (s, i) in enumerate(sorted(((s, i) for i, s in score.items()), key=lambda x: (-x[0], x[1]))[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got} == want and len(got) == len(want)


def test_embeddings_against_brute_force(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label")
    got = sorted((tuple(r) for r in embed_dedup.near_duplicates(t).collect()), key=repr)
    rows = t.collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    y = np.array([r.label for r in rows])
    near = (x @ x.T >= 0.98) & (y[:, None] == y[None, :])
    n = dict(zip([r.vec_id for r in rows], (near.sum(1) - 1).tolist(), strict=True))
    assert {g[0]: g[1] for g in got} == n
    root = np.arange(len(x))
    while ((least := np.where(near, root[None, :], len(x)).min(1)) != root).any():
        root = least
    at = np.argsort([r.vec_id for r in rows])
    assert (np.diff(at) > 0).all()  # so the least place is the least id
    assert {g[0]: (g[2], g[3]) for g in got} == {rows[i].vec_id: (rows[root[i]].vec_id, root[i] == i) for i in range(len(rows))}


def test_cover_tree_holds_everything_within_its_radii():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 6))
    x[100:200] = x[0] + rng.standard_normal((100, 6)) * 0.01
    x /= np.sqrt((x * x).sum(1))[:, None]
    t = embed_dedup.CoverTree(x)
    assert sorted(t.order.tolist()) == list(range(500))
    for v in range(len(t.lo)):
        d = np.sqrt(np.maximum(0, 2 - 2 * t.x[t.lo[v] : t.hi[v]] @ t.x[t.centre[v]]))
        assert d.max() <= t.radius[v] + 1e-7
        if t.kids[v]:
            assert sum(t.hi[k] - t.lo[k] for k in t.kids[v]) == t.hi[v] - t.lo[v]


def _true(rows, is_query, top):
    good = {i: np.array(v, np.float64) for i, v, *_ in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = []
    for q in good:
        if is_query(q):
            best = sorted((-round(float(good[q] @ v), 9), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:top]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return out


def test_search_of_few_is_exact(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.query_id, r["rank"], r.vec_id, -round(r.score, 9)) for r in ann.search(df, ann.F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got) == sorted(_true(rows, lambda q: q % 10 == 0, 20))
    few = rows[:6]
    got = ann.search(spark.createDataFrame(few, SCHEMA), ann.F.col("vec_id") >= 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(x[:3] for x in _true(few, lambda q: True, 20))


def test_very_long_and_very_short_vectors_take_part(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 5))
    x[30:] = x[:30] * 1.5 + rng.standard_normal((30, 5)) * 0.01
    rows = [(i, (v * 10.0 ** (-200 if i % 3 == 0 else 140 if i % 3 == 1 else 0)).tolist(), 1, None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, h1 string")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    y = x / np.sqrt((x * x).sum(1))[:, None]
    assert got == dict(enumerate(((y @ y.T >= 0.98).sum(1) - 1).tolist()))
    found = ann.search(df, ann.F.col("vec_id") % 3 == 2, top=5).collect()
    assert {r.query_id for r in found} == set(range(2, 60, 3)) and all(r.score == pytest.approx(float(np.dot(rows[r.query_id][1], rows[r.vec_id][1])), rel=1e-12) for r in found)
    for q in range(2, 60, 3):
        s = sorted(((-float(np.dot(rows[q][1], v)), i) for i, v, *_ in rows if i != q))[:5]
        assert [i for _, i in s] == [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ann.search(none, ann.F.col("vec_id") % 20 == 0).count() == 0
    assert embed_dedup.near_duplicates(none).count() == 0


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = op9_ann(spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    q = np.flatnonzero(ids % 20 == 0)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    want = {(ids[a], ids[b]) for a, row in zip(q, np.argsort(-s, axis=1)[:, :20], strict=True) for b in row}
    assert len(got) == 20 * len(q)
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)


def test_recall_with_widely_differing_lengths(spark):
    rng = np.random.default_rng(5)
    unit = rng.standard_normal((4000, 64))
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    one = np.ones(4000)
    one[7] = 50  # one long vector among unit ones
    for length in (one, np.exp(rng.standard_normal(4000)), np.exp2(rng.integers(0, 3, 4000))):
        x = (unit * length[:, None]).astype(np.float32).astype(np.float64)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
        got = ann.search(df, ann.F.col("vec_id") % 40 == 0).collect()
        q = np.arange(0, 4000, 40)
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        want = {(a, b) for a, row in zip(q.tolist(), np.argsort(-s, axis=1)[:, :20].tolist(), strict=True) for b in row}
        hit = len({(r.query_id, r.vec_id) for r in got} & want) / len(want)
        print("recall", hit)
        assert len(got) == 20 * len(q) and hit >= 0.9
