import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import hard_negatives as H


def brute(rows, every=10, scale=256):
    ok = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok[i, label, tuple(math.floor(scale * float(x)) for x in v)] = True
    out = set()
    for a, la, va in ok:
        if a % every:
            continue
        score = [(sum(x * y for x, y in zip(va, v)), b, lb) for b, lb, v in ok if b != a and len(v) == len(va)]
        score.sort(key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in score if s[2] == la][:5]:
            neg = [s for s in score if s[2] != la and 80 * ps <= 100 * s[0] <= 100 * ps][:5]
            out |= {(a, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(neg)}
    return out


def mined(spark, rows, every=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("x")).withColumn("pack", F.lit(1)).repartition(3)
    got = [tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("group,block", [(2048, 512), (16, 4)])
def test_equal_to_brute_force(spark, monkeypatch, group, block):
    monkeypatch.setattr(H, "GROUP", group)
    monkeypatch.setattr(H, "BLOCK", block)
    rng = np.random.default_rng(group)
    centre = rng.normal(size=(6, 8))
    x = (centre[rng.integers(6, size=300)] + 0.3 * rng.normal(size=(300, 8))).astype(np.float32)
    rows = [(i, v.tolist(), int(rng.integers(4))) for i, v in enumerate(x)]
    assert mined(spark, rows) == brute(rows)


def test_copies_lengths_ties_and_what_takes_no_part(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP", 8)
    rng = np.random.default_rng(5)
    rows = [(i, [0.5, 0.25, -0.125], i % 3) for i in range(60)]  # one vector of many ids
    rows += [(100 + i, rng.normal(size=3).tolist(), i % 3) for i in range(40)]
    rows += [(200 + i, rng.normal(size=5).tolist(), i % 2) for i in range(30)]
    rows += [(300, None, 1), (310, [1.0, None, 2.0], 1), (320, [1.0, float("nan"), 0.0], 1), (330, [float("inf"), 0.0, 0.0], 1), (340, [1.0, 1.0, 1.0], None), (350, [], 1), (360, [0.0, 0.0, 0.0], 1), (370, [50.0, 1.0, 1.0], 2), (None, [1.0, 1.0, 1.0], 1)]
    rows += rows[:5]
    assert mined(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert mined(spark, []) == set()
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (3, [-1.0, 0.0], 1)]
    assert mined(spark, rows) == brute(rows) and brute(rows)


def test_a_repeated_id_is_never_its_own_partner(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.05], 2), (1, [0.9, 0.0], 1), (2, [0.85, 0.0], 2), (2, [0.8, 0.1], 2)]
    got = mined(spark, rows)
    assert got and all(len({a, p, n}) == 3 for a, p, _, n, _, _ in got)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + 37 * i), float(i)], i % 2) for i in range(20)]
    assert mined(spark, rows) == brute(rows)
