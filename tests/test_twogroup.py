import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import evaluate, twogroup


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f in ("normal", "ties", "flat", "short"):
        n = 3 if f == "short" else 60
        for i in range(n):
            y = int(i % 3 == 0)
            v = {"normal": rng.normal() + 0.6 * y, "ties": float(rng.integers(0, 4) + y), "flat": 2.0, "short": float(i)}[f]
            rows.append((i, f, y, v))
    pdf = pd.DataFrame(rows, columns=["sample_id", "feature", "y", "value"])
    return pdf, spark.createDataFrame(pdf).cache()


def _auc(pos, neg):
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


def test_auc_against_pair_counting(data, spread):
    pdf, df = data
    got = {r.feature: r.auc for r in evaluate.auc(df, ["feature"], "value").collect()}
    for f, part in pdf.groupby("feature"):
        assert got[f] == pytest.approx(_auc(part.value[part.y == 1], part.value[part.y == 0]))


def test_auc_of_negated_score_and_u(data):
    _, df = data
    a = {r.feature: r for r in twogroup.mann_whitney(df, ["feature"]).collect()}
    b = {r.feature: r.auc for r in evaluate.auc(df.withColumn("value", -F.col("value")), ["feature"], "value").collect()}
    for f, r in a.items():
        assert r.auc + b[f] == pytest.approx(1.0)
        assert r.auc == pytest.approx(r.u / (r.n1 * r.n0))


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, score double")
    assert evaluate.auc(df, []).first()["auc"] is None


def test_effect_size_edge_cases(data):
    _, df = data
    got = {r.feature: r for r in twogroup.effect_sizes(df, ["feature"]).collect()}
    assert got["flat"].d_pooled is None and got["flat"].d_average is None
    assert got["short"].d_pooled is None  # one member in a class
    assert got["normal"].d_pooled > 0


def test_student_and_welch(data):
    pdf, df = data
    part = pdf[pdf.feature == "normal"]
    a, b = part.value[part.y == 1], part.value[part.y == 0]
    got = twogroup.t_tests(df.filter("feature = 'normal'"), ["feature"]).first()
    assert got.welch_t == pytest.approx((a.mean() - b.mean()) / math.sqrt(a.var() / len(a) + b.var() / len(b)))
    sp = ((len(a) - 1) * a.var() + (len(b) - 1) * b.var()) / (len(a) + len(b) - 2)
    assert got.student_t == pytest.approx((a.mean() - b.mean()) / math.sqrt(sp * (1 / len(a) + 1 / len(b))))


def test_fdr_matches_definition_and_skips_nulls(spark, spread):
    p = [0.01, 0.04, 0.03, 0.04, 0.5, None, 0.001]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = {r.i: r.fdr for r in twogroup.adjust_fdr(df).collect()}
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    want, low = {}, 1.0
    for rank in range(len(known), 0, -1):
        low = min(low, known[rank - 1][0] * len(known) / rank)
        want[known[rank - 1][1]] = low
    assert got[5] is None
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want)


def test_kendall_matches_pairs(spark, spread):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 12, 150), rng.integers(0, 9, 150)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = twogroup.kendall_tau(df, "x", "y").first()
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    assert got.concordant == (s > 0).sum() / 2 and got.discordant == (s < 0).sum() / 2
    assert got.tau == pytest.approx(s.sum() / math.sqrt((x[:, None] != x).sum() * (y[:, None] != y).sum()))


def test_exact_rank_test_three_against_three(spark):
    df = spark.createDataFrame([(1, float(i)) for i in (4, 5, 6)] + [(0, float(i)) for i in (1, 2, 3)], "y int, value double")
    assert twogroup.mann_whitney_exact(df, []).first()["p_exact"] == pytest.approx(0.1)


def test_exact_rank_test_of_many_rows_with_ties(spark):
    rng = np.random.default_rng(5)
    for n, n1 in ((23, 4), (24, 20)):
        x = rng.integers(0, 9, n)
        y = np.arange(n) < n1
        got = twogroup.mann_whitney_exact(spark.createDataFrame([(int(b), float(a)) for a, b in zip(x, y)], "y int, value double"), []).first()
        rank = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
        few = list(combinations(range(n), min(n1, n - n1)))
        sums = np.array([rank[list(c)].sum() for c in few])
        seen = rank[y].sum() if n1 < n - n1 else rank[~y].sum()
        mean = len(few[0]) * rank.mean()
        assert got["p_exact"] == pytest.approx((abs(sums - mean) >= abs(seen - mean) - 1e-9).mean(), abs=1e-12)


def test_exact_permutation_beyond_twenty_rows(spark):
    x = np.array([9.0, 8.5, 7.0] + [float(i % 7) for i in range(18)])
    got = twogroup.exact_permutation(spark.createDataFrame([(int(i < 3), float(v)) for i, v in enumerate(x)], "y int, value double"), []).first()
    sums = np.array([x[list(c)].sum() for c in combinations(range(21), 3)])
    gap = sums / 3 - (x.sum() - sums) / 18
    assert got["n_splits"] == len(sums) and got["p_exact"] == pytest.approx((abs(gap) >= abs(gap[0]) - 1e-12).mean())


def test_meta_analysis_by_hand(spark):
    rows = [("g", 0.99, 15, 34), ("g", 0.63, 10, 13), ("g", -0.1, 80, 100), ("g", 2.0, 1, 10)]
    got = twogroup.meta_analysis(spark.createDataFrame(rows, "feature string, d double, n1 int, n0 int")).first()
    d = np.array([r[1] for r in rows[:3]])
    n1, n0 = (np.array([r[i] for r in rows[:3]], dtype=float) for i in (2, 3))
    w = 1 / ((n1 + n0) / (n1 * n0) + d**2 / (2 * (n1 + n0)))
    fixed = (w * d).sum() / w.sum()
    q = (w * (d - fixed) ** 2).sum()
    tau2 = max(0, (q - 2) / (w.sum() - (w**2).sum() / w.sum()))
    wr = 1 / (1 / w + tau2)
    assert got.k == 3 and got.fixed_effect == pytest.approx(fixed) and got.q == pytest.approx(q)
    assert got.tau2 == pytest.approx(tau2) and got.random_effect == pytest.approx((wr * d).sum() / wr.sum())
    assert got.consistency == pytest.approx(2 / 3)


def test_moderated_t_shrinks_towards_prior(spark):
    rng = np.random.default_rng(2)
    rows = []
    for f in range(80):
        sd = float(np.sqrt(1 / rng.gamma(3, 0.4)))
        rows += [(f, i % 2, float(rng.normal(0, sd))) for i in range(10)]
    got = twogroup.moderated_t(spark.createDataFrame(rows, "feature int, y int, value double")).toPandas()
    d0, s02 = got.d0.iloc[0], got.s02.iloc[0]
    assert 1 < d0 < 60
    assert np.allclose(got.s2_post, (d0 * s02 + 8 * got.s2) / (d0 + 8))
    assert ((got.s2_post - got.s2) * (s02 - got.s2) >= 0).all()


def test_curve_tables_and_youden(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, score double")
    c = evaluate.curve(df, []).orderBy(F.desc("threshold")).collect()
    assert [(r.tp, r.fp) for r in c] == [(1, 0), (2, 1), (2, 2)]
    assert evaluate.youden(df, []).first()["threshold"] == 0.9  # J ties go to the higher threshold


def test_splits_are_counted_from_both_halves(spark):
    """Equal to listing all splits at small sizes, with ties and a difference of zero; no error up to sixty rows."""
    from itertools import combinations
    from math import comb

    rng = np.random.default_rng(9)
    data = {"a": (rng.normal(size=11), 4), "b": (rng.integers(0, 3, 10).astype(float), 5), "c": (np.array([1.0, 2.0, 2.0, 1.0]), 2), "d": (rng.normal(size=2), 1), "e": (rng.normal(size=14) * 1e6, 1)}
    rows = [(k, int(i < n1), float(x)) for k, (v, n1) in data.items() for i, x in enumerate(v)] + [("f", 1, 1.0), ("f", 1, 2.0), ("a", 1, None)]
    got = {r["k"]: r for r in twogroup.exact_permutation(spark.createDataFrame(rows, "k string, y int, value double"), ["k"]).collect()}
    assert set(got) == set(data)
    for k, (v, n1) in data.items():
        n = len(v)
        seen = abs(v[:n1].mean() - v[n1:].mean())
        hits = sum(abs(v[list(p)].mean() - np.delete(v, list(p)).mean()) >= seen - 1e-12 for p in combinations(range(n), n1))
        assert got[k]["n_splits"] == comb(n, n1) and got[k]["p_exact"] == pytest.approx(hits / comb(n, n1))
    big = [("x", int(i % 13 == 0), float(i % 5)) for i in range(40)]
    one = twogroup.exact_permutation(spark.createDataFrame(big, "k string, y int, value double"), ["k"]).first()
    values = np.array([r[2] for r in big])
    cases = [r[2] for r in big if r[1]]
    seen = abs(np.mean(cases) - (values.sum() - sum(cases)) / 36)
    counts = np.bincount(values.astype(int), minlength=5)
    ways = sum(
        comb(counts[0], a) * comb(counts[1], b) * comb(counts[2], c) * comb(counts[3], d) * comb(counts[4], 4 - a - b - c - d)
        for a in range(5) for b in range(5 - a) for c in range(5 - a - b) for d in range(5 - a - b - c)
        if abs((b + 2 * c + 3 * d + 4 * (4 - a - b - c - d)) / 4 - (values.sum() - (b + 2 * c + 3 * d + 4 * (4 - a - b - c - d))) / 36) >= seen - 1e-12
    )
    assert one["n_splits"] == comb(40, 4) and one["p_exact"] == pytest.approx(ways / comb(40, 4))


def test_long_keys_take_the_normal_form(spark):
    rng = np.random.default_rng(10)
    rows = [("long", int(i % 2), float(v)) for i, v in enumerate(rng.normal(size=80))] + [("short", int(i % 2), float(v)) for i, v in enumerate(rng.normal(size=12))]
    df = spark.createDataFrame(rows, "k string, y int, value double")
    got = {r["k"]: r for r in twogroup.mann_whitney_exact(df, ["k"], max_rows=40).collect()}
    normal = {r["k"]: r["p"] for r in twogroup.mann_whitney(df, ["k"]).collect()}
    every = {r["k"]: r["p_exact"] for r in twogroup.mann_whitney_exact(df, ["k"]).collect()}
    assert not got["long"]["exact"] and got["long"]["p_exact"] == normal["long"] and got["long"]["p_exact"] == pytest.approx(every["long"], abs=0.01)
    assert got["short"]["exact"] and got["short"]["p_exact"] == every["short"]
    assert twogroup.mann_whitney_exact(df.filter("k = 'short'"), []).first()["p_exact"] == pytest.approx(every["short"])
