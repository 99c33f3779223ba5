"""Replicates over one order of the scores, and composed operators, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import evaluate, models, network, resample, rollup


def areas(score, y, w):
    """Weighted AUC and average precision by definition."""
    pos, neg = y == 1, y == 0
    n1, n0 = w[pos].sum(), w[neg].sum()
    if n1 == 0 or n0 == 0:
        return None, None
    d = score[pos][:, None] - score[neg]
    area = (w[pos][:, None] * w[neg] * ((d > 0) + 0.5 * (d == 0))).sum() / (n1 * n0)
    ap, before = 0.0, 0.0
    for t in sorted(set(score[w > 0]), reverse=True):
        tp, seen = w[pos & (score >= t)].sum(), w[score >= t].sum()
        ap += (tp - before) * tp / seen / n1
        before = tp
    return area, ap


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(90) < 0.3).astype(int)
    a, b = np.round(rng.normal(size=90) + y, 1), np.where(rng.random(90) < 0.9, 0.5, rng.random(90))  # the second ties on 90 % of the rows
    df = spark.createDataFrame([(int(i * 3), int(y[i]), float(a[i]), float(b[i])) for i in range(90)] + [(1000, None, 1.0, 1.0), (1001, 1, None, 1.0)], "id bigint, y int, a double, b double")
    return y, {"a": a, "b": b}, df.cache()


@pytest.mark.parametrize("packed", [True, False])
def test_bootstrap_metrics_by_definition(scored, monkeypatch, packed):
    if not packed:
        monkeypatch.setattr(resample, "ORDERED_BYTES", 0)
    y, scores, df = scored
    got = {(r["rep"], r["model"]): r for r in resample.bootstrap_metrics(df, "id", ["a", "b"], 15).collect()}
    assert len(got) == 30
    for (rep, model), r in got.items():
        area, ap = areas(scores[model], y, resample.drawn_counts(90, rep).astype(float))
        assert r["auc"] == pytest.approx(area) and r["average_precision"] == pytest.approx(ap) and r["attempts"] == 1


@pytest.mark.parametrize("packed", [True, False])
def test_redraws_until_both_classes(spark, monkeypatch, packed):
    if not packed:
        monkeypatch.setattr(resample, "ORDERED_BYTES", 0)
    y, score = np.array([1, 0, 0, 0]), np.array([0.2, 0.1, 0.3, 0.1])
    df = spark.createDataFrame([(i, int(y[i]), float(score[i])) for i in range(4)], "id bigint, y int, s double")
    got = {r["rep"]: r for r in resample.bootstrap_metrics(df, "id", ["s"], 12, redraw=True).collect()}
    assert sorted(got) == list(range(12)) and max(r["attempts"] for r in got.values()) > 1
    for rep, r in got.items():
        attempt = 0
        while True:
            w = resample.drawn_counts(4, rep + 12 * attempt).astype(float)
            attempt += 1
            if 0 < (w * y).sum() < 4:
                break
        area, ap = areas(score, y, w)
        assert (r["attempts"], r["auc"], r["average_precision"]) == (attempt, pytest.approx(area), pytest.approx(ap))
    plain = {r["rep"]: r["auc"] for r in resample.bootstrap_metrics(df, "id", ["s"], 12).collect()}
    assert {rep for rep, a in plain.items() if a is None} == {rep for rep, r in got.items() if r["attempts"] > 1}


def test_single_class_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "MOST_ATTEMPTS", 3)
    one = spark.createDataFrame([(i, 1, float(i)) for i in range(4)], "id bigint, y int, s double")
    assert [(r["auc"], r["attempts"]) for r in resample.bootstrap_metrics(one, "id", ["s"], 2, redraw=True).collect()] == [(None, 3)] * 2
    assert [r["auc"] for r in resample.bootstrap_metrics(one.limit(0), "id", ["s"], 2).collect()] == [None, None]


@pytest.mark.parametrize("score", ["a", "b"])
def test_label_shuffles_equal_the_row_form(scored, monkeypatch, score):
    """``b`` has one value on nine rows of ten."""
    y, scores, df = scored
    known = df.filter("id < 1000")
    packed = {r["rep"]: r["auc"] for r in resample.permutation_auc(known, "id", 25, score).collect()}
    monkeypatch.setattr(resample, "ORDERED_BYTES", 0)
    rows = {r["rep"]: r["auc"] for r in resample.permutation_auc(known, "id", 25, score).collect()}
    assert packed.keys() == rows.keys() and all(packed[k] == pytest.approx(rows[k]) for k in rows)
    keys = np.arange(90) * 3
    cases = np.lexsort((keys, resample.hashes(keys, 7)))[: y.sum()]
    assert packed[7] == pytest.approx(areas(scores[score], np.isin(np.arange(90), cases).astype(int), np.ones(90))[0])


def test_probe_agreement(spark):
    rows = [("x", "g", "p1", 5.0), ("x", "g", "p2", 5.0), ("y", "g", "p1", 1.0), ("y", "g", "p2", 2.0), ("z", "g", "p1", 9.0), ("x", "h", "p3", 1.0)]
    got = {tuple(r)[:6] for r in rollup.probe_agreement(spark.createDataFrame(rows, "cohort string, gene string, probe string, value double"), "cohort").collect()}
    assert got == {("g", "x", "y", "p1", "p2", False), ("g", "x", "z", "p1", "p1", True), ("g", "y", "z", "p2", "p1", False)}


def test_neighbourhood_terms_by_hypergeometric_sums(spark):
    from math import comb

    touching = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 1.0), ("s", "unknown", 1.0), ("t", "c", 1.0)], "seed string, neighbour string, score double")
    membership = spark.createDataFrame([("T", m) for m in "abs"] + [("U", m) for m in "cdef"] + [("T", "a")], "term string, member string")
    got = {(r["seed"], r["term"]): r for r in network.neighbourhood_terms(touching, membership).collect()}
    assert set(got) == {("s", "T"), ("t", "U")}
    r = got["s", "T"]
    assert (r["neighbourhood_size"], r["set_size"], r["term_size"], r["pool_size"], r["overlap"]) == (4, 3, 3, 7, 3)
    assert r["p"] == pytest.approx(comb(3, 3) * comb(4, 0) / comb(7, 3)) and r["fdr"] == pytest.approx(r["p"]) and r["significant"]
    assert (got["t", "U"]["neighbourhood_size"], got["t", "U"]["set_size"]) == (2, 1)


def test_covariate_folds_use_training_rows_only(spark):
    rng = np.random.default_rng(2)
    age = rng.normal(60, 8, 60)
    y = (rng.random(60) < 1 / (1 + np.exp(-(age - 60) / 6))).astype(int)
    fold = np.arange(60) % 3
    s = spark.createDataFrame([(i, int(y[i]), float(age[i])) for i in range(60)], "sample_id bigint, y int, age double")
    folds = spark.createDataFrame([(i, 0, int(fold[i])) for i in range(60)], "sample_id bigint, rep int, fold int")
    got = {r["fold"]: r["auc"] for r in models.covariate_fold_auc(s, "age", folds).collect()}
    for f in range(3):
        assert got[f] == pytest.approx(areas(age[fold == f], y[fold == f], np.ones(20))[0])  # one increasing covariate keeps the order


def test_frozen_model_and_fixed_scores(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(50, 2))
    y = (v[:, 0] + rng.normal(size=50) > 0).astype(int)
    long = [(i, "train" if i < 30 else "other", int(y[i]), f"f{j}", float(v[i, j]), float(2 * v[i, j] + 1)) for i in range(50) for j in range(2)]
    df = spark.createDataFrame(long, "sample_id bigint, cohort string, y int, feature string, value double, twice double")
    out = {r["analysis"]: r for r in models.frozen_on_schemes(df.filter("cohort = 'train'"), df.filter("cohort = 'other'"), ["f0", "f1"], ["value", "twice"]).collect()}
    assert set(out) == {"model", "f0", "f1"} and all(abs(r["delta_twice"]) < 1e-12 for r in out.values())  # a rising map of all features alike keeps every order
    assert out["f0"]["auc_value"] == pytest.approx(areas(v[30:, 0], y[30:], np.ones(20))[0])
    fixed = {(r["cohort"], r["model"]): r for r in models.fixed_score_ablation(df, ["f0", "f1"]).collect()}
    z = (v[30:] - v[30:].mean(axis=0)) / v[30:].std(axis=0, ddof=1)
    area, ap = areas(z.mean(axis=1), y[30:], np.ones(20))
    assert len(fixed) == 6 and fixed["other", "f0+f1"]["auc"] == pytest.approx(area) and fixed["other", "f0+f1"]["average_precision"] == pytest.approx(ap)
    assert fixed["other", "f0"]["delta_auc"] == pytest.approx(fixed["other", "f0"]["auc"] - area)
    assert evaluate.auc(df, ["cohort", "feature"], "value").count() == 4
