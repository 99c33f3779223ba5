"""Batched penalised fits against optimality conditions, enumeration and plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import blockfit, prep, resample, selection
from cohortlab.operators.blockfit import Models

N, P = 210, 5


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(N, P)) * [1, 5, 0.1, 2, 1] + [0, 100, 3, -1, 0]
    age = 60 + 10 * rng.normal(size=N)
    x[:, 3] += 0.2 * age
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    y = (rng.random(N) < 1 / (1 + np.exp(-(0.3 + z @ [1.2, -0.8, 0.0, 0.4, 0.0])))).astype(int)
    rows = [(i * 7, int(y[i]), [float(v) for v in x[i]], float(age[i])) for i in range(N)]
    df = spark.createDataFrame(rows, "sample_id bigint, y int, x array<double>, age double").repartition(3).cache()
    return x, y, age, df, [f"f{j}" for j in range(P)]


def zscored(x, w):
    mean = (w[:, None] * x).sum(axis=0) / w.sum()
    sd = np.sqrt((w[:, None] * (x - mean) ** 2).sum(axis=0) / w.sum())
    return (x - mean) / sd


def gradient(x, y, w, b):
    d = np.column_stack([np.ones(len(x)), x])
    return d.T @ (w * (1 / (1 + np.exp(-d @ b)) - y)), d


def assert_l1_optimal(x, y, w, b, c, allowed=None):
    """The conditions that hold at the minimum of a convex objective and nowhere else."""
    g, _ = gradient(x, y, w, b)
    lam = 1 / c
    free = np.ones(len(b), bool) if allowed is None else np.concatenate([[True], allowed])
    assert np.all(b[~free] == 0)
    on = (b != 0) & free
    assert np.allclose(g[on], -lam * np.sign(b[on]), atol=1e-6)
    assert np.all(np.abs(g[~on & free]) <= lam + 1e-6)


@pytest.mark.parametrize("block_rows", [32, 1024])
def test_l1_over_penalties_and_folds(spark, study, block_rows):
    x, y, _, df, names = study
    folds = prep.stratified_folds(df.select("sample_id", "y"), 3, 2)
    number = {(r.sample_id // 7, r.rep): r.fold for r in folds.collect()}
    blocks = blockfit.pack(df, names, folds=folds, block_rows=block_rows)
    jobs = [(c, rep, fold) for c in (0.01, 0.1, 1.0, 100.0) for rep in range(2) for fold in range(3)]
    c, rep, fold = (np.array(v) for v in zip(*jobs))
    fits = blockfit.fit(blocks, Models.of(len(jobs), c=c, part=rep, held=fold))
    for m, (cm, r, f) in enumerate(jobs):
        w = np.array([float(number[i, r] != f) for i in range(N)])
        assert_l1_optimal(zscored(x, w), y, w, fits.beta[m], cm)
    assert any((b[1:] == 0).any() and (b[1:] != 0).any() for b in fits.beta)
    assert (fits.kkt <= blockfit.TOLERANCE).all()


def test_bootstrap_counts_and_scores(spark, study):
    x, y, _, df, names = study
    blocks = blockfit.pack(df, names, replicates=20, block_rows=50)
    models = Models.of(20, c=0.3, boot=np.arange(20))
    fits = blockfit.fit(blocks, models)
    weights = np.zeros((N, 20))
    for r in resample.bootstrap_weights(df.select("sample_id", "y"), "sample_id", 20).collect():
        weights[r["sample_id"] // 7, r["rep"]] = r["weight"]
    for m in range(20):
        assert_l1_optimal(zscored(x, weights[:, m]), y, weights[:, m], fits.beta[m], 0.3)
    got = {(r["model"], r["sample_id"]): r["probability"] for r in blockfit.scored(blocks, models, fits, "all").collect()}
    assert len(got) == 20 * N
    w = weights[:, 4]
    z = zscored(x, w)
    assert all(got[4, i * 7] == pytest.approx(1 / (1 + np.exp(-(fits.beta[4, 0] + z[i] @ fits.beta[4, 1:])))) for i in range(N))


def test_selection_summary_rows(spark, study):
    _, _, _, df, names = study
    coefs = selection.lasso_stability(df, names, 12)
    assert coefs.count() == 12 * P and coefs.select("rep").distinct().count() == 12
    one = df.filter("y = 1").limit(3).unionByName(df.filter("y = 0").limit(1))
    reps = {r["rep"] for r in selection.lasso_stability(one, names, 40).select("rep").distinct().collect()}
    drawn = {}
    for r in resample.bootstrap_weights(one.select("sample_id", "y"), "sample_id", 40).collect():
        drawn.setdefault(r["rep"], set()).add(r["y"])
    assert reps == {r for r, seen in drawn.items() if len(seen) == 2} and len(reps) < 40


@pytest.mark.parametrize("columns", [False, True])
def test_l2_equals_newton(spark, study, columns):
    x, y, _, df, names = study
    blocks = blockfit.pack(df, names)
    picks = np.array([[0, 1], [2, 4], [3, 0]])
    allowed = np.array([[j in p for j in range(P)] for p in picks.tolist()])
    models = Models.of(3, c=2.0, columns=picks) if columns else Models.of(3, c=2.0, allowed=allowed)
    fits = blockfit.fit(blocks, models, "l2", penalise_first=False)
    for m, pick in enumerate(picks.tolist()):
        z, b = zscored(x, np.ones(N))[:, pick], np.zeros(3)
        pen = np.diag([0, 0.5, 0.5])
        for _ in range(40):
            g, d = gradient(z, y, np.ones(N), b)
            prob = 1 / (1 + np.exp(-d @ b))
            b = b - np.linalg.solve(d.T @ (d * (prob * (1 - prob))[:, None]) + pen, g + pen @ b)
        got = fits.beta[m] if columns else fits.beta[m][[0, *[j + 1 for j in pick]]]
        assert np.allclose(got, b, atol=1e-8)


def test_more_models_than_a_batch_holds(spark, study, monkeypatch):
    _, _, _, df, names = study
    blocks = blockfit.pack(df, names)
    c = np.linspace(0.05, 3, 300)
    whole = blockfit.fit(blocks, Models.of(300, c=c)).beta
    monkeypatch.setattr(blockfit, "BATCH_BYTES", 1)
    assert np.allclose(blockfit.fit(blocks, Models.of(300, c=c)).beta, whole, atol=1e-8)


def test_missing_values_and_single_class(spark, study):
    _, _, _, df, names = study
    gaps = df.withColumn("x", F.when(F.col("sample_id") == 0, F.transform("x", lambda v, i: F.when(i == 1, F.lit(None)).otherwise(v))).otherwise(F.col("x")))
    blocks = blockfit.pack(gaps.unionByName(df.withColumn("sample_id", F.lit(-5).cast("bigint")).withColumn("y", F.lit(None).cast("int")).limit(1)), names)
    assert blocks.n == N and np.isfinite(blockfit.fit(blocks, Models.of(1, c=1.0)).beta).all()
    same = blockfit.fit(blockfit.pack(df.filter("y = 1"), names), Models.of(1, c=1.0))
    assert (same.beta == 0).all()
    constant = df.withColumn("x", F.transform("x", lambda v, i: F.when(i == 2, 4.0).otherwise(v)))
    assert blockfit.fit(blockfit.pack(constant, names), Models.of(1, c=1.0)).beta[0, 3] == 0


def test_separable_classes_end(spark):
    df = spark.createDataFrame([(i, int(i >= 10), [float(i), float(i % 3)]) for i in range(20)], "sample_id bigint, y int, x array<double>")
    blocks = blockfit.pack(df, ["a", "b"])
    fits = blockfit.fit(blocks, Models.of(1), "l2", max_passes=25)
    assert np.isfinite(fits.beta).all() and fits.beta[0, 1] > 5
    tight = blockfit.fit(blocks, Models.of(1, c=10.0))
    assert tight.kkt[0] <= blockfit.TOLERANCE


def line(v, age, keep):
    a = np.column_stack([np.ones(keep.sum()), age[keep]])
    return np.linalg.lstsq(a, v[keep], rcond=None)[0]


def test_nested_cv_by_force(spark, study):
    """Every step again in numpy: residuals on training controls, variance share, inner choice, L1 selection, refit."""
    x, y, age, df, names = study
    grid, outer, inner = [0.02, 0.3], 3, 2
    metrics, found = selection.nested_cv(df, names, grid, outer, inner, 1, share=0.5)
    sets = {}
    for r in selection.nested_folds(df, outer, inner, 1).collect():
        sets.setdefault(r["rep"], {})[r["sample_id"] // 7] = r["fold"]
    assert sorted(sets) == [0, 1, 2, 3]

    def lasso(z, yy, c):
        b = np.zeros(z.shape[1] + 1)
        d = np.column_stack([np.ones(len(z)), z])
        step = 4 / np.linalg.eigvalsh(d.T @ d)[-1]
        v, t = b, 1.0
        for _ in range(20000):  # accelerated proximal steps
            new = v - step * (d.T @ (1 / (1 + np.exp(-d @ v)) - yy))
            new = np.sign(new) * np.maximum(np.abs(new) - step / c, 0)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, b, t = new + (t - 1) / t2 * (new - b), new, t2
        return b

    def area(p, yy):
        d = p[yy == 1][:, None] - p[yy == 0]
        return np.mean(np.where(np.abs(d) < 1e-12, 0.5, d > 0))

    got = {r["fold"]: r for r in metrics.collect()}
    picked = {}
    for r in found.collect():
        picked.setdefault(r["fold"], {})[r["feature"]] = r["coefficient"]
    for f in range(outer):
        train = np.array([sets[0][i] != f for i in range(N)])
        res = np.column_stack([x[:, j] - line(x[:, j], age, train & (y == 0)) @ np.stack([np.ones(N), age]) for j in range(P)])
        var = res[train].var(axis=0, ddof=1)
        keep = np.sort(np.argsort(-var, kind="stable")[: int(np.ceil(P * 0.5))])
        scores = []
        for c in grid:
            areas = []
            for g in range(inner):
                fit_on = np.array([sets[1 + f][i] not in (g, -1) for i in range(N)])
                test = np.array([sets[1 + f][i] == g for i in range(N)])
                z = (res[:, keep] - res[fit_on][:, keep].mean(axis=0)) / res[fit_on][:, keep].std(axis=0)
                b = lasso(z[fit_on], y[fit_on], c)
                areas.append(area(b[0] + z[test] @ b[1:], y[test]))
            scores.append(np.mean(areas))
        c = grid[int(np.argmax(np.round(scores, 12)))]
        z = (res[:, keep] - res[train][:, keep].mean(axis=0)) / res[train][:, keep].std(axis=0)
        b = lasso(z[train], y[train], c)
        want = {names[k]: v for k, v in zip(keep, b[1:]) if abs(v) > 1e-8}
        assert got[f]["c"] == c and got[f]["n_selected"] == max(1, len(want))
        if want:
            assert set(picked[f]) == set(want) and all(picked[f][k] == pytest.approx(v, abs=1e-5) for k, v in want.items())
        chosen = [names.index(k) for k in want] or [int(np.argmax(var))]
        zz, bb = (res[:, chosen] - res[train][:, chosen].mean(axis=0)) / res[train][:, chosen].std(axis=0), np.zeros(len(chosen) + 1)
        for _ in range(60):
            grad, d = gradient(zz[train], y[train], np.ones(train.sum()), bb)
            prob = 1 / (1 + np.exp(-d @ bb))
            bb = bb - np.linalg.solve(d.T @ (d * (prob * (1 - prob))[:, None]), grad)
        assert got[f]["auc"] == pytest.approx(area(bb[0] + zz[~train] @ bb[1:], y[~train]))
    tuned = selection.tune_penalty(df, names, prep.stratified_folds(df.select("sample_id", "y"), 3, 2), [0.02, 1.0], 3, 2).collect()
    assert {r["c"]: r["n_folds"] for r in tuned} == {0.02: 6, 1.0: 6}


@pytest.mark.parametrize("packed", [True, False])
def test_areas_of_groups(spark, study, monkeypatch, packed):
    """Pooled held-out scores, packed by group or as rows."""
    if not packed:
        monkeypatch.setattr(blockfit, "PACKED", 1)
    x, y, _, df, names = study
    folds = prep.stratified_folds(df.select("sample_id", "y"), 4, 1)
    blocks = blockfit.pack(df, names, folds=folds, block_rows=64)
    models = Models.of(8, c=np.repeat([0.05, 1.0], 4), part=0, held=np.tile(np.arange(4), 2))
    fits = blockfit.fit(blocks, models)
    rows = blockfit.scored(blocks, models, fits).toPandas()
    got = {r["grp"]: r for r in blockfit.areas(blocks, models, fits, np.repeat([5, 6], 4)).collect()}
    assert len(rows) == 2 * N and set(got) == {5, 6}
    for g, part in ((5, rows[rows.model < 4]), (6, rows[rows.model >= 4])):
        pos, neg = part.probability[part.y == 1].to_numpy(), part.probability[part.y == 0].to_numpy()
        d = pos[:, None] - neg
        assert got[g]["auc"] == pytest.approx(np.mean((d > 0) + 0.5 * (d == 0)))
        assert got[g]["accuracy"] == pytest.approx(np.mean((part.probability >= 0.5) == part.y))
        ap = sum(np.mean(part.y[part.probability >= t]) * np.mean(part.y[part.probability == t]) * (part.probability == t).sum() for t in set(part.probability)) / len(pos)
        assert got[g]["average_precision"] == pytest.approx(ap)


def test_panels_by_force(spark, study):
    x, y, _, df, names = study
    train, other = df.filter("sample_id % 3 > 0"), df.filter("sample_id % 3 = 0")
    keep = np.array([(i * 7) % 3 > 0 for i in range(N)])
    panels = np.array([[0, 1, 2], [4, 2, 1], [3, 4, 0]])
    got = {r["panel"]: r["auc"] for r in selection.panel_transfer(train, other, names, panels).collect()}
    blocks = blockfit.pack(train, names)
    fits = blockfit.fit(blocks, Models.of(3, c=0.3, columns=panels))
    for m, pick in enumerate(panels.tolist()):
        v = x[:, pick]
        z = (v - v[keep].mean(axis=0)) / v[keep].std(axis=0)
        assert_l1_optimal(z[keep], y[keep], np.ones(keep.sum()), fits.beta[m], 0.3)
        s = fits.beta[m, 0] + z[~keep] @ fits.beta[m, 1:]
        d = s[y[~keep] == 1][:, None] - s[y[~keep] == 0]
        assert got[m] == pytest.approx(np.mean((d > 0) + 0.5 * (d == 0)))


def refitted(x, y, pick, c, penalty, i):
    """Held-out score of sample i by a fit without it: damped Newton for L2, proximal Newton steps by coordinate descent for L1."""
    keep = np.arange(len(y)) != i
    v = x[:, pick]
    z = (v - v[keep].mean(axis=0)) / v[keep].std(axis=0)
    d, yy = np.column_stack([np.ones(keep.sum()), z[keep]]), y[keep]
    b = np.zeros(d.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-d @ b))
        g, h = d.T @ (p - yy), d.T @ (d * (p * (1 - p))[:, None])
        if penalty == "l2":
            b = b - np.linalg.solve(h + np.eye(len(b)) / c, g + b / c)
            continue
        new = b.copy()
        for _ in range(2000):
            before = new.copy()
            for j in range(len(b)):
                at = new[j] - (g[j] + h[j] @ (new - b)) / h[j, j]
                new[j] = np.sign(at) * max(abs(at) - 1 / c / h[j, j], 0)
            if np.abs(new - before).max() < 1e-15:
                break
        b = new
    return b[0] + z[i] @ b[1:]


@pytest.mark.parametrize("penalty, tolerance", [("l1", 1e-2), ("l1", 0.0), ("l2", 1e-2), ("l2", 0.0)])
def test_leave_one_out_equals_refits(spark, study, monkeypatch, penalty, tolerance):
    """By moved coefficients (as far as the tolerance lets them) and by refits."""
    monkeypatch.setattr(blockfit, "LEFT_TOLERANCE", tolerance)
    x, y, _, df, names = study
    panels = np.array([[0, 1, 2], [3, 4, 2]])
    got = {r["grp"]: r for r in blockfit.leave_one_out(blockfit.pack(df, names, block_rows=64), Models.of(2, c=0.3, columns=panels), penalty).collect()}
    for m, pick in enumerate(panels.tolist()):
        s = np.array([refitted(x, y, pick, 0.3, penalty, i) for i in range(N)])
        d = s[y == 1][:, None] - s[y == 0]
        assert got[m]["auc"] == pytest.approx(np.mean((d > 1e-10) + 0.5 * (np.abs(d) <= 1e-10)), abs=1e-9 if tolerance == 0 else 2e-4)
        assert (got[m]["n1"], got[m]["n0"]) == (y.sum(), N - y.sum())


def test_moved_scores_to_nine_digits(spark, monkeypatch):
    """With enough samples the bound lets nearly all pass without a refit, and every score equals its refit."""
    rng = np.random.default_rng(5)
    n = 900
    x = rng.normal(size=(n, 3)) * [1, 3, 0.5] + [0, 10, 1]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * (x[:, 1] - 10))))).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)], "sample_id bigint, y int, x array<double>")
    blocks = blockfit.pack(df, ["a", "b", "c"], block_rows=256)
    scaled, refits = blockfit.scaled, []
    monkeypatch.setattr(blockfit, "scaled", lambda b, m, *a, **k: refits.append(len(m)) or scaled(b, m, *a, **k))
    for penalty in ("l1", "l2"):
        refits.clear()
        rows = blockfit.left_scores(blocks, Models.of(1, c=0.3, columns=np.array([[0, 1, 2]])), penalty).collect()
        got = sorted((int(label), score) for r in rows for score, label in zip(np.frombuffer(r["s"]), np.frombuffer(r["l"], np.uint8)))
        assert sum(refits[1:]) < 0.8 * n, refits
        want = sorted((int(y[i]), refitted(x, y, [0, 1, 2], 0.3, penalty, i)) for i in range(n))
        assert [label for label, _ in got] == [label for label, _ in want]
        assert np.abs(np.array([s for _, s in got]) - np.array([s for _, s in want])).max() < 1e-9


def test_shuffled_labels(spark, study):
    x, y, _, df, names = study
    blocks = blockfit.pack(df, names, shuffles=11, block_rows=64)
    models = Models.of(12, c=1.0, label=np.arange(-1, 11), columns=np.tile([[0, 1]], (12, 1)))
    fits = blockfit.fit(blocks, models, "l2")
    keys = np.arange(N) * 7
    for m, rep in ((0, -1), (1, 0), (11, 10)):
        labels = y if rep < 0 else np.isin(np.arange(N), np.lexsort((keys, resample.hashes(keys, rep)))[: y.sum()]).astype(int)
        z, b = zscored(x, np.ones(N))[:, [0, 1]], np.zeros(3)
        for _ in range(40):
            g, d = gradient(z, labels, np.ones(N), b)
            p = 1 / (1 + np.exp(-d @ b))
            b = b - np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + np.eye(3), g + b)
        assert np.allclose(fits.beta[m], b, atol=1e-8)
    assert (fits.cases == y.sum()).all()


@pytest.mark.parametrize("orders", [(2, 3), (3, 4)])
def test_moved_scores_by_lower_orders(spark, monkeypatch, orders):
    """Rows that the first order leaves too far off go on to the next, others to a refit; every score equals its refit."""
    rng = np.random.default_rng(6)
    n = 400
    x = rng.normal(size=(n, 2)) * [1, 2]
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    df = spark.createDataFrame([(i * 7, int(y[i]), [float(v) for v in x[i]]) for i in range(n)], "sample_id bigint, y int, x array<double>")
    monkeypatch.setattr(blockfit, "LEFT_ORDERS", ((0, orders),))
    monkeypatch.setattr(blockfit, "LEFT_TOLERANCE", 1e-7)
    for penalty in ("l1", "l2"):
        rows = blockfit.left_scores(blockfit.pack(df, ["a", "b"], block_rows=128), Models.of(1, c=0.3), penalty).collect()
        got = sorted((int(label), score) for r in rows for score, label in zip(np.frombuffer(r["s"]), np.frombuffer(r["l"], np.uint8)))
        want = sorted((int(y[i]), refitted(x, y, [0, 1], 0.3, penalty, i)) for i in range(n))
        assert len(got) == n and np.abs(np.array([s for _, s in got]) - np.array([s for _, s in want])).max() < 1e-7


def test_leave_one_out_scores_once_where_nothing_is_refitted(spark, monkeypatch):
    """Models without refits are judged by the first pass, the others scored again; blocks are dealt over the tasks."""
    rng = np.random.default_rng(7)
    n = 900
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)], "sample_id bigint, y int, x array<double>")
    blocks = blockfit.pack(df, ["a", "b"], shuffles=3, block_rows=64)
    models = Models.of(4, c=1.0, label=np.arange(-1, 3))
    calls, scored = [], blockfit._LeftOut.scored
    monkeypatch.setattr(blockfit._LeftOut, "scored", lambda self, chosen, which="both": calls.append((which, len(chosen))) or scored(self, chosen, which))
    monkeypatch.setattr(blockfit, "LEFT_TOLERANCE", 1e-6)
    once = {r["grp"]: r["auc"] for r in blockfit.leave_one_out(blocks, models, "l2").collect()}
    assert calls == [("both", 4)]
    monkeypatch.setattr(blockfit, "LEFT_TOLERANCE", 0.0)
    again = {r["grp"]: r["auc"] for r in blockfit.leave_one_out(blocks, models, "l2").collect()}
    assert calls[1:] == [("both", 4), ("scores", 4)] and once == pytest.approx(again, abs=1e-5)
    assert blockfit.spread(blocks, 1)[0].rdd.getNumPartitions() >= min(15, spark.sparkContext.defaultParallelism)


def test_left_out_samples_that_change_the_l1_pattern(spark, monkeypatch):
    """At penalties where leaving out one sample lets a coefficient or the intercept in, out, or over zero, no sample is refitted and every score equals its refit."""
    rng = np.random.default_rng(8)
    n, picks = 240, [0, 1]
    x = rng.normal(size=(n, 2)) * [1, 3] + [0, 5]
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x[:, 0] + 0.05 * (x[:, 1] - 5))))).astype(int)
    df = spark.createDataFrame([(i * 3, int(y[i]), [float(v) for v in x[i]]) for i in range(n)], "sample_id bigint, y int, x array<double>")
    blocks = blockfit.pack(df, ["a", "b"], block_rows=100)

    # the penalty at which the weaker coefficient is about to leave, and that at which the intercept is
    grid = np.geomspace(0.005, 50, 200)
    beta = blockfit.fit(blocks, Models.of(len(grid), c=grid, columns=np.tile([picks], (len(grid), 1)))).beta
    edges = [grid[np.flatnonzero((beta[:, k] == 0) & (np.roll(beta[:, k], -1) != 0))[-1]] for k in (0, 2)]
    c = np.repeat(edges, 2) * np.tile([1.0, grid[1] / grid[0]], 2)
    models = Models.of(len(c), c=c, columns=np.tile([picks], (len(c), 1)))

    scaled, other, refits, changed = blockfit.scaled, blockfit._LeftOut._other_pattern, [], spark.sparkContext.accumulator(0)
    monkeypatch.setattr(blockfit, "scaled", lambda b, m, *a, **k: refits.append(int((m.part == blockfit.ALONE).sum())) or scaled(b, m, *a, **k))

    def scores():
        got = {}
        for r in blockfit.left_scores(blocks, models).collect():
            got.setdefault(r["grp"], []).extend(zip(np.frombuffer(r["l"], np.uint8).tolist(), np.frombuffer(r["s"]).tolist()))
        return np.array([sorted(got[m]) for m in range(len(c))])

    monkeypatch.setattr(blockfit, "LEFT_TOLERANCE", 0.0)
    want = scores()
    assert sum(refits) == n * len(c)
    monkeypatch.setattr(blockfit, "LEFT_TOLERANCE", 1e-6)
    monkeypatch.setattr(blockfit._LeftOut, "_other_pattern", lambda self, beta, *a: changed.add(len(beta)) or other(self, beta, *a))
    refits.clear()
    got = scores()
    assert sum(refits) == 0 and changed.value > n / 4
    assert got.shape == (len(c), n, 2) and (got[:, :, 0] == want[:, :, 0]).all() and np.abs(got[:, :, 1] - want[:, :, 1]).max() < 1e-6
    # one of them by plain numpy
    plain = sorted((int(y[i]), refitted(x, y, picks, c[1], "l1", i)) for i in range(n))
    assert np.abs(got[1] - np.array(plain)).max() < 1e-6
