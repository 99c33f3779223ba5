import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import audit, glm, models, rollup


@pytest.fixture(scope="module")
def vectors(spark):
    """60 random samples, 20 near copies of one of them and 15 identical copies of another."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 20))
    near = base[0] + rng.normal(size=(20, 20)) * 0.01
    same = np.repeat(base[1:2], 15, axis=0)
    x = np.vstack([base, near, same])
    rows = [(i, f"f{j:02d}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return x, spark.createDataFrame(rows, "sample_id bigint, feature string, value double").cache()


def test_exact_duplicates_report_first_id(vectors):
    _, m = vectors
    got = audit.exact_duplicates(m).collect()
    assert len(got) == 16 and {r.first_id for r in got} == {1} and {r.copies for r in got} == {16}


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_near_duplicates_match_all_pairs(vectors, block_rows):
    x, m = vectors
    got = {r.sample_id: r for r in audit.near_duplicates(audit.sample_vectors(m), 0.999, block_rows=block_rows).collect()}
    keep = list(range(80))
    c = np.corrcoef(x[keep])
    np.fill_diagonal(c, -1)
    want = {i: int((c[i] > 0.999).sum()) for i in keep if (c[i] > 0.999).any()}
    assert {k: r.n_near for k, r in got.items()} == want
    assert all(r.rho == pytest.approx(c[k].max()) for k, r in got.items())


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_nearest_neighbour_matches_all_pairs(vectors, block_rows):
    x, m = vectors
    c = np.corrcoef(x)
    np.fill_diagonal(c, -2)
    want = np.round(c, 12).argmax(axis=1)
    got = {r.sample_id: r.nearest for r in audit.nearest_neighbour(audit.sample_vectors(m), block_rows=block_rows).collect()}
    assert got == {i: int(j) for i, j in enumerate(want)}


def test_correlation_outliers_without_pairs(vectors):
    x, m = vectors
    c = np.corrcoef(x)
    want = (c.sum(axis=1) - 1) / (len(x) - 1)
    got = {r.sample_id: r.mean_rho for r in audit.correlation_outliers(audit.sample_vectors(m)).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want)


def test_subject_in_both_blocks_with_conflict(spark):
    rows = [(1, "15", "hc", "ctrl", 0), (2, "15", "hc", "case", 1), (3, "15", "ec", "ctrl", 0), (4, "7", "hc", "ctrl", 0), (5, "8", "hc", "case", 1), (6, "8", "hc", "ctrl", 1)]
    s = spark.createDataFrame(rows, "sample_id int, subject string, region string, block string, y int")
    got = {(r.subject, r.region): r.conflict for r in audit.blocks_of_subject(s, "subject", "block", ("ctrl", "case"), "region").collect()}
    assert got == {("15", "hc"): True, ("8", "hc"): False}


def _newton(x, y, l2=0.0):
    b = np.zeros(x.shape[1])
    pen = np.diag([0.0] + [l2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (p * (1 - p))[:, None]) + pen
        b = b + np.linalg.solve(h, x.T @ (y - p) - pen @ b)
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 3))
    y = (rng.random(240) < 1 / (1 + np.exp(-(0.4 + x @ [1.0, -0.7, 0.0])))).astype(int)
    rows = [(i, ["a", "a", "b"][i % 3], int(y[i]), *map(float, x[i])) for i in range(240)]
    return x, y, spark.createDataFrame(rows, "sample_id bigint, g string, y int, a double, b double, c double").cache()


@pytest.mark.parametrize("l2", [0.0, 1.0])
def test_batched_fits_equal_single_fits(labelled, l2):
    x, y, df = labelled
    fits = {r.model: r for r in glm.fit_logistic(glm.design(df, ["a", "b", "c"], "g"), 4, l2=l2).collect()}
    for name, pick in (("a", [i for i in range(240) if i % 3 != 2]), ("b", [i for i in range(240) if i % 3 == 2])):
        beta, se = _newton(np.column_stack([np.ones(len(pick)), x[pick]]), y[pick], l2)
        assert np.allclose(fits[name].beta, beta, atol=1e-8) and np.allclose(fits[name].se, se, atol=1e-6)
        assert fits[name].converged


def test_separable_fit_says_so(spark):
    df = spark.createDataFrame([(0, -1.0), (0, -2.0), (1, 1.0), (1, 2.0)], "y int, v double")
    assert not glm.fit_logistic(glm.design(df, ["v"], F.lit("m")), 2, max_iter=6).first()["converged"]


def test_ridge_fit_agrees_with_mllib(labelled):
    x, y, df = labelled
    rows = df.select("y", F.array("a", "b", "c").alias("x"))
    ours = glm.fit_logistic(glm.design(df, ["a", "b", "c"], F.lit("m")), 4, l2=1.0).first()["beta"]
    theirs = models.fit_lr(rows, False, 1.0)
    assert np.allclose(ours[1:], theirs.coefficients.toArray(), atol=1e-4)
    assert ours[0] == pytest.approx(theirs.intercept, abs=1e-4)


def test_shapley_adds_up_to_prediction_gap(labelled):
    _, _, df = labelled
    rows = df.select("sample_id", "y", F.array("a", "b", "c").alias("x"))
    model = models.fit_lr(rows, False, 1.0)
    phi = models.shapley(model, rows, ["a", "b", "c"], ["sample_id"]).groupBy("sample_id").agg(F.sum("phi").alias("s"))
    pred = models.predict(model, rows, ["sample_id"])
    gap = phi.join(pred, "sample_id").agg(F.max(F.col("probability") - F.col("s")), F.min(F.col("probability") - F.col("s"))).first()
    assert gap[0] == pytest.approx(gap[1], abs=1e-9)


def test_sampled_attributions_of_many_features_add_up(spark):
    rng = np.random.default_rng(3)
    data = [(i, int(v[0] + v[1] > 0), [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(60, 14)))]
    rows = spark.createDataFrame(data, "sample_id bigint, y int, x array<double>")
    names = [f"f{i:02d}" for i in range(14)]
    model = models.fit_lr(rows, False, 1.0)
    phi = models.shapley(model, rows, names, ["sample_id"], draws=3)
    got = phi.groupBy("sample_id").agg(F.sum("phi").alias("s"), F.count("*").alias("n")).join(models.predict(model, rows, ["sample_id"]), "sample_id")
    low, high, n = got.agg(F.min(F.col("probability") - F.col("s")), F.max(F.col("probability") - F.col("s")), F.min("n")).first()
    assert low == pytest.approx(high, abs=1e-9) and n == 14
    best = [r["feature"] for r in models.attribution_ranking(phi).orderBy(F.desc("mean_abs_phi")).limit(2).collect()]
    assert set(best) == {"f00", "f01"}


def test_leave_one_out_panels(labelled):
    x, y, df = labelled
    few = df.filter("sample_id < 24")
    z = few.unpivot(["sample_id", "y"], ["a", "b", "c"], "feature", "z")
    folds = few.select("sample_id", F.col("sample_id").cast("int").alias("fold"))
    panels = models.random_panels(z, 2, 2)
    got = {r.panel: r.auc for r in models.panel_within(z, folds, panels, 2).collect()}
    names = {(r.panel, r.slot): "abc".index(r.feature) for r in panels.collect()}
    for panel in got:
        cols = [names[panel, 0], names[panel, 1]]
        full = np.column_stack([np.ones(24), x[:24][:, cols]])
        held = []
        for i in range(24):
            keep = [j for j in range(24) if j != i]
            b, _ = _newton(full[keep], y[:24][keep], 1.0)
            held.append(full[i] @ b)
        pos = [h for h, v in zip(held, y[:24]) if v]
        neg = [h for h, v in zip(held, y[:24]) if not v]
        assert got[panel] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]))


@pytest.mark.parametrize("n, p, k, bytes_", [(6, 50, 2, 1 << 28), (40, 20_000, 5, 1 << 28), (300, 64, 5, 1 << 28), (200, 120, 3, 60_000), (5, 3, 5, 1 << 28)])
def test_components_match_a_singular_value_decomposition(spark, monkeypatch, n, p, k, bytes_):
    """Wide, long and restarted: shares of variance and scores up to sign against numpy."""
    monkeypatch.setattr(models, "PCA_BYTES", bytes_)
    rng = np.random.default_rng(n)
    z = rng.normal(size=(n, 4)) @ rng.normal(size=(4, p)) * 0.5 + rng.normal(size=(n, p)) + 3
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(z)] + [(1000, None)], "sample_id bigint, x array<double>").repartition(3)
    scores, share = models.pca_scores(rows, ["sample_id"], k)
    got = scores.toPandas()
    c = z - z.mean(axis=0)
    u, s, v = np.linalg.svd(c, full_matrices=False)
    k = min(k, n, p)
    found = min(k, int((s > 1e-9 * s[0]).sum()))
    assert len(share) == k and np.allclose(share[:found], (s**2 / (s**2).sum())[:found], atol=1e-8)
    for j in range(found):
        one = got[got.pc == f"PC{j + 1}"].sort_values("sample_id").score.to_numpy()
        assert len(one) == n and np.allclose(np.abs(one), np.abs(u[:, j] * s[j]), atol=1e-5 * s[0])


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "sample_id bigint, x array<double>")
    scores, share = models.pca_scores(none, ["sample_id"], 2)
    assert scores.count() == 0 and share == []


def test_selection_summary_and_ladder(spark):
    rows = [(r, "f", c) for r, c in enumerate([0.5, 0.2, -0.1, 0.0])] + [(0, "g", 0.3)]
    s = rollup.selection_summary(spark.createDataFrame(rows, "rep int, feature string, coefficient double"), 4)
    f = s.filter("feature = 'f'").first()
    assert (f.n_selected, f.frequency, f.sign_consistency) == (3, 0.75, pytest.approx(2 / 3))
    ladder = {r.threshold: r.n_features for r in rollup.threshold_ladder(s, [0.2, 0.5, 0.8]).collect()}
    assert ladder == {0.2: 2, 0.5: 1, 0.8: 0}


def test_missing_cells_keep_their_place(spark):
    from cohortlab.operators import audit, models

    long = spark.createDataFrame([("a", "f1", 1.0), ("a", "f3", 3.0), ("b", "f1", 1.0), ("b", "f2", 2.0), ("b", "f3", 3.0), ("c", "f2", None), ("c", "f1", 5.0)], "sample_id string, feature string, z double")
    assert {r.sample_id: r.x for r in models.feature_arrays(long, ["sample_id"]).collect()} == {"a": [1.0, 0.0, 3.0], "b": [1.0, 2.0, 3.0], "c": [5.0, 0.0, 0.0]}
    vectors = audit.sample_vectors(long, value="z")
    got = {r.sample_id: r.raw for r in vectors.collect()}
    assert got == {"a": [1.0, None, 3.0], "b": [1.0, 2.0, 3.0], "c": [5.0, None, None]}
    assert audit.nearest_neighbour(vectors).count() == 3
    assert all(r.mean_rho is not None for r in audit.correlation_outliers(vectors).collect())


def test_metric_index_prunes_long_vectors_with_a_common_profile(spark):
    """5000 features, all samples alike in their profile, thirty groups: exact results from a small part of all pairs."""
    rng = np.random.default_rng(12)
    profile = rng.normal(8, 2, 5000)
    centres = profile + rng.normal(0, 1.0, (30, 5000))
    x = centres[rng.integers(0, 30, 900)] + rng.normal(0, 0.05, (900, 5000))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    v = spark.createDataFrame(rows, "sample_id bigint, raw array<double>").withColumn("vec", audit._unit_values("raw")).cache()
    c = np.corrcoef(x)
    np.fill_diagonal(c, -2)
    assert c[c > -2].min() > 0.5
    got = audit.near_duplicates(v, 0.99, block_rows=40).collect()
    assert {r.sample_id: r.n_near for r in got} == {i: int((c[i] > 0.99).sum()) for i in range(900) if (c[i] > 0.99).any()}
    assert all(r.rho == pytest.approx(c[r.sample_id].max()) for r in got)
    assert sum(r.compared for r in got) < 0.12 * 900 * 899
    near = audit.nearest_neighbour(v, block_rows=40).collect()
    assert {r.sample_id: r.nearest for r in near} == {i: int(j) for i, j in enumerate(np.round(c, 12).argmax(axis=1))}
    assert sum(r.compared for r in near) < 0.2 * 900 * 899


def test_constant_vectors_and_single_samples(spark):
    """A constant vector correlates with nothing (0); ties go to the smaller id."""
    data = [(1, [1.0, 1.0, 1.0]), (2, [1.0, 2.0, 3.0]), (3, [3.0, 2.0, 1.0]), (4, [2.0, 2.0, 2.0])]
    v = spark.createDataFrame(data, "sample_id bigint, raw array<double>").withColumn("vec", audit._unit_values("raw"))
    got = {r.sample_id: (r.nearest, round(r.rho, 9)) for r in audit.nearest_neighbour(v, block_rows=2).collect()}
    assert got == {1: (2, 0.0), 2: (1, 0.0), 3: (1, 0.0), 4: (1, 0.0)}
    assert audit.nearest_neighbour(v.limit(1)).count() == 0 and audit.near_duplicates(v.limit(0)).count() == 0


def test_visits_in_bounded_slices(spark, monkeypatch):
    """Cells that can hold a vector within reach, whatever the number of distances a worker holds at once."""
    rng = np.random.default_rng(9)
    x, pivots = rng.normal(size=(50, 4)), rng.normal(size=(12, 4))
    df = spark.createDataFrame([(i, 0.1 * (i % 5), [float(v) for v in x[i]]) for i in range(50)], "id bigint, reach double, vec array<double>").coalesce(1)
    held, distances = spark.sparkContext.accumulator(0), audit._distances
    monkeypatch.setattr(audit, "VISIT_CELLS", 36)
    monkeypatch.setattr(audit, "_distances", lambda a, b: held.add(len(a) > 3) or distances(a, b))
    got = {r.id: r for r in audit._visits(df, pivots).collect()}
    d = distances(x, pivots)
    for i in range(50):
        near = d[i].min()
        assert got[i].home == d[i].argmin() and got[i].dist == pytest.approx(near)
        assert {v.cell: round(v.dist, 9) for v in got[i].visits} == {int(c): round(float(d[i, c]), 9) for c in np.flatnonzero(d[i] <= near + 0.2 * (i % 5) + 1e-6)}
    assert len(got) == 50 and held.value == 0


def stored(spark):
    """Bytes in the shared folder."""
    from pathlib import Path

    from cohortlab.session import shared_dir

    return sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if p.is_file())


def without_structure(spark, n, dim=8):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(n, dim))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id bigint, raw array<double>")
    c = np.corrcoef(x)
    np.fill_diagonal(c, -2)
    return df.withColumn("vec", audit._unit_values("raw")).coalesce(2).cache(), c


def test_near_duplicates_write_no_pairs(spark, monkeypatch):
    """Where nearly every block is in reach, what is written stays a few times the vectors, over many chunks as well."""
    v, c = without_structure(spark, 1500)
    monkeypatch.setattr(audit, "CHUNK_BYTES", 8 * 8 * 400, raising=False)
    before = stored(spark)
    got = {r.sample_id: r for r in audit.near_duplicates(v, 0.3, block_rows=20).collect()}
    assert stored(spark) - before < 10 * 1500 * 8 * 8
    assert {i: r.n_near for i, r in got.items()} == {i: int((c[i] > 0.3).sum()) for i in range(1500) if (c[i] > 0.3).any()}
    assert {i: r.nearest for i, r in got.items()} == {i: int(np.round(c[i], 12).argmax()) for i in got}


def test_nearest_neighbour_writes_no_pairs(spark, monkeypatch):
    """Vectors without structure, copies among them and large ids: exact over many chunks, and little is written."""
    v, c = without_structure(spark, 1500)
    twice = v.unionByName(v.filter("sample_id < 300").withColumn("sample_id", F.col("sample_id") + 1500)).withColumn("sample_id", F.col("sample_id") + (1 << 60))
    monkeypatch.setattr(audit, "CHUNK_BYTES", 8 * 8 * 400, raising=False)
    before = stored(spark)
    got = {r.sample_id - (1 << 60): (r.nearest - (1 << 60), r.rho) for r in audit.nearest_neighbour(twice, block_rows=20).collect()}
    assert stored(spark) - before < 10 * 1800 * 8 * 8
    assert {i: got[i][0] for i in range(300)} == {i: i + 1500 for i in range(300)} and {i: got[i][0] for i in range(1500, 1800)} == {i: i - 1500 for i in range(1500, 1800)}
    assert {i: got[i][0] for i in range(300, 1500)} == {i: int(np.round(c[i], 12).argmax()) for i in range(300, 1500)}
    assert len(got) == 1800 and all(got[i][1] == pytest.approx(c[i].max()) for i in range(300, 1500))


def test_pairs_of_text_ids(spark):
    v, c = without_structure(spark, 60)
    named = v.select(F.concat(F.lit("é"), F.lpad(F.col("sample_id").cast("string"), 3, "0")).alias("sample_id"), "raw", "vec").unionByName(v.limit(1).select(F.lit(None).cast("string").alias("sample_id"), F.array(F.lit(0.0)).alias("raw"), "vec"))
    want = {f"é{i:03d}": f"é{int(np.round(c[i], 12).argmax()):03d}" for i in range(60)}
    assert {r.sample_id: r.nearest for r in audit.nearest_neighbour(named, block_rows=7).collect()} == want
    assert {r.sample_id: r.nearest for r in audit.near_duplicates(named, -0.9, block_rows=7).collect()} == want
