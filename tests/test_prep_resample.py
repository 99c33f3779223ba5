import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import evaluate, prep, resample


@pytest.fixture(scope="module")
def cohorts(spark):
    rng = np.random.default_rng(8)
    rows = []
    for cohort, n, shift in (("train", 40, 0.0), ("transfer", 25, 3.0)):
        for i in range(n):
            for j in range(6):
                rows.append((f"{cohort}{i:02d}", cohort, int(i % 3 == 0), 50.0 + i, f"b{i % 3}", f"f{j}", float(rng.normal(shift, 1 + j))))
    pdf = pd.DataFrame(rows, columns=["sample_id", "cohort", "y", "age", "batch", "feature", "value"])
    df = spark.createDataFrame(pdf).cache()
    return pdf, df.filter("cohort = 'train'"), df.filter("cohort = 'transfer'"), df


def test_quantile_map_is_monotone_and_lands_in_reference(cohorts, spread):
    pdf, train, transfer, _ = cohorts
    got = prep.quantile_map(transfer, train).toPandas()
    for f, part in got.groupby("feature"):
        part = part.sort_values("value")
        ref = np.sort(pdf[(pdf.cohort == "train") & (pdf.feature == f)].value)
        assert (part.mapped.diff().dropna() >= 0).all()
        at = np.clip((np.arange(25) + 0.5) / 25 * 40 - 0.5, 0, 39)
        assert np.allclose(part.mapped, np.interp(at, np.arange(40), ref))


def test_variance_rules(cohorts):
    pdf, train, _, _ = cohorts
    var = pdf[pdf.cohort == "train"].groupby("feature").value.var().sort_values(ascending=False)
    kept = {r.feature for r in prep.fit_variance_filter(train, "share", 0.25).collect()}
    assert kept == set(var.index[:2])
    assert {r.feature for r in prep.fit_variance_filter(train, "count", 3).collect()} == set(var.index[:3])
    with pytest.raises(ValueError):
        prep.fit_variance_filter(train, "other")


def test_scaler_learns_only_from_training(cohorts):
    _, train, transfer, _ = cohorts
    scaler = prep.fit_scaler(train)
    z = prep.apply_scaler(train, scaler).groupBy("feature").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in z)
    assert prep.apply_scaler(transfer, scaler).agg(F.avg("z")).first()[0] > 0.5


def test_zero_sd_gives_null(spark):
    df = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 1.0)], "sample_id string, feature string, value double")
    assert prep.apply_scaler(df, prep.fit_scaler(df)).filter("z IS NOT NULL").count() == 0


def test_batch_adjustment_refuses_confounded_outcome(spark, cohorts):
    _, _, _, df = cohorts
    sample = df.select("sample_id", "batch", "cohort").distinct()
    measure = df.select("sample_id", "feature", "value")
    with pytest.raises(ValueError):
        prep.adjust_batches(measure, sample.withColumn("y", F.col("batch") == "b0"), "batch", "y")
    shifted = measure.join(sample, "sample_id").withColumn("value", F.col("value") + F.when(F.col("batch") == "b1", 8.0).otherwise(0.0)).select("sample_id", "feature", "value")
    out = prep.adjust_batches(shifted, sample, "batch").groupBy("batch").agg(F.avg("adjusted").alias("m")).toPandas()
    assert out.m.max() - out.m.min() < 1.0


def test_splits_are_stratified_and_complete(cohorts):
    _, _, _, df = cohorts
    sample = df.select("sample_id", "y").distinct().withColumn("n", F.xxhash64("sample_id") % 100000).withColumn("n", F.abs("n"))
    split = prep.stratified_split(sample, 0.25, key="n").groupBy("y", "part").count().toPandas()
    sizes = sample.groupBy("y").count().toPandas().set_index("y")["count"]
    for y, n in sizes.items():
        assert split[(split.y == y) & (split.part == "test")]["count"].iloc[0] == int(np.ceil(n * 0.25))
    folds = prep.stratified_folds(sample, 5, 2, key="n").groupBy("rep", "y", "fold").count().toPandas()
    assert (folds.groupby(["rep", "y"])["count"].agg(lambda c: c.max() - c.min()) <= 1).all()


def test_restrict_controls(spark):
    s = spark.createDataFrame([(1, 60.0), (1, 70.0), (0, 50.0), (0, 60.0), (0, 80.0)], "y int, age double")
    assert sorted(r.age for r in prep.restrict_controls(s).filter("y = 0").collect()) == [60.0, 80.0]


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(200) < 0.4).astype(int)
    rows = [(i, int(v), float(round(rng.normal() + 0.7 * v, 1)), float(rng.normal() + 0.2 * v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "id bigint, y int, score double, other double").cache()


def test_draws_total_n_and_are_replayable(scores, spread):
    w = resample.bootstrap_weights(scores, "id", 20).groupBy("rep").agg(F.sum("weight").alias("n")).collect()
    assert {r.n for r in w} == {200} and len(w) == 20
    again = resample.bootstrap_weights(scores, "id", 3).select("rep", "id", "weight")
    assert again.exceptAll(resample.bootstrap_weights(scores, "id", 3).select("rep", "id", "weight")).count() == 0


def test_draws_have_unit_mean_and_poisson_like_spread(scores):
    for method in ("draws", "poisson"):
        w = resample.bootstrap_weights(scores, "id", 50, method=method)
        zero = 1 - w.count() / (200 * 50)
        assert w.agg(F.sum("weight")).first()[0] / (200 * 50) == pytest.approx(1.0, abs=0.03)
        assert zero == pytest.approx(np.exp(-1), abs=0.02)


def test_bootstrap_centre_and_paired_delta(scores):
    a = resample.bootstrap_auc(scores, "id", ["score", "other"], 60)
    full = evaluate.auc(scores, []).first()["auc"]
    mean = a.filter("model = 'score'").agg(F.avg("auc")).first()[0]
    assert mean == pytest.approx(full, abs=0.02)
    assert resample.winner_share(a).agg(F.sum("wins")).first()[0] == 60
    ci = resample.interval(resample.paired_delta(a, "score", "other"), [], "delta", 0.0).first()
    assert ci.low < ci.mean < ci.high


def test_permutation_null_is_centred(scores, spread):
    null = resample.permutation_auc(scores, "id", 150)
    p = resample.permutation_p(null, evaluate.auc(scores, [])).first()
    assert p.null_mean == pytest.approx(0.5, abs=0.02)
    assert 1 / 151 <= p.p <= 0.1


def test_poisson_blocks_equal_weighted_rows(spark, monkeypatch):
    """Blocks that end inside ties, null keys and scores, labels beyond the classes: as from rows exploded by replicate."""
    from cohortlab.operators.twogroup import rank_sums

    monkeypatch.setattr(resample, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(3)
    rows = [(None if i % 40 == 0 else i // 2, None if i % 31 == 0 else int(rng.integers(0, 3)), None if i % 17 == 0 else float(round(rng.normal(), 1))) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, y int, score double")
    got = {r["rep"]: r["auc"] for r in resample.bootstrap_auc(df, "id", ["score"], 6, method="poisson").collect()}
    w = resample.bootstrap_weights(df, "id", 6, method="poisson")
    want = {r["rep"]: r["u1"] / (r["n1"] * r["n0"]) for r in rank_sums(w, ["rep"], "score", "y", weight="weight").collect()}
    assert got == pytest.approx(want, abs=1e-12)
    keys = np.array([0, 1, 2147483646, 2147483647, -3, 10**15])
    assert all((resample.Hasher(keys)(rep) == resample.hashes(keys, rep)).all() for rep in (0, 9999))


def test_effect_sums_equal_exploded_rows(spark, monkeypatch):
    rows = [(i, i % 7 % 3, None if i % 11 == 0 else float(i * 37 % 101)) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, y int, value double")
    got = {r["rep"]: r["d"] for r in resample.bootstrap_effect(df, "id", 8).collect()}
    monkeypatch.setattr(resample, "ORDERED_BYTES", 0)
    assert got == pytest.approx({r["rep"]: r["d"] for r in resample.bootstrap_effect(df, "id", 8).collect()}, abs=1e-10) and len(got) == 8
