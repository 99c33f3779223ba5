"""Published result values, on the published per-sample inputs stated as literals."""

import pytest
from pyspark.sql import functions as F

from cohortlab.functions.scalars import effect_band
from cohortlab.operators import audit, evaluate, glm, twogroup

# fixed values: predicted probabilities of 13 controls and 10 cases in the transfer cohort
CONTROL = [0.0019886346961236066, 0.0018650863665536585, 0.0020571428356379404, 0.002125015789577418, 0.006757567252286325, 0.0029593291750801202,
           0.003089111559189821, 0.0020610163660210947, 0.002400237425549706, 0.0027692374096187746, 0.0027357691679323897, 0.0020344278773765387,
           0.0025669032069677547]
CASE = [0.0020177133101690514, 0.0025248336958539194, 0.002051207047248723, 0.0022694484980849694, 0.0028577966479082294, 0.003243497032561065,
        0.003386885996583944, 0.0032446986004808455, 0.0029072769995291867, 0.00572719344790093]


@pytest.fixture(scope="module")
def transfer(spark):
    rows = [(i, 0, p) for i, p in enumerate(CONTROL)] + [(100 + i, 1, p) for i, p in enumerate(CASE)]
    return spark.createDataFrame(rows, "id int, y int, probability double").withColumn("cohort", F.lit("transfer")).cache()


def test_transfer_discrimination(transfer):
    assert evaluate.auc(transfer, [], "probability").first()["auc"] == pytest.approx(0.6615384615384615, abs=1e-10)
    assert evaluate.average_precision(transfer, [], "probability").first()["average_precision"] == pytest.approx(0.603000, abs=5e-7)
    assert evaluate.probability_metrics(transfer, []).first()["brier"] == pytest.approx(0.432163, abs=5e-7)


def test_transfer_at_locked_threshold(transfer):
    c = evaluate.confusion(transfer, [], 0.329699, "probability").first()
    assert (c.tp, c.fp, c.fn, c.tn) == (0, 0, 10, 13)
    assert c.sensitivity == 0.0 and c.specificity == 1.0 and c.ppv is None


def test_transfer_calibration(transfer):
    c = glm.calibration(transfer, "cohort").first()
    assert c.slope == pytest.approx(1.2606, abs=2e-3)
    assert c.intercept == pytest.approx(7.1902, abs=2e-2)


def test_permutation_splits_with_tolerance(spark):
    # fixed values: published means of one gene in one cell type, 3 against 3 libraries
    rows = [("OPC", 1, 0.0625), ("OPC", 1, 0.017543859649122806), ("OPC", 1, 0.06666666666666667),
            ("one_hit", 1, 0.0), ("one_hit", 1, 0.0), ("one_hit", 1, 0.2), ("one_hit", 0, 0.0), ("one_hit", 0, 0.0), ("one_hit", 0, 0.0)]
    rows += [("OPC", 0, v) for v in (0.09090909090909091, 0.03278688524590164, 0.0625)]
    got = {r.t: r for r in twogroup.exact_permutation(spark.createDataFrame(rows, "t string, y int, value double"), ["t"]).collect()}
    assert got["one_hit"].n_splits == 20 and got["one_hit"].p_exact == pytest.approx(1.0)
    # the mirrored split ties: plain floating comparison would give 0.6
    assert got["OPC"].p_exact == pytest.approx(0.7)


def test_five_unmixed_days_lose_a_rank(spark):
    # 23 samples over five days, no day with both classes
    sizes = [(1, 0, 5), (2, 0, 8), (3, 1, 3), (4, 1, 4), (5, 1, 3)]
    rows = [(d, y) for d, y, n in sizes for _ in range(n)]
    s = spark.createDataFrame(rows, "day int, y int")
    n = audit.nesting(s, "day").first()
    assert (n.n_batches, n.n_mixed, n.nested) == (5, 0, True)
    block = s.withColumn("block", F.col("y"))
    r = audit.design_rank(block, "block").first()
    assert (r.n_samples, r.n_columns, r["rank"], r.identifiable, r.outcome_equals_batch) == (23, 3, 2, False, True)


def test_sixteen_days_nine_mixed_keep_full_rank(spark):
    rows = [(d, y) for d in range(9) for y in (0, 1, 0)] + [(9 + d, d % 2) for d in range(7) for _ in range(5)]
    r = audit.design_rank(spark.createDataFrame(rows, "day int, y int"), "day").first()
    assert (r.n_samples, r.n_columns, r["rank"], r.identifiable) == (62, 17, 17, True)


def test_counted_rank_equals_matrix_rank(spark):
    rows = [(b, y) for b in range(4) for y in ((0, 1) if b == 0 else (b % 2,)) for _ in range(3)]
    s = spark.createDataFrame(rows, "b int, y int")
    cols = {"y": F.col("y"), **{f"b{i}": F.col("b") == i for i in range(1, 4)}}
    assert audit.gram_rank(s, cols).first()["rank"] == audit.design_rank(s, "b").first()["rank"] == 5
    nested = s.filter("b > 0 OR y = 0")
    assert audit.gram_rank(nested, cols).first()["rank"] == audit.design_rank(nested, "b").first()["rank"] == 4


def test_location_shift_in_training_sds(spark):
    # published training mean and sd, other cohort's mean, and coefficient of one feature
    train, other, sd, coef = 5.331628120189632, 2.5949118166646725, 0.9789144551661697, 0.475
    step = sd / 2**0.5
    rows = [("f", "train", train - step), ("f", "train", train + step), ("f", "new", other)]
    m = spark.createDataFrame(rows, "feature string, cohort string, value double")
    s = audit.location_shift(m, "cohort", "train", spark.createDataFrame([("f", coef)], "feature string, coefficient double")).first()
    assert s.shift_sd == pytest.approx(-2.7956644107992097, rel=1e-9)
    assert s.logit_shift == pytest.approx(-1.3279405951296246, rel=1e-9)


def test_effect_bands(spark):
    df = spark.createDataFrame([(0.1,), (-0.3,), (0.6,), (-1.2,), (None,)], "d double")
    assert [r[0] for r in df.select(effect_band("d")).collect()] == ["Negligible", "Small", "Moderate", "Large", "Not estimable"]
