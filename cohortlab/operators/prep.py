"""Leak-free preprocessing: ``fit_*`` learns a small table on training rows, ``apply_*`` joins it anywhere.

Fitted tables have one row per feature (or per feature and batch). They are
computed once and broadcast only when counted small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.functions.hashing import phash
from cohortlab.functions.scalars import expit
from cohortlab.operators.running import looked_up, quantiles, row_numbers
from cohortlab.session import settle, small


# ---- variance filter -----------------------------------------------------

def feature_variance(train: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    return train.groupBy(feature).agg(F.var_samp(value).alias("variance"))


def fit_variance_filter(train: DataFrame, rule: str = "share", amount: float = 0.25, feature: str = "feature", value: str = "value") -> DataFrame:
    """Features kept by training variance.

    ``share``: the top ceil(amount * p); ``count``: the top ``amount``;
    ``quantile``: at least that quantile; ``positive``: above zero.
    """
    var = settle(feature_variance(train, feature, value))
    if rule == "positive":
        return var.filter(F.col("variance") > 0)
    if rule == "quantile":
        cutoff = quantiles(var, [], "variance", {"q": amount})
        return var.withColumn("_q", cutoff.scalar()).filter(F.col("variance") >= F.col("_q")).drop("_q")
    known = var.filter(F.col("variance").isNotNull())
    order = known.withColumn("_o", F.struct(-F.col("variance"), F.col(feature)))
    placed = row_numbers(order, [], "_o", "_pos")
    if rule == "share":
        keep = F.ceil(placed.agg(F.count(F.lit(1)) * F.lit(amount)).scalar())
        placed = placed.withColumn("_keep", keep)
    elif rule == "count":
        placed = placed.withColumn("_keep", F.lit(int(amount)))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return placed.filter(F.col("_pos") < F.col("_keep")).select(feature, "variance")


# ---- scaling and scores --------------------------------------------------

def fit_scaler(train: DataFrame, ddof: int = 1, feature: str = "feature", value: str = "value") -> DataFrame:
    """Training mean and sd per feature; a zero sd is null."""
    sd = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    return settle(train.groupBy(feature).agg(F.avg(value).alias("mean"), F.nullif(sd, F.lit(0.0)).alias("sd")))


def apply_scaler(df: DataFrame, scaler: DataFrame, feature: str = "feature", value: str = "value", out: str = "z") -> DataFrame:
    return df.join(scaler.select(feature, "mean", "sd"), feature).withColumn(out, (F.col(value) - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def cohort_zscore(df: DataFrame, cohort: str, feature: str = "feature", value: str = "value", out: str = "z") -> DataFrame:
    """Z within each cohort by that cohort's own mean and sd. Uses the cohort it is applied to: a comparison, not a transfer."""
    own = settle(df.groupBy(cohort, feature).agg(F.avg(value).alias("mean"), F.nullif(F.stddev_samp(value), F.lit(0.0)).alias("sd")))
    return df.join(own, [cohort, feature]).withColumn(out, (F.col(value) - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def mean_score(df: DataFrame, sets: DataFrame, keys: Sequence[str] = ("sample_id",), z: str = "z", feature: str = "feature") -> DataFrame:
    """Mean z per (set, sample) over the features present; ``sets`` is (set_name, feature)."""
    return df.join(small(sets), feature).groupBy("set_name", *keys).agg(F.avg(z).alias("score"), F.count(z).alias("n_features"))


def linear_score(df: DataFrame, coefficients: DataFrame, intercept: float = 0.0, keys: Sequence[str] = ("sample_id",), z: str = "z", feature: str = "feature") -> DataFrame:
    """Sum of coefficient times z plus intercept, and its logistic probability."""
    total = F.sum(F.col("coefficient") * F.col(z)) + F.lit(float(intercept))
    scored = df.join(small(coefficients.select(feature, "coefficient")), feature).groupBy(*keys).agg(total.alias("score"))
    return scored.withColumn("probability", expit("score"))


def recover_intercept(predictions: DataFrame, score: str = "score", probability: str = "probability") -> DataFrame:
    """Mean of logit(p) minus the score without intercept, with the spread as a check."""
    gap = F.ln(F.col(probability) / (1.0 - F.col(probability))) - F.col(score)
    return predictions.agg(F.avg(gap).alias("intercept"), (F.max(gap) - F.min(gap)).alias("spread"))


# ---- residuals -----------------------------------------------------------

def fit_line(train: DataFrame, covariate: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Per feature: slope and intercept of value on covariate, and the covariate mean."""
    ok = F.col(covariate).isNotNull() & F.col(value).isNotNull()
    return settle(train.filter(ok).groupBy(feature).agg(
        F.regr_slope(value, covariate).alias("slope"), F.regr_intercept(value, covariate).alias("intercept"), F.avg(covariate).alias("center"),
    ))


def apply_slope(df: DataFrame, line: DataFrame, covariate: str, feature: str = "feature", value: str = "value", out: str = "adjusted") -> DataFrame:
    """value - slope * (covariate - training mean): the level stays."""
    return df.join(line.select(feature, "slope", "center"), feature).withColumn(
        out, F.col(value) - F.col("slope") * (F.col(covariate) - F.col("center"))
    ).drop("slope", "center")


def apply_residual(df: DataFrame, line: DataFrame, covariate: str, feature: str = "feature", value: str = "value", out: str = "adjusted") -> DataFrame:
    """value minus the full prediction, intercept included. Fit the line on controls for a controls-only residual."""
    return df.join(line.select(feature, "slope", "intercept"), feature).withColumn(
        out, F.col(value) - (F.col("intercept") + F.col("slope") * F.col(covariate))
    ).drop("slope", "intercept")


def residual_score(df: DataFrame, score: str, on: str, out: str = "residual") -> DataFrame:
    """Residual of one score on another by a straight line over all rows."""
    fit = df.agg(F.struct(F.regr_slope(score, on).alias("b"), F.regr_intercept(score, on).alias("a")))
    return df.withColumn("_f", fit.scalar()).withColumn(out, F.col(score) - F.col("_f.a") - F.col("_f.b") * F.col(on)).drop("_f")


def remove_covariate(df: DataFrame, covariate: str, feature: str = "feature", value: str = "value", out: str = "adjusted") -> DataFrame:
    """Slope fitted on every sample, test rows included. Leaky by construction; for comparison only."""
    return apply_slope(df, fit_line(df, covariate, feature, value), covariate, feature, value, out)


# ---- distribution matching ----------------------------------------------

def _sorted_positions(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str) -> DataFrame:
    order = df.withColumn("_o", F.struct(F.col(value), F.col(tie)))
    return row_numbers(order, keys, "_o", out).drop("_o")


def quantile_map(target: DataFrame, reference: DataFrame, feature: str = "feature", value: str = "value", sample: str = "sample_id", out: str = "mapped") -> DataFrame:
    """Map each feature's target values onto the reference distribution of that feature.

    Sorted position i of n_t goes to (i + 0.5) / n_t * n_ref - 0.5, clipped to the
    reference range, with linear interpolation between neighbours.
    """
    n_t = target.groupBy(feature).agg(F.count(F.lit(1)).alias("_nt"))
    n_r = reference.groupBy(feature).agg(F.count(F.lit(1)).alias("_nr"))
    sizes = settle(n_t.join(n_r, feature))
    t = _sorted_positions(target, [feature], value, sample, "_i").join(sizes, feature)
    at = (F.col("_i") + 0.5) / F.col("_nt") * F.col("_nr") - 0.5
    t = t.withColumn("_at", F.greatest(F.lit(0.0), F.least(at, F.col("_nr") - 1.0)))
    t = t.withColumn("_lo", F.floor("_at")).withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_nr") - 1))
    r = _sorted_positions(reference.select(feature, sample, value), [feature], value, sample, "_pos").select(feature, "_pos", F.col(value).alias("_ref"))
    # both neighbours in one equi-join: the reference row serves position pos and pos - 1
    both = r.select(feature, "_ref", F.explode(F.array(F.struct(F.col("_pos").alias("_at_lo"), F.lit(True).alias("_is_lo")), F.struct((F.col("_pos") - 1).alias("_at_lo"), F.lit(False).alias("_is_lo")))).alias("_s"))
    pair = both.groupBy(feature, F.col("_s._at_lo").alias("_lo")).agg(
        F.max(F.when(F.col("_s._is_lo"), F.col("_ref"))).alias("_a"), F.max(F.when(~F.col("_s._is_lo"), F.col("_ref"))).alias("_b")
    )
    # a short reference has few places, each met by many target rows
    met = t.groupBy(feature, "_lo").agg(F.count(F.lit(1)).alias("_met"))
    mixed = looked_up(t, pair.join(met, [feature, "_lo"]), [feature, "_lo"], "_met", inner=True)
    w = F.col("_at") - F.col("_lo")
    mapped = F.col("_a") + w * (F.coalesce(F.col("_b"), F.col("_a")) - F.col("_a"))
    return mixed.withColumn(out, mapped).select(*target.columns, out)


def fit_quantile_target(reference: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Sorted reference feature means: one value per rank."""
    means = reference.groupBy(feature).agg(F.avg(value).alias("target"))
    order = means.withColumn("_o", F.struct("target", feature))
    return settle(row_numbers(order, [], "_o", "position").select("position", "target"))


def apply_quantile_target(df: DataFrame, target: DataFrame, feature: str = "feature", value: str = "value", sample: str = "sample_id", out: str = "normalised") -> DataFrame:
    """Give each sample's k-th smallest feature the k-th target value; ties by feature name."""
    placed = _sorted_positions(df, [sample], value, feature, "position")
    return placed.join(target, "position").withColumnRenamed("target", out).drop("position")


# ---- empirical-Bayes batch adjustment -----------------------------------

def batch_confounded(sample: DataFrame, batch: str, outcome: str) -> bool:
    """True when every batch holds a single class."""
    mixed = sample.groupBy(batch).agg(F.count_distinct(outcome).alias("k")).filter(F.col("k") > 1)
    return mixed.limit(1).count() == 0


def fit_batch_adjustment(df: DataFrame, batch: str, feature: str = "feature", value: str = "value", steps: int = 50) -> DataFrame:
    """Location and scale per (feature, batch), shrunk over features within a batch.

    Moments come from one aggregation; the shrinkage is fixed-step arithmetic on
    the (feature, batch) rows, so no measurement is revisited. A batch of one sample
    has no variance: only its location is adjusted (scale 1). Equal variances over all
    features leave nothing to shrink: they are the scale.
    """
    per = df.groupBy(feature, batch).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    grand = per.groupBy(feature).agg(
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sqrt(F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0))) / F.sum("n")).alias("scale"),
    )
    std = per.join(grand, feature).filter(F.col("scale") > 0).select(
        feature, batch, "n", "grand", "scale",
        ((F.col("m") - F.col("grand")) / F.col("scale")).alias("g_hat"),
        (F.col("v") / (F.col("scale") * F.col("scale"))).alias("d_hat"),
    )
    std = settle(std)
    prior = std.groupBy(batch).agg(
        F.avg("g_hat").alias("g_bar"), F.var_samp("g_hat").alias("t2"), F.avg("d_hat").alias("dm"), F.var_samp("d_hat").alias("dv")
    ).select(
        batch, "g_bar", F.coalesce("t2", F.lit(0.0)).alias("t2"),
        ((2.0 * F.col("dv") + F.col("dm") * F.col("dm")) / F.nullif(F.col("dv"), F.lit(0.0))).alias("a"),
        ((F.col("dm") * F.col("dv") + F.pow("dm", 3)) / F.nullif(F.col("dv"), F.lit(0.0))).alias("b"), "dm",
    )
    joined = std.join(prior, batch)
    n = F.col("n").cast("double")

    def step(state: Column, _: Column) -> Column:
        g = (F.col("t2") * n * F.col("g_hat") + state["d"] * F.col("g_bar")) / (F.col("t2") * n + state["d"])
        ss = (n - 1.0) * F.col("d_hat") + n * (F.col("g_hat") - g) * (F.col("g_hat") - g)
        d = F.when(F.col("d_hat").isNull(), F.lit(1.0)).when(F.col("a").isNull(), F.col("dm")).otherwise((0.5 * ss + F.col("b")) / (n / 2.0 + F.col("a") - 1.0))
        return F.struct(g.alias("g"), d.alias("d"))

    start = F.struct(F.col("g_hat").alias("g"), F.coalesce("d_hat", F.lit(1.0)).alias("d"))
    done = joined.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))
    return settle(done.select(feature, batch, "grand", "scale", F.col("_s.g").alias("shift"), F.col("_s.d").alias("spread")))


def apply_batch_adjustment(df: DataFrame, fitted: DataFrame, batch: str, feature: str = "feature", value: str = "value", out: str = "adjusted") -> DataFrame:
    z = (F.col(value) - F.col("grand")) / F.col("scale")
    return df.join(fitted, [feature, batch]).withColumn(
        out, (z - F.col("shift")) / F.sqrt("spread") * F.col("scale") + F.col("grand")
    ).drop("grand", "scale", "shift", "spread")


def adjust_batches(measure: DataFrame, sample: DataFrame, batch: str, outcome: str | None = None, on: str = "sample_id") -> DataFrame:
    """Batch-adjusted long table; refuses when ``outcome`` is confounded with batch."""
    if outcome is not None and batch_confounded(sample, batch, outcome):
        raise ValueError(f"{outcome} is confounded with {batch}")
    joined = measure.join(small(sample.select(on, batch)), on)
    return apply_batch_adjustment(joined, fit_batch_adjustment(joined, batch), batch)


# ---- splits --------------------------------------------------------------

def stratified_split(sample: DataFrame, test_share: float = 0.25, key: str = "sample_id", outcome: str = "y", seed: int = 42) -> DataFrame:
    """``part`` = test for the first ceil(share * n) of each class in hash order."""
    order = sample.withColumn("_o", F.struct(phash(key, seed=seed), F.col(key)))
    placed = row_numbers(order, [outcome], "_o", "_pos").drop("_o")
    size = settle(sample.groupBy(outcome).agg(F.count(F.lit(1)).alias("_n")))
    return placed.join(size, outcome).withColumn(
        "part", F.when(F.col("_pos") < F.ceil(F.col("_n") * F.lit(test_share)), "test").otherwise("train")
    ).drop("_pos", "_n")


def stratified_folds(sample: DataFrame, k: int = 5, repeats: int = 1, key: str = "sample_id", outcome: str = "y", seed: int = 42) -> DataFrame:
    """Fold id 0..k-1 per (repeat, sample), balanced within class."""
    reps = sample.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = reps.withColumn("_o", F.struct(phash(key, "rep", seed), F.col(key)))
    return row_numbers(order, ["rep", outcome], "_o", "_pos").withColumn("fold", (F.col("_pos") % k).cast("int")).drop("_o", "_pos")


def restrict_controls(sample: DataFrame, age: str = "age", outcome: str = "y") -> DataFrame:
    """All cases, and controls at least as old as the youngest case."""
    youngest = sample.filter(F.col(outcome) == 1).agg(F.min(age))
    return sample.withColumn("_a", youngest.scalar()).filter((F.col(outcome) == 1) | (F.col(age) >= F.col("_a"))).drop("_a")
