"""Curves, thresholds and classification metrics from a prediction table.

Every curve starts from distinct scores with class counts, so its size is the
number of distinct scores and ties are handled exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.operators.running import quantiles, ready, running, tally
from cohortlab.operators.twogroup import mann_whitney


def auc(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """ROC-AUC with ties one half; null for a single class."""
    return mann_whitney(df, keys, score, label, with_p=False).select(*keys, "n1", "n0", "auc")


def curve(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """One row per distinct threshold (predict 1 at score >= threshold): tp, fp, rates, precision."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    keys = list(keys)
    known, spread = ready(known, keys, None)
    y = F.col(label).cast("bigint")
    base = tally(known, keys, score, n1=y, n0=1 - y)
    steps = running(base, keys, score, sums=["n1", "n0"], descending=True, spread=spread, totals=["n1", "n0"])
    tp, fp = F.col("cum_n1"), F.col("cum_n0")
    pos, neg = F.nullif(F.col("tot_n1"), F.lit(0)), F.nullif(F.col("tot_n0"), F.lit(0))
    return steps.select(
        *keys, F.col(score).alias("threshold"), F.col("n1"), F.col("n0"), tp.alias("tp"), fp.alias("fp"),
        (tp / pos).alias("tpr"), (fp / neg).alias("fpr"), (tp / (tp + fp)).alias("precision"),
        # exact for any counts: a product of two bigints can exceed 64 bits
        (tp.cast("decimal(19,0)") * F.col("tot_n0") - fp.cast("decimal(19,0)") * F.col("tot_n1")).alias("j_scaled"),
        F.col("tot_n1").alias("positives"), F.col("tot_n0").alias("negatives"),
    )


def average_precision(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """Sum of recall steps times precision, and the trapezoid ROC area, from one curve."""
    c = curve(df, keys, score, label)
    area = F.col("n0") / F.nullif(F.col("negatives"), F.lit(0)) * (2 * F.col("tp") - F.col("n1")) / (2.0 * F.nullif(F.col("positives"), F.lit(0)))
    return c.groupBy(*keys).agg(
        F.sum(F.col("n1") / F.nullif(F.col("positives"), F.lit(0)) * F.col("precision")).alias("average_precision"),
        F.sum(area).alias("roc_area"),
    )


def youden(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest threshold on ties. J is compared as exact integers."""
    c = curve(df, keys, score, label)
    best = c.groupBy(*keys).agg(F.max(F.struct("j_scaled", "threshold", "tpr", "fpr")).alias("b"))
    return best.select(*keys, F.col("b.threshold").alias("threshold"), (F.col("b.tpr") - F.col("b.fpr")).alias("j"))


def probability_metrics(df: DataFrame, keys: Sequence[str], probability: str = "probability", label: str = "y", threshold: float = 0.5) -> DataFrame:
    """Brier score, accuracy and balanced accuracy at a threshold."""
    hit = (F.col(probability) >= threshold).cast("int")
    return df.groupBy(*keys).agg(
        F.avg(F.pow(F.col(probability) - F.col(label), 2)).alias("brier"),
        F.avg((hit == F.col(label)).cast("double")).alias("accuracy"),
        ((F.avg(F.when(F.col(label) == 1, hit.cast("double"))) + F.avg(F.when(F.col(label) == 0, 1.0 - hit))) / 2.0).alias("balanced_accuracy"),
        F.avg(probability).alias("mean_probability"), F.avg(label).alias("prevalence"),
    )


def confusion(df: DataFrame, keys: Sequence[str], threshold: Column | float, score: str = "score", label: str = "y") -> DataFrame:
    """Counts and derived rates at a locked threshold; a rate with an empty denominator is null."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, y = F.col(score) >= t, F.col(label)
    c = df.groupBy(*keys).agg(
        F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"),
        F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(~hit & (y == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "*", F.try_divide(tp, tp + fn).alias("sensitivity"), F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(tp, tp + fp).alias("ppv"), F.try_divide(tn, tn + fn).alias("npv"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def locked_threshold(train: DataFrame, other: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """Confusion tables of other cohorts at the training Youden threshold (one scalar)."""
    best = youden(train, [], score, label).select("threshold")
    marked = other.withColumn("locked_threshold", best.scalar())
    return confusion(marked, [*keys, "locked_threshold"], F.col("locked_threshold"), score, label)


def fold_quality(folds: DataFrame, keys: Sequence[str], metric: str = "auc") -> DataFrame:
    """Share of folds below one half; mean, sd and quantiles of a fold metric."""
    known = folds.filter(F.col(metric).isNotNull())
    a = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg((F.col(metric) < 0.5).cast("double")).alias("share_below_half"),
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.min(metric).alias("min"), F.max(metric).alias("max"),
    )
    q = quantiles(known, keys, metric, {"q025": 0.025, "median": 0.5, "q975": 0.975})
    if keys:
        return a.join(q, list(keys))
    return a.withColumn("_q", q.select(F.struct("*").alias("q")).scalar()).select("*", "_q.*").drop("_q")


def compare_schemes(df: DataFrame, scheme: str, feature: str = "feature", value: str = "value", label: str = "y") -> DataFrame:
    """AUC per (scheme, feature): the same features under several preprocessings."""
    return auc(df, [scheme, feature], value, label)
