"""L1 selection: penalty tuning, stability over resamples and folds, nested cross-validation and panels, all by ``blockfit``.

As in the analyses this follows, features are scaled inside each training part and the intercept is penalised with the coefficients
(``penalise_first``). Every set of fits advances together; the driver holds one row of coefficients for each model.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cohortlab.functions.hashing import phash
from cohortlab.operators import blockfit, prep
from cohortlab.operators.blockfit import Models
from cohortlab.operators.running import row_numbers
from cohortlab.session import cut, small

SELECTED = 1e-10


def tune_penalty(rows: DataFrame, names: Sequence[str], folds: DataFrame, grid: Sequence[float], k: int, repeats: int, key: str = "sample_id", label: str = "y") -> DataFrame:
    """Mean and sd of AUC, accuracy and selected features per penalty over (rep, fold); ``folds`` numbers ``k`` folds in each of ``repeats`` sets."""
    blocks = blockfit.pack(rows, names, key, label, folds=folds)
    jobs = [(c, rep, fold) for c in grid for rep in range(repeats) for fold in range(k)]
    c, rep, fold = (np.array(v) for v in zip(*jobs))
    models = Models.of(len(jobs), c=c, part=rep, held=fold)
    fits = blockfit.fit(blocks, models)
    n_selected = (np.abs(fits.beta[:, 1:]) > SELECTED).sum(axis=1)
    tags = blockfit.tagged(rows.sparkSession, len(models), c=("double", c), n_selected=("bigint", n_selected)).withColumnRenamed("model", "grp")
    per = blockfit.areas(blocks, models, fits, key=key).join(small(tags), "grp")
    return per.groupBy("c").agg(
        F.count("auc").alias("n_folds"), F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("sd_auc"),
        F.avg("accuracy").alias("mean_accuracy"), F.avg("n_selected").alias("mean_selected"),
    )


def lasso_stability(rows: DataFrame, names: Sequence[str], replicates: int, c: float = 0.3, key: str = "sample_id", label: str = "y", seed: int = 42) -> DataFrame:
    """(rep, feature, coefficient) over bootstrap resamples; how often a sample is drawn is its weight. Single-class resamples are left out."""
    blocks = blockfit.pack(rows, names, key, label, replicates=replicates, seed=seed)
    models = Models.of(replicates, c=c, boot=np.arange(replicates))
    fits = blockfit.fit(blocks, models)
    spark = rows.sparkSession
    both = (fits.cases > 0) & (fits.cases < fits.n)
    tags = blockfit.tagged(spark, len(models), rep=("int", np.arange(replicates)), both=("boolean", both)).filter("both")
    return blockfit.coefficients(spark, fits, names).join(small(tags), "model").select("rep", "feature", "coefficient")


def fold_stability(rows: DataFrame, folds: DataFrame, names: Sequence[str], k: int, repeats: int = 1, c: float = 0.3, key: str = "sample_id", label: str = "y") -> DataFrame:
    """(rep, fold, feature, coefficient) from the training part of every fold."""
    blocks = blockfit.pack(rows, names, key, label, folds=folds)
    rep, fold = (g.ravel() for g in np.indices((repeats, k)))
    models = Models.of(len(rep), c=c, part=rep, held=fold)
    fits = blockfit.fit(blocks, models)
    tags = small(blockfit.tagged(rows.sparkSession, len(models), rep=("int", rep), fold=("int", fold)))
    return blockfit.coefficients(rows.sparkSession, fits, names).join(tags, "model").select("rep", "fold", "feature", "coefficient")


def nested_folds(sample: DataFrame, outer: int, inner: int, repeats: int, key: str = "sample_id", label: str = "y", seed: int = 42) -> DataFrame:
    """(key, rep, fold): the outer sets 0..repeats-1, then for each outer part its inner set; samples the part leaves out have fold -1 there."""
    folds = cut(prep.stratified_folds(sample.select(key, label), outer, repeats, key, label, seed).select(key, label, "rep", "fold"))
    parts = folds.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).withColumn("set", F.lit(repeats) + F.col("rep") * outer + F.col("part"))
    order = parts.filter(F.col("fold") != F.col("part")).withColumn("_o", F.struct(phash(key, "set", seed + 1), F.col(key)))
    inside = row_numbers(order, ["set", label], "_o", "_pos").select(key, F.col("set").cast("int").alias("rep"), (F.col("_pos") % inner).cast("int").alias("fold"))
    outside = parts.filter(F.col("fold") == F.col("part")).select(key, F.col("set").cast("int").alias("rep"), F.lit(-1).alias("fold"))
    return folds.select(key, "rep", "fold").unionByName(inside).unionByName(outside)


def nested_cv(rows: DataFrame, names: Sequence[str], grid: Sequence[float], outer: int = 5, inner: int = 5, repeats: int = 1, share: float = 0.25, covariate: str | None = "age", fallback: Sequence[str] | None = None, key: str = "sample_id", label: str = "y", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Outer-fold (rep, fold, c, n_selected, n1, n0, auc, average_precision) and the features selected per outer fold.

    Within each outer training part: residualise on controls, keep the top variance share, scale (again in each inner training part), choose
    the penalty by mean inner AUC (the smaller of equal ones), select by L1, refit without penalty on the selected features. An empty
    selection falls back to ``fallback`` or, without it, to the feature of largest variance.
    """
    spark = rows.sparkSession
    blocks = blockfit.pack(rows, names, key, label, covariate, nested_folds(rows.select(key, label), outer, inner, repeats, key, label, seed))
    p = blocks.p
    rep, fold = (g.ravel() for g in np.indices((repeats, outer)))
    parts = Models.of(len(rep), part=rep, held=fold)
    scaling = blockfit.scaled(blocks, parts)
    keep = int(np.ceil(p * share))
    order = np.lexsort((np.broadcast_to(np.arange(p), scaling.variance.shape), -scaling.variance), axis=1)
    allowed = np.zeros(scaling.variance.shape, bool)
    np.put_along_axis(allowed, order[:, :keep], True, axis=1)
    chosen = np.full(len(parts), float(grid[0]))
    if len(grid) > 1:
        part, g, c = (v.ravel() for v in np.meshgrid(np.arange(len(parts)), np.arange(inner), np.array(grid, float), indexing="ij"))
        models = Models.of(len(part), c=c, part=repeats + part, held=g, allowed=allowed[part])
        start = blockfit.scaled(blocks, models, slope=scaling.slope[part] if covariate else None)
        fits = blockfit.fit(blocks, models, start=start)
        tags = small(blockfit.tagged(spark, len(models), part=("int", part), c=("double", c)).withColumnRenamed("model", "grp"))
        means = blockfit.areas(blocks, models, fits, key=key).join(tags, "grp").groupBy("part", "c").agg(F.avg("auc").alias("a"))
        best = means.groupBy("part").agg(F.min(F.struct((-F.round("a", 12)).alias("a"), "c")).alias("x")).select("part", "x.c")
        for r in best.collect():  # one row for each outer part
            chosen[r["part"]] = r["c"]
    lasso = replace_c(parts, chosen, allowed)
    fits = blockfit.fit(blocks, lasso)
    picked = np.abs(fits.beta[:, 1:]) > SELECTED
    none = ~picked.any(axis=1)
    instead = np.array([n in fallback for n in names]) if fallback else None
    for i in np.flatnonzero(none).tolist():
        picked[i] = instead if fallback else np.arange(p) == order[i, 0]
    final = replace_c(parts, np.full(len(parts), np.inf), picked)
    refit = blockfit.fit(blocks, final, "l2")
    metrics = blockfit.areas(blocks, final, refit, key=key).withColumnRenamed("grp", "model")
    metrics = metrics.join(small(blockfit.tagged(spark, len(parts), rep=("int", rep), fold=("int", fold), c=("double", chosen), n_selected=("bigint", picked.sum(axis=1)))), "model").drop("model")
    tags = small(blockfit.tagged(spark, len(parts), rep=("int", rep), fold=("int", fold)))
    found = blockfit.coefficients(spark, fits, names).join(tags, "model").filter(F.abs("coefficient") > SELECTED).select("rep", "fold", "feature", "coefficient")
    return metrics, found


def numbered_panels(panels: DataFrame, names: Sequence[str], size: int) -> np.ndarray:
    """(panels, size) feature numbers from (panel, slot, feature); a row of the result for each model, so it is collected."""
    at = {n: i for i, n in enumerate(names)}
    found = panels.select("panel", "slot", "feature").collect()
    out = np.zeros((1 + max((r["panel"] for r in found), default=-1), size), np.int64)
    for r in found:
        out[r["panel"], r["slot"]] = at[r["feature"]]
    return out


def panel_transfer(train: DataFrame, other: DataFrame, names: Sequence[str], panels: np.ndarray, c: float = 0.3, penalty: str = "l1", key: str = "sample_id", label: str = "y") -> DataFrame:
    """(panel, auc): every panel fitted on ``train`` and scored, with the training scaling, on ``other`` (key, label, x)."""
    blocks = blockfit.pack(train, names, key, label)
    models = Models.of(len(panels), c=c, columns=panels)
    fits = blockfit.fit(blocks, models, penalty)
    held = replace(blockfit.pack(other, names, key, label), centre=blocks.centre)
    return blockfit.areas(held, models, fits, which="all", key=key).select(F.col("grp").cast("int").alias("panel"), "auc")


def replace_c(models: Models, c: np.ndarray, allowed: np.ndarray) -> Models:
    return Models(c, models.boot, models.part, models.held, allowed)
