"""Single fits, components, substituted-row attributions, ablations and panel nulls.

Loops run over folds and specifications only; every step inside them is a Spark job over the sample table, and independent fits
share a thread pool. Batches of penalised fits are in ``blockfit`` and ``selection``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.functions.hashing import phash
from cohortlab.operators import glm, prep
from cohortlab.operators.evaluate import auc, average_precision
from cohortlab.operators.running import row_numbers
from cohortlab.operators.tables import top_per_group
from cohortlab.session import cut, settle, small

POOL = 4


def parallel(work: Callable, items: Sequence) -> list:
    """Run independent driver-side steps (each a Spark job) on a few threads."""
    with ThreadPool(min(POOL, max(1, len(items)))) as pool:
        return pool.map(work, items)


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def feature_arrays(long: DataFrame, keys: Sequence[str], value: str = "z", feature: str = "feature", names: Sequence[str] | None = None, fill: float = 0.0) -> DataFrame:
    """One row per sample with an array of values in the order of ``names`` (all features of ``long`` if not given).

    A null or absent cell takes ``fill``, by default 0: the training mean of a standardised feature.
    """
    x = in_feature_order(long, feature, F.coalesce(F.col(value), F.lit(fill)), F.lit(fill), names)
    return long.filter(F.col(feature).isNotNull()).groupBy(*keys).agg(x.alias("x"))


def in_feature_order(long: DataFrame, feature: str, value: Column, missing: Column, names: Sequence[str] | None = None) -> Column:
    """Aggregate of a sample's rows: its values in feature order, ``missing`` where it has no row. One cell for each feature is expected."""
    names = feature_names(long, feature) if names is None else list(names)
    cells = F.array_sort(F.collect_list(F.when(F.col(feature).isin(names) if len(names) < 100 else F.lit(True), F.struct(F.col(feature).alias("f"), value.alias("v")))))
    wanted = F.lit(names) if names else F.array().cast("array<string>")
    # a complete sample is already in order; only others are looked up by name
    complete = F.transform(cells, lambda s: s["f"]) == wanted
    by_name = F.map_from_entries(F.array_distinct(cells))
    return F.when(complete, F.transform(cells, lambda s: s["v"])).otherwise(F.transform(wanted, lambda n: F.coalesce(F.element_at(by_name, n), missing)))


def feature_names(long: DataFrame, feature: str = "feature") -> list[str]:
    return [r[0] for r in long.filter(F.col(feature).isNotNull()).select(feature).distinct().orderBy(feature).collect()]


def _vec(df: DataFrame) -> DataFrame:
    return df.withColumn("_v", array_to_vector("x"))


def fit_lr(rows: DataFrame, l1: bool, c: float | None, label: str = "y", weight: str | None = None, max_iter: int = 100):
    """Logistic regression on array column ``x``. ``c`` is the inverse penalty of a summed loss; None means no penalty.

    MLlib leaves the intercept unpenalised.
    """
    total = rows.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    reg = 0.0 if c is None else 1.0 / (c * float(total))
    est = LogisticRegression(featuresCol="_v", labelCol=label, elasticNetParam=1.0 if l1 else 0.0, regParam=reg, standardization=False, maxIter=max_iter, tol=1e-8)
    if weight:
        est = est.setWeightCol(weight)
    return est.fit(_vec(rows))


def predict(model, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    scored = model.transform(_vec(rows))
    return scored.select(*keep, vector_to_array("probability")[1].alias("probability"))


def coefficients(model, names: Sequence[str], spark) -> DataFrame:
    """(feature, coefficient) of a linear model; one row per feature."""
    return spark.createDataFrame(list(zip(names, [float(v) for v in model.coefficients.toArray()])), "feature string, coefficient double")


# ---- trees ---------------------------------------------------------------

def fit_forest(rows: DataFrame, trees: int = 500, depth: int = 3, balanced: bool = True, label: str = "y", seed: int = 42):
    """Random forest; ``balanced`` weights classes by n / (2 n_class)."""
    if balanced:
        sizes = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("n1")))
        rows = rows.withColumn("_s", sizes.scalar()).withColumn(
            "_w", F.when(F.col(label) == 1, F.col("_s.n") / (2.0 * F.col("_s.n1"))).otherwise(F.col("_s.n") / (2.0 * (F.col("_s.n") - F.col("_s.n1"))))
        ).drop("_s")
    else:
        rows = rows.withColumn("_w", F.lit(1.0))
    return RandomForestClassifier(featuresCol="_v", labelCol=label, weightCol="_w", numTrees=trees, maxDepth=depth, seed=seed).fit(_vec(rows))


def fit_boosting(rows: DataFrame, rounds: int = 100, depth: int = 2, rate: float = 0.05, share: float = 0.8, label: str = "y", seed: int = 42):
    """Gradient-boosted trees (without leaf penalties)."""
    return GBTClassifier(featuresCol="_v", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=seed).fit(_vec(rows))


def importances(model, names: Sequence[str], spark) -> DataFrame:
    return spark.createDataFrame(list(zip(names, [float(v) for v in model.featureImportances.toArray()])), "feature string, importance double")


def shapley(model, rows: DataFrame, names: Sequence[str], keys: Sequence[str], draws: int = 16, seed: int = 42) -> DataFrame:
    """Shapley values of the predicted probability against the feature means.

    Up to 12 features they are exact: a row is scored under every subset of features kept (others at their mean);
    each subset then adds to or takes from every feature with its fixed weight. With more features they are means over
    ``draws`` feature orders drawn with ``seed``: see ``sampled_shapley``.
    """
    p = len(names)
    if p > 12:
        return sampled_shapley(model, rows, names, keys, draws, seed)
    means = rows.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(p)]))
    base = rows.withColumn("_m", means.scalar()).select(*keys, F.col("x").alias("_x"), "_m", F.explode(F.sequence(F.lit(0), F.lit((1 << p) - 1))).alias("_s"))
    masked = base.withColumn("x", F.array(*[F.when(F.getbit(F.col("_s"), F.lit(i)) == 1, F.col("_x")[i]).otherwise(F.col("_m")[i]) for i in range(p)]))
    scored = predict(model, masked, [*keys, "_s"])
    fact = [math.factorial(i) for i in range(p + 1)]
    plus = F.array(*[F.lit(fact[k - 1] * fact[p - k] / fact[p] if k else 0.0) for k in range(p + 1)])
    minus = F.array(*[F.lit(fact[k] * fact[p - k - 1] / fact[p] if k < p else 0.0) for k in range(p + 1)])
    size = F.bit_count("_s")
    part = [
        F.sum(F.col("probability") * F.when(F.getbit(F.col("_s"), F.lit(i)) == 1, F.get(plus, size)).otherwise(-F.get(minus, size))).alias(n) for i, n in enumerate(names)
    ]
    return scored.groupBy(*keys).agg(*part).unpivot(list(keys), list(names), "feature", "phi")


def sampled_shapley(model, rows: DataFrame, names: Sequence[str], keys: Sequence[str], draws: int = 16, seed: int = 42) -> DataFrame:
    """Shapley values as means over ``draws`` random feature orders, the same orders for every row.

    In each order features change one by one from their mean to the row's value, and a change of the prediction is
    the feature's. So a row's values add up to its prediction less that at the means, as exact ones do. Work per row is
    draws * (features + 1) predictions; nothing is shuffled but partial sums.
    """
    p = len(names)
    draw = random.Random(seed)
    orders = [draw.sample(range(p), p) for _ in range(draws)]
    places = [[o.index(i) for i in range(p)] for o in orders]
    means = rows.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(p)]))
    lists = lambda table: F.array(*[F.array(*[F.lit(v) for v in one]) for one in table])
    base = rows.withColumn("_m", means.scalar()).select(*keys, F.col("x").alias("_x"), "_m", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_d"))
    base = base.withColumn("_at", lists(places)[F.col("_d")]).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(p))))
    masked = base.withColumn("x", F.transform("_x", lambda v, i: F.when(F.get("_at", i) < F.col("_s"), v).otherwise(F.get("_m", i))))
    scored = predict(model, masked, [*keys, "_d", "_s"]).withColumn("_o", lists(orders)[F.col("_d")])
    parts = F.array(
        F.struct(F.get("_o", F.col("_s") - 1).alias("i"), F.col("probability").alias("v")),
        F.struct(F.get("_o", F.col("_s")).alias("i"), (-F.col("probability")).alias("v")),
    )
    moved = scored.select(*keys, F.inline(parts)).filter("i IS NOT NULL")
    return moved.groupBy(*keys, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("feature")).agg((F.sum("v") / draws).alias("phi"))


def attribution_ranking(phi: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return phi.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


def permutation_importance(model, rows: DataFrame, names: Sequence[str], key: str, label: str = "y", seed: int = 42) -> DataFrame:
    """AUC lost when one feature's values are reassigned among rows by hash order."""
    order = row_numbers(rows.select(key, "x"), [], key, "_pos")
    shuffled = row_numbers(rows.select(key, "x").withColumn("_o", F.struct(phash(key, seed=seed), F.col(key))), [], "_o", "_pos").select("_pos", F.col("x").alias("_other"))
    paired = cut(order.join(shuffled, "_pos").join(rows.select(key, label), key))
    # -1 leaves the row as it is
    swapped = F.transform("x", lambda v, i: F.when(i == F.col("_i"), F.get("_other", i)).otherwise(v))
    name = F.when(F.col("_i") < 0, "").otherwise(F.get(F.lit(list(names)), F.col("_i")))
    cases = paired.withColumn("_i", F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1)))).select(key, label, name.alias("feature"), swapped.alias("x"))
    a = auc(predict(model, cases, ["feature", label]), ["feature"], "probability", label)
    full = a.filter("feature = ''").select("auc")
    return a.filter("feature <> ''").withColumn("full_auc", full.scalar()).select("feature", (F.col("full_auc") - F.col("auc")).alias("auc_loss"))


# ---- principal components ------------------------------------------------

PCA_TOLERANCE = 1e-9
PCA_BYTES = 256 << 20


def _summed_blocks(rows: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray], features: int) -> np.ndarray:
    """The sum over all rows of ``work(x)`` (features, width): one partial sum a task, cut into runs of features that are added up on Spark."""
    run_of = max(1, (4 << 20) // (8 * width))

    def partial(batches):
        total = np.zeros((features, width))
        for batch in batches:
            if batch.num_rows:
                total += work(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, :features])
        cuts = range(0, features, run_of)
        yield pa.RecordBatch.from_arrays([pa.array([i // run_of for i in cuts], pa.int64()), pa.array([total[i : i + run_of].tobytes() for i in cuts], pa.binary())], ["run", "s"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_buffer()) for s in table.column("s"))
        return pa.table({"run": table.column("run")[:1], "s": pa.array([total.tobytes()], pa.binary())})

    found = rows.select("x").mapInArrow(partial, "run bigint, s binary").groupBy("run").applyInArrow(add, "run bigint, s binary").collect()
    return np.concatenate([np.frombuffer(r["s"]) for r in sorted(found, key=lambda r: r["run"])] or [np.zeros(0)]).reshape(-1, width)


def principal_components(rows: DataFrame, k: int = 5, oversample: int = 8, seed: int = 7, max_passes: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components as columns, shares of variance) of array column ``x``, for any number of rows and tens of thousands of features.

    Block Krylov iteration: a pass multiplies the last block of basis vectors, a thin matrix, by the centred rows and back, summed over blocks of rows. The
    basis is kept orthonormal by thin QR and the components are read off its small projected matrix, until their residuals are below ``PCA_TOLERANCE`` of the largest
    variance. A basis above ``PCA_BYTES`` is restarted from its best vectors. No features-by-features or rows-by-rows matrix is formed.
    """
    rows = cut(rows.select("x").filter(F.col("x").isNotNull()))
    shape = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    n, p = shape[0], shape[1] or 0
    if not n or not p:
        return np.zeros(p), np.zeros((p, 0)), np.zeros(0)
    mean = _summed_blocks(rows, 1, lambda x: x.sum(axis=0)[:, None], p)[:, 0] / n
    total = _summed_blocks(rows, 1, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None], p).sum()
    k = min(k, p, n)
    width = min(p, k + oversample)
    most = max(3 * width, int(PCA_BYTES // (16 * p)) // width * width)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((p, width)))[0]
    image, last = np.zeros((p, 0)), basis
    for _ in range(max_passes):
        sent = rows.sparkSession.sparkContext.broadcast((mean, last))

        def times(x, sent=sent):
            mean, v = sent.value
            c = x - mean
            return c.T @ (c @ v)

        image = np.hstack([image, _summed_blocks(rows, last.shape[1], times, p)])
        sent.unpersist()
        small_matrix = basis.T @ image
        values, turns = np.linalg.eigh((small_matrix + small_matrix.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        vectors = basis @ turns[:, :k]
        residual = np.linalg.norm(image @ turns[:, :k] - vectors * values[:k], axis=0)
        if basis.shape[1] >= p or residual.max() <= PCA_TOLERANCE * max(values[0], 1e-300):
            break
        fresh = image[:, -last.shape[1] :]
        if basis.shape[1] + width > most:
            keep = turns[:, : 2 * width]
            basis, image = basis @ keep, image @ keep
            fresh = image[:, :width]
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        q, r = np.linalg.qr(fresh)
        last = q[:, np.abs(np.diag(r)) > 1e-10 * max(values[0], 1e-300)][:, : p - basis.shape[1]]
        if not last.shape[1]:  # the basis spans all that the rows span
            break
        basis = np.hstack([basis, last])
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] > 0, 1.0, -1.0)
    return mean, vectors, np.maximum(values[:k], 0.0) / total if total > 0 else np.zeros(k)


def pca_scores(rows: DataFrame, keys: Sequence[str], k: int = 5) -> tuple[DataFrame, list[float]]:
    """(keys, pc, score) and explained variance shares of arrays ``x``; the largest loading of a component is positive. Scores are of centred values."""
    mean, vectors, share = principal_components(rows, k)
    sent = rows.sparkSession.sparkContext.broadcast((mean, vectors))

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        mean, vectors = sent.value
        return pd.Series(list((np.stack(x.to_numpy()) - mean) @ vectors) if len(x) else [], dtype=object)

    out = rows.filter(F.col("x").isNotNull()).select(*keys, F.posexplode(project("x")).alias("_i", "score"))
    return out.select(*keys, F.concat(F.lit("PC"), (F.col("_i") + 1).cast("string")).alias("pc"), "score"), [float(v) for v in share]


# ---- batched small models ------------------------------------------------

def subset_models(columns: Sequence[str]) -> list[tuple[str, ...]]:
    return [s for size in range(1, len(columns) + 1) for s in combinations(columns, size)]


def fit_specs(df: DataFrame, specs: dict[str, Sequence[str]], columns: Sequence[str], label: str = "y", l2: float = 0.0, by: Column | None = None, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, int]:
    """Several model specifications on the same rows, fitted in one batch.

    A column outside a specification is zero there, which leaves its coefficient
    at zero. Returns (fits, design rows with ``keep``, number of coefficients).
    """
    lists = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(1.0 if c in cols else 0.0).alias(f"m_{c}") for c in columns]) for n, cols in specs.items()]))
    rows = df.withColumn("_m", lists)
    model = F.col("_m.n") if by is None else F.concat_ws("|", F.col("_m.n"), by.cast("string"))
    masked = rows.select(model.alias("model"), F.col(label).cast("double").alias("y"), *[c for c in keep if c not in ("y", "model")], *[(F.col(c).cast("double") * F.col(f"_m.m_{c}")).alias(c) for c in columns])
    design = glm.design(masked, list(columns), "model")
    k = len(columns) + 1
    fits = glm.fit_logistic(design, k, l2)
    scored = masked.withColumn("x", F.array(F.lit(1.0), *[F.col(c) for c in columns]))
    return fits, scored, k


def nested_auc(scored: DataFrame, base: str, full: str, label: str = "y") -> DataFrame:
    """One row: AUC of two nested models (``model``, ``score``) on the same rows, and the gain of the fuller one."""
    a = auc(scored, ["model"], "score", label)
    both = a.agg(*[F.max(F.when(F.col("model") == m, F.col("auc"))).alias(n) for m, n in ((base, "base_auc"), (full, "full_auc"))])
    return both.withColumn("delta_auc", F.col("full_auc") - F.col("base_auc"))


def ablation(train: DataFrame, others: dict[str, DataFrame], columns: Sequence[str], label: str = "y", l2: float = 1.0) -> DataFrame:
    """AUC of every non-empty feature subset, refitted on training, in every cohort, with the change against the full set."""
    specs = {"+".join(s): s for s in subset_models(columns)}
    fits, _, k = fit_specs(train, specs, columns, label, l2)
    fits = cut(fits.select("model", "beta"))
    cohorts = union([t.select(label, *columns).withColumn("cohort", F.lit(n)) for n, t in {"training": train, **others}.items()])
    marks = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), *[F.lit(1.0 if c in s else 0.0).alias(f"m_{c}") for c in columns]) for n, s in specs.items()]))
    rows = cohorts.withColumn("_m", marks).select(
        "cohort", label, F.col("_m.model").alias("model"), F.array(F.lit(1.0), *[F.col(c).cast("double") * F.col(f"_m.m_{c}") for c in columns]).alias("x")
    )
    scored = glm.score_rows(rows, fits, k, ["cohort", label])
    a = auc(scored, ["model", "cohort"], "score", label)
    full = a.filter(F.col("model") == "+".join(columns)).select("cohort", F.col("auc").alias("full_auc"))
    return a.join(full, "cohort").select("model", "cohort", "auc", (F.col("auc") - F.col("full_auc")).alias("delta_auc"))


def fixed_score_ablation(long: DataFrame, columns: Sequence[str], cohort: str = "cohort", key: str = "sample_id", label: str = "y") -> DataFrame:
    """AUC and average precision of the mean of z over every non-empty subset of ``columns``, in every cohort, with the change against all of them.

    Nothing is fitted: values (cohort, key, label, feature, value) are scaled within their cohort and a subset's score is a plain mean.
    """
    z = prep.cohort_zscore(long.filter(F.col("feature").isin(list(columns))), cohort)
    wide = z.groupBy(cohort, key, label).agg(*[F.max(F.when(F.col("feature") == c, F.col("z"))).alias(f"z_{i}") for i, c in enumerate(columns)])
    at = {c: f"z_{i}" for i, c in enumerate(columns)}
    scores = [F.struct(F.lit("+".join(s)).alias("model"), F.lit(len(s)).alias("n_features"), (sum((F.col(at[c]) for c in s), F.lit(0.0)) / len(s)).alias("score")) for s in subset_models(columns)]
    rows = wide.select(cohort, label, F.inline(F.array(*scores)))
    keys = [cohort, "model", "n_features"]
    out = cut(auc(rows, keys, "score", label).select(*keys, "auc").join(average_precision(rows, keys, "score", label).select(*keys, "average_precision"), keys))
    full = out.filter(F.col("model") == "+".join(columns)).select(cohort, F.col("auc").alias("_a"), F.col("average_precision").alias("_p"))
    return out.join(small(full), cohort).select(*keys, "auc", "average_precision", (F.col("auc") - F.col("_a")).alias("delta_auc"), (F.col("average_precision") - F.col("_p")).alias("delta_average_precision"))


def frozen_on_schemes(train: DataFrame, other: DataFrame, columns: Sequence[str], schemes: Sequence[str], key: str = "sample_id", label: str = "y", l2: float = 1.0) -> DataFrame:
    """AUC of one frozen model, and of each of its features, on several preprocessings of another cohort.

    ``train`` is (key, label, feature, value), ``other`` has one value column for each of ``schemes``. The model is fitted on the scaled training values and
    applied, with the training scaling, to every scheme. One row for ``model`` and each feature: an AUC by scheme, and each one's change from the first.
    """
    pick = F.col("feature").isin(list(columns))
    train, other = train.filter(pick), other.filter(pick)
    scaler = settle(prep.fit_scaler(train, ddof=0))
    x = lambda v: [F.max(F.when(F.col("feature") == c, F.col(v))).alias(f"x_{i}") for i, c in enumerate(columns)]
    names = [f"x_{i}" for i in range(len(columns))]
    wide = prep.apply_scaler(train, scaler).groupBy(key, label).agg(*x("z"))
    fits = glm.fit_logistic(glm.design(wide, names, F.lit("m"), label), len(columns) + 1, l2)
    long = other.unpivot([key, label, "feature"], list(schemes), "scheme", "value")
    z = prep.apply_scaler(long, scaler).groupBy("scheme", key, label).agg(*x("z"))
    scored = glm.score_rows(z.withColumn("x", F.array(F.lit(1.0), *names)).withColumn("model", F.lit("m")), fits, len(columns) + 1, ["scheme", label])
    scores = scored.select("scheme", label, F.lit("model").alias("analysis"), F.round("score", 9).alias("score"))
    scores = scores.unionByName(long.select("scheme", label, F.col("feature").alias("analysis"), F.col("value").alias("score")))
    areas = auc(scores, ["analysis", "scheme"], "score", label)
    wide = areas.groupBy("analysis").agg(*[F.max(F.when(F.col("scheme") == s, F.col("auc"))).alias(f"auc_{s}") for s in schemes])
    return wide.select("*", *[(F.col(f"auc_{s}") - F.col(f"auc_{schemes[0]}")).alias(f"delta_{s}") for s in schemes[1:]])


def covariate_fold_auc(sample: DataFrame, covariate: str, folds: DataFrame, key: str = "sample_id", label: str = "y", l2: float = 1.0) -> DataFrame:
    """Cross-validated AUC of a model of the covariate alone: (rep, fold, n1, n0, auc). ``folds`` is (key, rep, fold); all fits advance together."""
    rows = cut(sample.select(key, label, covariate).join(folds.select(key, "rep", "fold"), key))
    number = rows.agg(F.max("fold")).first()[0]
    held = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(number))))
    fits = glm.fit_logistic(glm.design(held.filter("fold <> held"), [covariate], F.struct("rep", F.col("held").cast("int").alias("fold")), label), 2, l2)
    x = rows.select(label, F.struct("rep", F.col("fold").cast("int").alias("fold")).alias("model"), F.array(F.lit(1.0), F.col(covariate).cast("double")).alias("x"))
    scored = glm.score_rows(x, fits, 2, [label]).select(label, "model.rep", "model.fold", F.round("score", 9).alias("score"))
    return auc(scored, ["rep", "fold"], "score", label)


def random_panels(features: DataFrame, n_panels: int, size: int = 3, feature: str = "feature", seed: int = 42) -> DataFrame:
    """(panel, slot, feature): ``size`` features per panel, the smallest hashes of (feature number, panel)."""
    numbered = row_numbers(features.select(feature).distinct(), [], feature, "_f")
    drawn = numbered.withColumn("panel", F.explode(F.sequence(F.lit(0), F.lit(n_panels - 1)))).withColumn("_h", phash("_f", "panel", seed))
    best = top_per_group(drawn, ["panel"], [F.col("_h"), F.col("_f")], size)
    return row_numbers(best.withColumn("_o", F.struct("_h", "_f")), ["panel"], "_o", "slot", spread=False).select("panel", "slot", feature)


def panel_rows(z: DataFrame, panels: DataFrame, size: int, keys: Sequence[str], value: str = "z", feature: str = "feature") -> DataFrame:
    """(panel, keys, x): one design row per panel and sample."""
    cols = [F.max(F.when(F.col("slot") == i, F.col(value))) for i in range(size)]
    return z.join(small(panels), feature).groupBy("panel", *keys).agg(F.array(F.lit(1.0), *cols).alias("x"))


def panel_transfer(train: DataFrame, other: DataFrame, panels: DataFrame, size: int, key: str = "sample_id", label: str = "y", l2: float = 1.0) -> DataFrame:
    """Transfer AUC of every panel: all panels fitted together on training, scored on the other cohort."""
    rows = panel_rows(train, panels, size, [key, label])
    design = rows.select(F.col("panel").alias("model"), "x", F.col(label).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(0.0).alias("o"))
    fits = glm.fit_logistic(design, size + 1, l2)
    held = panel_rows(other, panels, size, [key, label]).withColumnRenamed("panel", "model")
    scored = glm.score_rows(held, fits, size + 1, [label])
    return auc(scored, ["model"], "score", label).select(F.col("model").alias("panel"), "auc")


def panel_within(z: DataFrame, folds: DataFrame, panels: DataFrame, size: int, key: str = "sample_id", label: str = "y", l2: float = 1.0) -> DataFrame:
    """Held-out AUC of every panel inside one cohort. All (panel, fold) fits advance together.

    ``folds`` is (key, fold); give every sample its own fold for leave-one-out.
    """
    rows = cut(panel_rows(z, panels, size, [key, label]).join(small(folds.select(key, "fold")), key))
    n = settle(folds.select("fold").distinct())
    every = n.agg(F.array_sort(F.collect_list("fold")))
    spread = rows.withColumn("_a", every.scalar()).withColumn("_f", F.explode("_a")).drop("_a")
    tag = F.struct(F.col("panel"), F.col("_f").alias("fold"))
    train = spread.filter(F.col("fold") != F.col("_f")).select(tag.alias("model"), "x", F.col(label).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(0.0).alias("o"))
    fits = glm.fit_logistic(train, size + 1, l2)
    held = rows.select(F.struct("panel", "fold").alias("model"), "x", label)
    scored = glm.score_rows(held, fits, size + 1, [label]).withColumn("panel", F.col("model.panel"))
    return auc(scored, ["panel"], "probability", label).select("panel", "auc")


def panel_summary(null: DataFrame, observed: float) -> DataFrame:
    """Null median and sd, share of panels at or above the observed AUC."""
    return null.agg(
        F.count("auc").alias("n_panels"), F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("sd_auc"),
        F.avg((F.col("auc") >= observed).cast("double")).alias("share_at_least"), F.avg((F.col("auc") < observed).cast("double")).alias("percentile"),
    )


def batch_classifier(scores: DataFrame, label: str, columns: Sequence[str], folds: DataFrame, shuffles: int, key: str = "sample_id", l2: float = 1.0, seed: int = 42) -> DataFrame:
    """Held-out AUC for predicting a batch label from component scores, for the true label and shuffled ones.

    Replicate -1 is the true label; in the others the label counts are kept and
    rows take them in hash order. All (replicate, fold) fits advance together.
    """
    base = cut(scores.select(key, label, *columns).join(folds.select(key, "fold"), key))
    totals = base.agg(F.struct(F.sum(F.col(label).cast("bigint")).alias("n1")))
    order = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1)))).withColumn("_o", F.struct(phash(key, "rep", seed), F.col(key)))
    shuffled = row_numbers(order, ["rep"], "_o", "_pos").withColumn("_t", totals.scalar())
    shuffled = shuffled.withColumn(label, (F.col("_pos") < F.col("_t.n1")).cast("int")).drop("_o", "_pos", "_t")
    rows = cut(base.withColumn("rep", F.lit(-1)).unionByName(shuffled).select("rep", "fold", F.col(label).cast("double").alias("y"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns]).alias("x")))
    every = folds.select("fold").distinct().agg(F.array_sort(F.collect_list("fold")))
    spread = rows.withColumn("_a", every.scalar()).withColumn("_f", F.explode("_a")).drop("_a")
    train = spread.filter(F.col("fold") != F.col("_f")).select(F.struct("rep", F.col("_f").alias("fold")).alias("model"), "x", "y", F.lit(1.0).alias("w"), F.lit(0.0).alias("o"))
    k = len(columns) + 1
    fits = glm.fit_logistic(train, k, l2)
    held = glm.score_rows(rows.select(F.struct("rep", "fold").alias("model"), "x", "y"), fits, k, ["y"]).withColumn("rep", F.col("model.rep"))
    return auc(held, ["rep"], "probability", "y").select("rep", "auc")
