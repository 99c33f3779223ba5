"""Many small logistic regressions advanced together.

A design table holds (model, x array, y, optional weight and offset). Each
Newton step is one grouped aggregation over all models: gradient and Hessian
sums per model, combined map-side, so a model with a third of all rows is no
hot spot. Only the k by k solves of the summary rows run in Python. The current
coefficients are a cut table, joined by broadcast when counted small.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortlab.functions import tails
from cohortlab.functions.scalars import logit
from cohortlab.session import BROADCAST_BYTES, bytes_of, cut, small


def design(df: DataFrame, columns: Sequence[str], model: Column | str, y: str = "y", weight: Column | str | None = None, offset: Column | str | None = None, intercept: bool = True) -> DataFrame:
    """(model, x, y, w, o) from ordinary columns; rows with a null input are left out."""
    x = ([F.lit(1.0)] if intercept else []) + [F.col(c).cast("double") for c in columns]
    as_col = lambda c, default: F.lit(default) if c is None else (F.col(c) if isinstance(c, str) else c)
    out = df.select(
        (F.col(model) if isinstance(model, str) else model).alias("model"), F.array(*x).alias("x"), F.col(y).cast("double").alias("y"),
        as_col(weight, 1.0).cast("double").alias("w"), as_col(offset, 0.0).cast("double").alias("o"),
    )
    bad = F.exists("x", lambda v: v.isNull()) | F.col("y").isNull() | F.col("o").isNull()
    return out.filter(~bad)


_SOLUTION = T.StructType([
    T.StructField("step", T.ArrayType(T.DoubleType())), T.StructField("se", T.ArrayType(T.DoubleType())), T.StructField("singular", T.BooleanType()),
])


@F.pandas_udf(_SOLUTION)
def _solve(h: pd.Series, g: pd.Series) -> pd.DataFrame:
    """Newton step and standard errors per summary row; least squares when singular."""
    steps, ses, flags = [], [], []
    for flat, grad in zip(h, g):
        k = len(grad)
        full = np.zeros((k, k))
        full[np.triu_indices(k)] = flat
        full = full + np.triu(full, 1).T
        # a column that is zero throughout stays at zero
        idle = np.flatnonzero(np.diag(full) == 0)
        full[idle, idle] = 1.0
        bad = not np.isfinite(full).all() or np.linalg.cond(full) > 1e14
        if bad:
            full = np.nan_to_num(full)
            inv = np.linalg.pinv(full)
        else:
            inv = np.linalg.inv(full)
        steps.append(inv @ np.nan_to_num(np.asarray(grad, dtype=float)))
        ses.append(np.sqrt(np.clip(np.diag(inv), 0, None)))
        flags.append(bad)
    return pd.DataFrame({"step": steps, "se": ses, "singular": flags})


def fit_logistic(rows: DataFrame, k: int, l2: float = 0.0, penalise_first: bool = False, max_iter: int = 25, tol: float = 1e-9) -> DataFrame:
    """Coefficients per model by Newton steps.

    ``l2`` adds ``l2 / 2 * |b|^2`` (first coefficient free unless
    ``penalise_first``). Columns: model, beta, se, n, log_lik, null_log_lik,
    aic, iterations, converged. Separable unpenalised models do not converge and
    say so.
    """
    rows = cut(rows)
    # the expressions are built once; only the joined coefficients change per step
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    free = [0.0 if (i == 0 and not penalise_first) else float(l2) for i in range(k)]
    eta = F.expr(" + ".join(["o"] + [f"x[{i}] * beta[{i}]" for i in range(k)]))
    prob = F.expr("1.0D / (1.0D + exp(-_eta))")
    sums = [F.expr("first(beta) AS beta"), F.expr("sum(w) AS n"), F.expr("sum(w * y) AS _wy")]
    # log(1 + exp(eta)) without overflow
    sums.append(F.expr("sum(w * (y * _eta - greatest(_eta, 0.0D) - log1p(exp(-abs(_eta))))) AS log_lik"))
    sums += [F.expr(f"sum(w * (y - _p) * x[{i}]) AS g{i}") for i in range(k)]
    sums += [F.expr(f"sum(w * _p * (1.0D - _p) * x[{i}] * x[{j}]) AS h{i}_{j}") for i, j in pairs]
    g = F.expr("array(" + ", ".join(f"g{i} - {free[i]}D * beta[{i}]" for i in range(k)) + ")")
    h = F.expr("array(" + ", ".join(f"h{i}_{j}" + (f" + {free[i]}D" if i == j else "") for i, j in pairs) + ")")
    solved = _solve(h, g).alias("_r")
    moved = F.expr("aggregate(_r.step, 0.0D, (a, s) -> greatest(a, abs(s)))")
    # long steps are shortened so that separable models stay finite
    shorten = "least(1.0D, 5.0D / greatest(_moved, 1e-12D))"
    advance = F.expr(f"zip_with(beta, _r.step, (b, s) -> b + s * {shorten}) AS beta")

    models = cut(rows.select("model").distinct().withColumn("beta", F.array(*[F.lit(0.0)] * k)))
    hint = F.broadcast if bytes_of(models) <= BROADCAST_BYTES else (lambda t: t)
    beta = models
    for it in range(1, max_iter + 1):
        seen = rows.join(hint(beta), "model").withColumn("_eta", eta).withColumn("_p", prob)
        state = cut(seen.groupBy("model").agg(*sums).select("model", "beta", "n", "_wy", "log_lik", solved).withColumn("_moved", moved))
        largest = state.agg(F.max("_moved")).first()[0]
        if largest is None or largest < tol or it == max_iter:
            break
        beta = state.select("model", advance)
    rate = F.col("_wy") / F.col("n")
    null_ll = F.when((rate > 0) & (rate < 1), F.col("n") * (rate * F.log(rate) + (1 - rate) * F.log(1 - rate))).otherwise(0.0)
    return state.select(
        "model", "beta", F.col("_r.se").alias("se"), "n", "log_lik", null_ll.alias("null_log_lik"),
        (2.0 * k - 2.0 * F.col("log_lik")).alias("aic"), F.lit(it).alias("iterations"),
        ((F.col("_moved") < 1e-6) & ~F.col("_r.singular")).alias("converged"),
    )


def coefficient_table(fitted: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per (model, term): estimate, SE, odds ratio with 95 % limits, two-sided p."""
    idx = F.posexplode(F.arrays_zip(F.col("beta"), F.col("se"), F.array(*[F.lit(n) for n in names]).alias("term")))
    long = fitted.select("model", idx.alias("_i", "_s")).select("model", F.col("_s.term").alias("term"), F.col("_s.beta").alias("estimate"), F.col("_s.se").alias("se"))
    return long.select(
        "*", F.exp("estimate").alias("odds_ratio"), F.exp(F.col("estimate") - 1.96 * F.col("se")).alias("or_low"),
        F.exp(F.col("estimate") + 1.96 * F.col("se")).alias("or_high"), (F.col("estimate") / F.col("se")).alias("z"),
    ).withColumn("p", tails.norm_p("z"))


def score_rows(rows: DataFrame, fitted: DataFrame, k: int, keep: Sequence[str] = ()) -> DataFrame:
    """Probability of every row under its model; ``rows`` carries model and x."""
    beta = small(fitted.select("model", "beta"))
    eta = sum((F.col("x")[i] * F.col("beta")[i] for i in range(k)), F.lit(0.0))
    return rows.join(beta, "model").select("model", *keep, (1.0 / (1.0 + F.exp(-eta))).alias("probability"), eta.alias("score"))


def likelihood_ratio(base: DataFrame, full: DataFrame, extra: int) -> DataFrame:
    """2 (ll1 - ll0) against chi-square with ``extra`` df, and the AIC change, for one-row fits."""
    b = base.select(F.struct("log_lik", "aic").alias("b"))
    out = full.select("log_lik", "aic").withColumn("_b", b.scalar())
    out = out.select((2.0 * (F.col("log_lik") - F.col("_b.log_lik"))).alias("chi2"), (F.col("aic") - F.col("_b.aic")).alias("delta_aic"))
    return out.withColumn("df", F.lit(extra)).withColumn("p", tails.chi2_p("chi2", F.lit(float(extra))))


def calibration(df: DataFrame, groups: str, probability: str = "probability", y: str = "y") -> DataFrame:
    """Per group: slope and intercept of y on logit(p), and calibration-in-the-large with logit(p) as offset."""
    marked = df.withColumn("_l", logit(probability))
    line = fit_logistic(design(marked, ["_l"], groups, y), 2)
    level = fit_logistic(design(marked, [], groups, y, offset="_l"), 1)
    return line.select(F.col("model").alias(groups), F.col("beta")[0].alias("intercept"), F.col("beta")[1].alias("slope")).join(
        level.select(F.col("model").alias(groups), F.col("beta")[0].alias("in_the_large")), groups
    )


def fit_recalibration(train: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """One-row logistic fit of y on a score, to be applied to other cohorts."""
    return fit_logistic(design(train, [score], F.lit("recalibration"), y), 2)


def apply_recalibration(df: DataFrame, fitted: DataFrame, score: str = "score", out: str = "probability") -> DataFrame:
    b = fitted.select("beta").scalar()
    return df.withColumn("_b", b).withColumn(out, 1.0 / (1.0 + F.exp(-(F.col("_b")[0] + F.col("_b")[1] * F.col(score))))).drop("_b")
