"""Cell-level rollups: pseudobulk, composition, probe collapse, selection summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortlab.operators.running import quantiles


def pseudobulk(cells: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Per group and feature: cells, total, mean, median, expressing cells, detection fraction."""
    long = cells.select(*keys, *features).unpivot(list(keys), list(features), "feature", "count")
    group = [*keys, "feature"]
    stats = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("count").alias("total_count"), F.avg("count").alias("mean_expression"),
        F.count_if(F.col("count") > 0).alias("expressing_cells"), F.avg((F.col("count") > 0).cast("double")).alias("detection_fraction"),
    )
    return stats.join(quantiles(long, group, "count", {"median_expression": 0.5}), group)


def composition(cells: DataFrame, library: Sequence[str], cell_type: str) -> DataFrame:
    """Cells per (library, type) with the library total and percent. The total is a sum of the few type counts."""
    counts = cells.groupBy(*library, cell_type).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*library).agg(F.sum("n").alias("library_total"))
    return counts.join(totals, list(library)).withColumn("percent", 100.0 * F.col("n") / F.col("library_total"))


def best_probe(df: DataFrame, gene: str = "gene", probe: str = "probe", value: str = "value") -> DataFrame:
    """The probe with the largest mean per gene; ties go to the smaller probe id."""
    means = df.groupBy(gene, probe).agg(F.avg(value).alias("mean_value"))
    best = means.groupBy(gene).agg(F.min(F.struct((-F.col("mean_value")).alias("m"), F.col(probe).alias("p"))).alias("b"))
    return best.select(gene, F.col("b.p").alias(probe), (-F.col("b.m")).alias("mean_value"))


def probe_agreement(df: DataFrame, cohort: str, gene: str = "gene", probe: str = "probe", value: str = "value") -> DataFrame:
    """Whether cohorts choose the same probe for a gene: one row for each pair of cohorts (first < second by name) and gene both have.

    Each cohort's choice is its probe of largest mean, the smaller id on ties, by one grouped pass over all cohorts.
    """
    best = best_probe(df.withColumn("_g", F.struct(F.col(cohort).alias("c"), F.col(gene).alias("g"))), "_g", probe, value)
    best = best.select(F.col("_g.g").alias(gene), F.col("_g.c").alias("c"), F.col(probe).alias("p"), F.col("mean_value").alias("m"))
    # a gene has at most one row for each cohort, so its pairs are few
    cohorts = best.groupBy(gene).agg(F.array_sort(F.collect_list(F.struct("c", "p", "m"))).alias("a"))
    pairs = cohorts.select(gene, F.posexplode("a").alias("_i", "x"), "a").select(gene, "x", F.explode(F.slice("a", F.col("_i") + 2, F.size("a"))).alias("y"))
    return pairs.select(
        gene, F.col("x.c").alias("first"), F.col("y.c").alias("second"), F.col("x.p").alias("first_probe"), F.col("y.p").alias("second_probe"),
        (F.col("x.p") == F.col("y.p")).alias("same_probe"), F.col("x.m").alias("first_mean"), F.col("y.m").alias("second_mean"),
    )


def selection_summary(coefs: DataFrame, n_iterations: int, feature: str = "feature", coefficient: str = "coefficient", eps: float = 1e-10) -> DataFrame:
    """How often a feature was selected, its sign consistency and coefficient moments over selected iterations."""
    chosen = coefs.filter(F.abs(coefficient) > eps)
    c = F.col(coefficient)
    return chosen.groupBy(feature).agg(
        F.count(F.lit(1)).alias("n_selected"), (F.count(F.lit(1)) / F.lit(float(n_iterations))).alias("frequency"),
        F.count_if(c > 0).alias("n_positive"), F.count_if(c < 0).alias("n_negative"),
        (F.greatest(F.count_if(c > 0), F.count_if(c < 0)) / F.count(F.lit(1))).alias("sign_consistency"),
        F.avg(c).alias("mean_coefficient"), F.stddev_samp(c).alias("sd_coefficient"), F.avg(F.abs(c)).alias("mean_abs_coefficient"),
    )


def threshold_ladder(summary: DataFrame, thresholds: Sequence[float], frequency: str = "frequency") -> DataFrame:
    """Number of features at or above each frequency threshold, in one pass."""
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    return summary.select(frequency, steps.alias("threshold")).groupBy("threshold").agg(F.count_if(F.col(frequency) >= F.col("threshold")).alias("n_features"))
