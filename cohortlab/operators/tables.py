"""Curating and reshaping tables: alignment, audits of keys, pivots, catalogue counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.operators.running import quantiles
from cohortlab.session import settle, small


# ---- joins and alignment -------------------------------------------------

def align(measure: DataFrame, sample: DataFrame, on: str = "sample_id") -> DataFrame:
    """Measurements of samples that have metadata. The sample side is broadcast only if counted small."""
    return measure.join(small(sample), on, "inner")


def unmatched(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Ids present on one side only, with the side."""
    a, b = left.select(on).distinct(), right.select(on).distinct()
    only_left = a.join(b, on, "left_anti").withColumn("side", F.lit("left_only"))
    only_right = b.join(a, on, "left_anti").withColumn("side", F.lit("right_only"))
    return only_left.unionByName(only_right)


def require_matched(left: DataFrame, right: DataFrame, on: str) -> None:
    """Raise when any id is unmatched, naming a few."""
    bad = unmatched(left, right, on).limit(5).collect()
    if bad:
        raise ValueError(f"unmatched ids, for example {[tuple(r) for r in bad]}")


def keep_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Semi join on wanted keys."""
    return df.join(small(keys), on, "left_semi")


def merge_left(base: DataFrame, parts: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Left-join several per-key evidence tables onto ``base``."""
    return reduce(lambda a, b: a.join(b, on, "left"), parts, base)


def common_features(tables: Sequence[DataFrame], feature: str = "feature") -> DataFrame:
    """Features present in every cohort."""
    return reduce(lambda a, b: a.intersect(b), [t.select(feature).distinct() for t in tables])


# ---- cleaning ------------------------------------------------------------

def impute_median(df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Null values get their feature's exact median; features with no value at all are dropped."""
    med = settle(quantiles(df, [feature], value, {"_median": 0.5}))
    return df.join(med, feature).withColumn(value, F.coalesce(value, "_median")).drop("_median")


def log2_if_large(df: DataFrame, value: str = "value", limit: float = 50.0) -> DataFrame:
    """``log2(x+1)`` when the largest value exceeds ``limit``, else unchanged."""
    df = df.withColumn("_max", df.agg(F.max(value)).scalar())
    return df.withColumn(value, F.when(F.col("_max") > limit, F.log2(F.col(value) + 1.0)).otherwise(F.col(value))).drop("_max")


def string_roles(df: DataFrame, id_prefix: str, outcome_regex: str) -> DataFrame:
    """Per string column: share of values with ``id_prefix`` and whether the name looks like an outcome."""
    cols = [n for n, t in df.dtypes if t == "string"]
    shares = df.agg(*[F.avg(F.startswith(F.col(c), F.lit(id_prefix)).cast("int")).alias(c) for c in cols])
    long = shares.unpivot([], cols, "column_name", "id_share")
    return long.withColumn("looks_like_outcome", F.lower("column_name").rlike(outcome_regex))


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count per column in one pass."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], cols, "column_name", "n_missing")


# ---- reshape -------------------------------------------------------------

def pivot_wide(df: DataFrame, index: Sequence[str] | str, key: str, value: str, keys: Sequence) -> DataFrame:
    """Long to wide for a known list of column keys; ``value`` must be unique per cell."""
    index = [index] if isinstance(index, str) else list(index)
    return df.groupBy(*index).pivot(key, list(keys)).agg(F.max(value))


def crosstab(df: DataFrame, row: str, col: str, levels: Sequence) -> DataFrame:
    """Counts of ``row`` by ``col`` level with zeros filled in."""
    counts = df.groupBy(row).agg(*[F.count_if(F.col(col) == F.lit(v)).alias(f"{col}_{v}") for v in levels])
    return counts


def one_hot(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """0/1 columns for every level but the first in sorted order."""
    return df.select("*", *[F.when(F.col(col) == v, 1).otherwise(0).alias(f"{col}_{v}") for v in sorted(levels)[1:]])


def explode_list(df: DataFrame, col: str, out: str, sep: str = ",") -> DataFrame:
    """One row per trimmed, non-empty item of a delimited cell."""
    item = F.explode(F.split(F.col(col), sep))
    return df.withColumn(out, item).withColumn(out, F.trim(out)).filter(F.col(out) != "")


def split_fraction(c: str) -> tuple[Column, Column]:
    """``k/n`` text to two integers."""
    parts = F.split(F.col(c), "/")
    return F.get(parts, F.lit(0)).cast("bigint"), F.get(parts, F.lit(1)).cast("bigint")


# ---- counts and key audits ----------------------------------------------

def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Counts including nulls, most frequent first; a top-k report when ``top`` is given."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)
    return counts.limit(top) if top else counts


def field_sizes(df: DataFrame, by: str, fields: Sequence[str]) -> DataFrame:
    """Long audit table (by, field, value, n) over several metadata fields, nulls as MISSING."""
    cast = df.select(by, *[F.coalesce(F.col(f).cast("string"), F.lit("MISSING")).alias(f) for f in fields])
    return cast.unpivot([by], list(fields), "field", "value").groupBy(by, "field", "value").agg(F.count(F.lit(1)).alias("n"))


def joined_values(df: DataFrame, keys: Sequence[str], col: str, out: str, sep: str = "; ") -> DataFrame:
    """Distinct values per key in one sorted text cell. Duplicates go before the values meet."""
    distinct = df.select(*keys, col).filter(F.col(col).isNotNull()).distinct()
    return distinct.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.col(col).cast("string"))), sep).alias(out))


def mean_collapse(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean over duplicate keys."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def subject_profile(df: DataFrame, subject: str, region: str, outcome: str, max_regions: int = 4) -> DataFrame:
    """Per subject: samples, regions, classes, and flags for contradicted outcome or too many regions."""
    return df.groupBy(subject).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_distinct(region).alias("n_regions"),
        F.count_distinct(outcome).alias("n_classes"),
    ).select(
        "*",
        (F.col("n_classes") > 1).alias("contradicted"),
        (F.col("n_regions") > max_regions).alias("too_many_regions"),
    )


def stack_cohorts(tables: dict[str, DataFrame], order: Sequence[str], tag: str = "dataset") -> DataFrame:
    """Union of cohorts with a tag; ``order`` names the columns that identify a row."""
    parts = [t.withColumn(tag, F.lit(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def set_difference(df: DataFrame, group: str, levels: tuple, fields: Sequence[str]) -> DataFrame:
    """Per field: do both group levels hold the same set of values? Compared value by value, no set is collected."""
    a, b = levels
    cast = df.filter(F.col(group).isin(a, b)).select(
        group, *[F.coalesce(F.col(f).cast("string"), F.lit("MISSING")).alias(f) for f in fields]
    )
    seen = cast.unpivot([group], list(fields), "field", "value").groupBy("field", "value").agg(
        F.max((F.col(group) == F.lit(a)).cast("int")).alias("in_a"),
        F.max((F.col(group) == F.lit(b)).cast("int")).alias("in_b"),
    )
    return seen.groupBy("field").agg(
        F.sum("in_a").alias("n_values_a"),
        F.sum("in_b").alias("n_values_b"),
        F.sum(F.col("in_a") * F.col("in_b")).alias("n_shared"),
        (F.min(F.col("in_a") * F.col("in_b")) == 0).alias("differs"),
    )


# ---- ranks over result tables -------------------------------------------

def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key. ``row_number <= k`` prunes before the shuffle (group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
