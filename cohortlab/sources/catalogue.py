"""Profiles over many tables and evidence collected from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

# fixed values: name fragments that mark a table's role, first match wins
ROLE_WORDS = (
    ("EFFECT_OR_DE_FILE", ("coefficient", "effect", "cohen", "differential", "deg", "limma", "de_result", "statistics")),
    ("MODEL_FILE", ("prediction", "probability", "model", "random_forest", "xgboost", "lasso")),
    ("METADATA_FILE", ("meta", "metadata", "phenotype", "clinical", "covariate")),
)
# fixed values: column-name fragments of an outcome
OUTCOME_WORDS = ("diagnosis", "diagnose", "condition", "group", "status", "phenotype", "disease")


def table_role(name: str, columns: Sequence[str], wanted: Sequence[str]) -> str:
    """Role from the table name, else from whether a wanted column is present."""
    low = name.lower()
    for role, words in ROLE_WORDS:
        if any(w in low for w in words):
            return role
    present = {c.strip().upper() for c in columns}
    return "EXPRESSION_FILE" if any(w.upper() in present for w in wanted) else "OTHER"


def profile_tables(tables: dict[str, DataFrame], wanted: Sequence[str]) -> DataFrame:
    """One row per table: rows, columns, which wanted and outcome-like columns it has, its role."""
    parts = []
    for name, df in tables.items():
        upper = {c.strip().upper(): c for c in df.columns}
        found = [upper[w.upper()] for w in wanted if w.upper() in upper]
        outcome = [c for c in df.columns if any(w in c.lower() for w in OUTCOME_WORDS)]
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
            F.lit(",".join(found)).alias("wanted_found"), F.lit(",".join(outcome)).alias("outcome_columns"),
            F.lit(table_role(name, df.columns, wanted)).alias("role"),
        ))
    return reduce(lambda a, b: a.unionByName(b), parts)


def profile_summary(profile: DataFrame) -> DataFrame:
    """Tables and rows per role, and how many hold a wanted column."""
    return profile.groupBy("role").agg(
        F.count(F.lit(1)).alias("n_tables"), F.sum("n_rows").alias("n_rows"), F.count_if(F.col("wanted_found") != "").alias("n_with_wanted")
    )


def collect_evidence(tables: dict[str, tuple[DataFrame, str]], keys: Sequence[str]) -> DataFrame:
    """Rows whose key column (upper-cased, trimmed) is wanted, from differing tables, tagged with their source.

    ``tables`` maps a source name to (table, key column). Each filter stays on its own scan.
    """
    wanted = [k.strip().upper() for k in keys]
    parts = []
    for name, (df, col) in tables.items():
        key = F.upper(F.trim(F.col(col).cast("string")))
        hit = df.filter(key.isin(wanted)).withColumn("evidence_key", key)
        hit = hit.drop(col) if col != "evidence_key" else hit
        parts.append(hit.withColumn("source_table", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
