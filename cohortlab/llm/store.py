"""Tables in the shared folder, and joins that broadcast only what was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlab.session import scratch_path

BROADCAST_BYTES = 32 << 20


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path: computed once, safe to read again after a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def measured(df: DataFrame, *wide: Column | str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its rows, 64 bytes each plus ``wide``, are proven to fit ``limit``. ``wide`` names text columns, or gives bytes."""
    extra = sum((F.coalesce(F.octet_length(c) if isinstance(c, str) else c, F.lit(0)) for c in wide), F.lit(0))
    size = df.agg(F.sum(F.lit(64) + extra)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def salted_join(rows: DataFrame, side: DataFrame, on: list[str], *wide: Column | str, salts: int = 16, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has each key once: by broadcast if ``side`` is measured small, else with every key
    spread over ``salts`` tasks, so that a key holding a third of ``rows`` is no single task."""
    small = measured(side, *wide)
    if small is not side:
        return rows.join(small, on, how)
    others = [c for c in rows.columns if c not in on]
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int") if others else F.lit(0))
    copies = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")
