"""Session-level helpers: shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    the setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured is not None:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="cohortlab-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is written yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _width(field: T.StructField, of: Column) -> Column:
    """Bytes of one value, about."""
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        own = F.octet_length(of)
    elif isinstance(kind, T.ArrayType):
        own = F.size(of) * (8 if isinstance(kind.elementType, T.NumericType) else 64)
    elif isinstance(kind, T.MapType):
        own = F.size(of) * 64
    elif isinstance(kind, T.StructType):
        own = sum((_width(f, of[f.name]) for f in kind.fields), F.lit(8))
    else:
        own = F.lit(8)
    return F.greatest(F.coalesce(own, F.lit(0)), F.lit(0)).cast("bigint")


def bytes_of(df: DataFrame) -> int:
    """About how many bytes ``df`` takes as a broadcast: its values and 32 for each row, by one aggregate."""
    row = sum((_width(f, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(32).cast("bigint"))
    return df.agg(F.sum(row)).first()[0] or 0


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when ``df`` is measured to fit ``limit`` bytes.

    ``df`` should be cheap to read: a cut table, a dimension, a few rows. A larger side is returned unhinted and the join shuffles on its key.
    """
    return F.broadcast(df) if bytes_of(df) <= limit else df


def settle(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Compute a parameter table once, then treat it as ``small`` does."""
    return small(cut(df), limit)


def fixed(df: DataFrame) -> DataFrame:
    """One materialised copy when ``df`` holds grouped values, else ``df`` itself.

    A floating sum can differ in its last bits when its tasks run in another
    order, so a value that is read twice (joined on, or compared with limits
    taken from itself) must not be recomputed. Row-wise values cannot differ.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return cut(df) if "Aggregate" in plan else df
