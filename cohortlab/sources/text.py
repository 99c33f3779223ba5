"""Readers for delimited matrices, attribute blocks and series-style files; table sinks.

Files are read as text lines (or as blocks with a custom separator) and split
into long tables. Wanted keys are tested on the raw line before it is split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cohortlab.functions.scalars import to_number
from cohortlab.session import small


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", partitions: int | None = None) -> DataFrame:
    """Delimited file with a header and an explicit schema. Gzip is one split: give ``partitions`` to spread it."""
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, mode="PERMISSIVE")
    return df.repartition(partitions) if partitions else df


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), '^"|"$', "")


def _fields(c: str, sep: str) -> Column:
    return F.transform(F.split(F.col(c), _literal(sep)), _unquoted)


def _literal(text: str) -> str:
    """A pattern that matches ``text`` itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines and the file each comes from."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("_file"))


def _long(lines: DataFrame, header: DataFrame, sep: str, row: str, col: str) -> DataFrame:
    """Data lines times the names in their own file's header (columns ``h``, ``_file``).

    If one file alone has a header, it is that of all: it arrives as a one-row scalar and nothing is
    joined. Otherwise headers are joined by file, and a file without one is an error.
    """
    found = header.limit(2).collect()
    if not found:
        raise ValueError("no header line found")
    if len(found) == 1:
        marked = lines.withColumn("_h", lines.sparkSession.createDataFrame([(list(found[0]["h"]),)], "h array<string>").scalar())
    else:
        heads = small(header.groupBy("_file").agg(F.first("h").alias("_h")))
        missing = F.raise_error(F.concat(F.lit("no header line in "), F.col("_file"))).cast("array<string>")
        marked = lines.join(heads, "_file", "left").withColumn("_h", F.coalesce("_h", missing))
    marked = marked.withColumn("_f", _fields("line", sep))
    cells = marked.select(F.get("_f", F.lit(0)).alias(row), "_h", F.posexplode(F.slice("_f", 2, 1 << 30)).alias("_p", "_v"))
    return cells.select(row, F.get("_h", F.col("_p") + 1).alias(col), to_number("_v").alias("value"))


def read_matrix_long(spark: SparkSession, path: str, orientation: str = "features_in_rows", sep: str = ",", header_key: str | None = None, keys: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Matrix file to (sample_id, feature, value) in either orientation.

    The header is the line whose first field is ``header_key``. Cells that are not
    finite numbers become null. With ``keys``, other rows are dropped before splitting.
    """
    lines = _lines(spark, path)
    if partitions:
        lines = lines.repartition(partitions)
    first = _unquoted(F.substring_index("line", sep, 1))
    marker = first == F.lit(header_key if header_key is not None else "")
    header = lines.filter(marker).select(_fields("line", sep).alias("h"), "_file")
    body = lines.filter(~marker & (F.trim("line") != ""))
    if keys is not None:
        body = body.filter(first.isin(list(keys)))
    row, col = ("feature", "sample_id") if orientation == "features_in_rows" else ("sample_id", "feature")
    return _long(body, header, sep, row, col).select("sample_id", "feature", "value")


def widen_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], key: str = "feature") -> DataFrame:
    """Narrow wide table to long, null cells kept, text coerced to numbers."""
    cast = df.select(*ids, *[to_number(c).alias(c) for c in values])
    return cast.unpivot(list(ids), list(values), key, "value")


def read_blocks(spark: SparkSession, path: str, block_prefix: str = "^SAMPLE = ", key_prefix: str = "!Sample_", repeat: str = "list") -> DataFrame:
    """Attribute blocks to (sample_id, key, value).

    A repeated key gives one joined value (``join``, with " | "), the final one
    (``last``), or one row each with its position (``list``).
    """
    blocks = spark.read.option("lineSep", block_prefix).text(path)
    named = blocks.select(F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1)).alias("sample_id"), F.split("value", r"\r?\n").alias("_l"))
    lines = named.filter(F.exists("_l", lambda x: x.startswith(key_prefix))).select("sample_id", F.posexplode("_l").alias("_p", "line"))
    pairs = lines.filter(F.col("line").startswith(key_prefix)).select(
        "sample_id", F.trim(F.regexp_extract("line", f"^{_literal(key_prefix)}([^=]*?) *=", 1)).alias("key"), "_p",
        F.trim(F.regexp_extract("line", "^[^=]*=(.*)$", 1)).alias("value"),
    )
    grouped = pairs.groupBy("sample_id", "key")
    if repeat == "last":
        return grouped.agg(F.max_by("value", "_p").alias("value"))
    listed = grouped.agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "value"))), lambda s: s["value"]).alias("_v"))
    if repeat == "join":
        return listed.select("sample_id", "key", F.array_join("_v", " | ").alias("value"))
    if repeat == "list":
        return listed.select("sample_id", "key", F.posexplode("_v").alias("pos", "value"))
    raise ValueError(f"unknown repeat {repeat!r}")


def read_header_rows(spark: SparkSession, path: str, prefix: str = "!Sample_", content: dict[str, str] | None = None) -> DataFrame:
    """Series header rows to one row per sample column: (pos, key, value) in long form.

    ``content`` names rows of a repeated key by the start of their values, for
    example ``{"age": "age:"}``; such rows take that name as key.
    """
    rows = spark.read.text(path).filter(F.col("value").startswith(prefix)).withColumn("_f", _fields("value", "\t"))
    key = F.substring(F.get("_f", F.lit(0)), len(prefix) + 1, 1 << 20)
    for name, start in (content or {}).items():
        key = F.when(F.lower(F.get("_f", F.lit(1))).startswith(start.lower()), name).otherwise(key)
    return rows.select(key.alias("key"), F.posexplode(F.slice("_f", 2, 1 << 30)).alias("pos", "value"))


def header_table(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per sample column with the chosen header keys as columns."""
    return long.filter(F.col("key").isin(list(keys))).groupBy("pos").pivot("key", list(keys)).agg(F.max("value"))


def read_table_block(spark: SparkSession, path: str, keys: Sequence[str] | None = None, header_key: str = "ID_REF") -> DataFrame:
    """Embedded table of a series file to (sample_id, feature, value); lines starting with ``!`` are not part of it."""
    lines = _lines(spark, path).filter(~F.col("line").startswith("!") & (F.trim("line") != ""))
    first = _unquoted(F.substring_index("line", "\t", 1))
    header = lines.filter(first == header_key).select(_fields("line", "\t").alias("h"), "_file")
    body = lines.filter(first != header_key)
    if keys is not None:
        body = body.filter(first.isin(list(keys)))
    return _long(body, header, "\t", "feature", "sample_id").select("sample_id", "feature", "value")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """CSV (with header), JSON or Parquet; one file per partition."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, header=True)
    elif fmt in ("json", "parquet"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
