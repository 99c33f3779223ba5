"""Threshold-scaled document fingerprints, with DataFrame functions only.

A fingerprint keeps every hash of a shingle of ``shingle`` words that is among the lowest 1/``scale`` of all 64-bit
values, so a longer document has a longer fingerprint, the fingerprint of two texts together is the
union of theirs cut at the same threshold, and the share of one in another estimates containment even between very
unequal texts. If no hash of a text is that low its smallest hash stands alone, so only a text without words
has the empty fingerprint.

Words are runs outside space and 0x09-0x0D, unchanged; fewer than ``shingle`` words are one shingle. Likeness is the
Jaccard similarity of two fingerprints, 1 if both are empty. A fingerprint is written as its sorted hashes in hexadecimal, 16 digits each.

The next document in ascending id order is found with a window inside id ranges. The ranges come from quantiles of the
ids, and the first row of a range is also given to the range before it (that of the first range to the
last), so no task sees more than one range and the texts are shuffled once. Rows with equal ids follow each other by text.
Null ids come first but are never anyone's wrap-around; null texts are empty. Every input row gives one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SHINGLE = 5
SCALE = 8
RANGE_ROWS = 1000
MOST_RANGES = 5000
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
LOWEST = -(1 << 63)


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted array of the hashes that a text's fingerprint keeps."""
    limit = F.lit(LOWEST + (1 << 64) // scale)

    def kept(words: Column) -> Column:
        n = F.size(words)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - shingle + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, shingle)))
        return F.when(n > 0, many).otherwise(F.array().cast("array<bigint>"))

    def low(hashes: Column) -> Column:
        few = F.filter(hashes, lambda h: h < limit)
        return F.when((F.size(few) > 0) | (F.size(hashes) == 0), F.array_sort(F.array_distinct(few))).otherwise(F.array(F.array_min(hashes)))

    # one-element arrays name a value, so that it is computed once for all its uses
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.transform(F.transform(F.array(words), kept), low)[0]


def written_out(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def range_limits(ids: DataFrame, column: str, range_rows: int) -> list[int]:
    """The smallest id of each range: ids that occur, about ``range_rows`` rows apart, farther where that would be more than MOST_RANGES ranges.

    One value for each range reaches the driver and stands in the plan; a longer range is a longer sort, which may spill.
    """
    rows = ids.select(F.col(column).cast("bigint").alias("id")).filter("id IS NOT NULL")
    n = rows.count()
    ranges = min(MOST_RANGES, max(1, n // range_rows))
    if not n:
        return []
    if ranges == 1:
        return [rows.agg(F.min("id")).first()[0]]
    cuts = sorted({int(x) for x in rows.approxQuantile("id", [k / ranges for k in range(ranges)], 0.2 / ranges)})
    firsts = rows.groupBy(place(F.col("id"), cuts).alias("p")).agg(F.min("id").alias("id"))
    return sorted(r["id"] for r in firsts.collect())


def place(value: Column, limits: list[int]) -> Column:
    """Number of the range that holds ``value``, by binary search; 0 for null and for values below all limits."""
    steps = max(1, len(limits).bit_length())
    sorted_limits = F.lit(limits)

    def halve(width: Column, low: Column) -> Column:
        at = low + width
        return F.when((at < len(limits)) & (F.get(sorted_limits, at) <= value), at).otherwise(low)

    low = F.lit(0)
    widths = F.lit([1 << k for k in reversed(range(steps))])
    return F.coalesce(F.aggregate(widths, low, lambda found, width: halve(width, found)), F.lit(0))


def with_next(docs: DataFrame, limits: list[int], *columns: str) -> DataFrame:
    """``docs`` with next_<column> from the next row in ascending doc_id order; the last row is followed by the first with an id."""
    last = max(0, len(limits) - 1)
    home = docs.withColumn("_range", place(F.col("doc_id"), limits) if limits else F.lit(0))
    first = F.get(F.lit(limits or [0]), F.col("_range")) == F.col("doc_id")
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("copy"))
    before = F.struct(F.when(F.col("_range") == 0, F.lit(last)).otherwise(F.col("_range") - 1).alias("range"), F.lit(True).alias("copy"))
    rows = home.withColumn("_at", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own)))).withColumn("_copy", F.col("_at.copy")).withColumn("_range", F.col("_at.range")).drop("_at")
    order = Window.partitionBy("_range").orderBy("_copy", F.col("doc_id").asc_nulls_first(), "text")
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.filter("NOT _copy").drop("_copy", "_range")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_edited (share of the text's shingles in the edited text) and contained_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document.
    """
    limits = range_limits(docs, "doc_id", range_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("kept", sketch(F.col("text"), shingle, scale))
    near = with_next(rows, limits, "text", "kept")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    none = F.array().cast("array<bigint>")
    made = near.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "kept", F.coalesce("next_kept", none).alias("next_kept"))
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "kept", "next_kept", sketch(F.col("edited"), shingle, scale).alias("other"))
    kept, other, following = F.col("kept"), F.col("other"), F.col("next_kept")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", written_out(kept).alias("fingerprint"), written_out(other).alias("edited_fingerprint"), likeness(kept, other).alias("near_edited"),
        likeness(kept, following).alias("near_next"), containment(kept, other).alias("contained_edited"), containment(kept, following).alias("contained_next"),
    )
