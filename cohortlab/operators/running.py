"""Ordered totals, ranks and exact quantiles that do not put a group in one task.

A plain ``Window.partitionBy(key).orderBy(value)`` sends every row of a key to
one task. That plan is kept only when a count proves every key short
(:func:`wide`). Otherwise rows are collapsed to distinct (key, value), then cut
into value ranges. Range limits are a deterministic sample of the values: per hash
bin the smallest hash wins, so re-running a lost task gives the same limits.
Running totals are taken inside each (key, range), starting from a carry row with
the totals of the ranges before it. A key with a third of all rows is spread over about a
third of the ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.session import bytes_of, fixed

SAMPLE_FACTOR = 16
FAN = 16
WIDE_ROWS = 2_000_000
RANGE_ROWS = 1_000_000
HUBS = 1000
LOOKUP_BYTES = 32 << 20


def wide(df: DataFrame, keys: Sequence[str]) -> bool:
    """True when some key holds more than WIDE_ROWS rows. One map-side combined count."""
    return df.groupBy(*keys).count().filter(F.col("count") > WIDE_ROWS).limit(1).count() > 0


def ready(df: DataFrame, keys: Sequence[str], spread: bool | None) -> tuple[DataFrame, bool]:
    """Rows safe to be read twice, and whether keys must be split."""
    if spread is False:
        return df, False
    df = fixed(df)
    return df, wide(df, keys) if spread is None else spread


def tally(df: DataFrame, keys: Sequence[str], order: str, **sums: Column | str) -> DataFrame:
    """Distinct (keys, order) with summed measures; map-side combined before the shuffle."""
    cols = [F.sum(c if isinstance(c, Column) else F.col(c)).alias(n) for n, c in sums.items()]
    return df.groupBy(*keys, order).agg(*cols)


def fan_of(n: int) -> int:
    """Square root of the number of ranges for ``n`` rows: about RANGE_ROWS rows a range, however many rows there are."""
    return max(FAN, math.isqrt(n // RANGE_ROWS) + 1)


def _limits(df: DataFrame, keys: Sequence[str], order: str, fan: int) -> DataFrame:
    """One row: fan*fan-way range limits as an array of arrays, from a sample that grows with the number of ranges."""
    mark = F.xxhash64(*keys, order)
    picked = (
        df.select(mark.alias("_h"), F.col(order).alias("_v"))
        .groupBy(F.pmod("_h", F.lit(SAMPLE_FACTOR * fan * fan)).alias("_bin"))
        .agg(F.min_by("_v", "_h").alias("_v"))
    )
    ordered = picked.agg(F.sort_array(F.collect_list("_v")).alias("_a"))
    size = F.size("_a")

    def point(i: Column) -> Column:
        at = F.floor(i * size / F.lit(fan * fan)).cast("int")
        return F.get(F.col("_a"), F.least(at, size - 1))

    fine = F.transform(
        F.sequence(F.lit(0), F.lit(fan - 1)),
        lambda c: F.transform(F.sequence(F.lit(1), F.lit(fan - 1)), lambda f: point(c * fan + f)),
    )
    coarse = F.transform(F.sequence(F.lit(1), F.lit(fan - 1)), lambda c: point(c * fan))
    return ordered.select(F.struct(coarse.alias("coarse"), fine.alias("fine")).alias("_limits"))


def _with_range(df: DataFrame, limits: DataFrame, order: str, fan: int) -> DataFrame:
    """Add ``_range``; it grows with ``order``. Limits arrive as a scalar subquery."""
    df = df.withColumn("_limits", limits.scalar())
    coarse = F.size(F.filter(F.col("_limits.coarse"), lambda b: b < F.col(order)))
    df = df.withColumn("_coarse", coarse)
    inner = F.get(F.col("_limits.fine"), F.col("_coarse"))
    fine = F.size(F.filter(inner, lambda b: b < F.col(order)))
    return df.withColumn("_range", F.col("_coarse") * fan + F.greatest(fine, F.lit(0))).drop(
        "_limits", "_coarse"
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str] = (),
    mins: Sequence[str] = (),
    descending: bool = False,
    spread: bool | None = None,
    totals: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive ``cum_<c>`` per key along ``order``; (keys, order) must be unique.

    ``totals`` (a subset of ``sums``) also adds ``tot_<c>``, the sum over the key.
    ``spread=None`` lets :func:`wide` decide; ``spread=False`` is for keys whose
    length is bounded by construction: a single window per key.
    """
    keys = list(keys)
    df, spread = ready(df, keys, spread)
    fns = [(c, F.sum) for c in sums] + [(c, F.min) for c in mins]
    along = F.col(order).desc() if descending else F.col(order).asc()
    rows = (Window.unboundedPreceding, Window.currentRow)
    if not spread:
        w = Window.partitionBy(*keys).orderBy(along).rowsBetween(*rows)
        all_of = Window.partitionBy(*keys)
        return df.select("*", *[fn(c).over(w).alias(f"cum_{c}") for c, fn in fns], *[F.sum(c).over(all_of).alias(f"tot_{c}") for c in totals])

    fan = fan_of(df.count())
    ranged = _with_range(df, _limits(df, keys, order, fan), order, fan)
    # one carry row per (key, range), at most fan * fan per key, holds what the ranges before it add up to
    toward = F.col("_range").desc() if descending else F.col("_range").asc()
    before = Window.partitionBy(*keys).orderBy(toward).rowsBetween(Window.unboundedPreceding, -1)
    per_range = ranged.groupBy(*keys, "_range").agg(*[fn(c).alias(c) for c, fn in fns])
    carry = per_range.select(
        *keys, "_range", F.lit(0).alias("_real"), *[fn(c).over(before).alias(f"_w_{c}") for c, fn in fns],
        *[F.sum(c).over(Window.partitionBy(*keys)).alias(f"_t_{c}") for c in totals],
    )
    body = ranged.select("*", F.lit(1).alias("_real"), *[F.col(c).alias(f"_w_{c}") for c, _ in fns])
    # the carry row sorts first in its range, so the window adds it without a join
    inside = Window.partitionBy(*keys, "_range").orderBy("_real", along).rowsBetween(*rows)
    done = body.unionByName(carry, allowMissingColumns=True).select(
        *df.columns, "_real", *[fn(f"_w_{c}").over(inside).alias(f"cum_{c}") for c, fn in fns],
        *[F.max(f"_t_{c}").over(inside).alias(f"tot_{c}") for c in totals],
    )
    return done.filter(F.col("_real") == 1).drop("_real")


def looked_up(df: DataFrame, table: DataFrame, keys: Sequence[str], size: str, inner: bool = False) -> DataFrame:
    """``df`` with the columns of ``table``, which has each of ``keys`` once, and with the number of rows of ``df`` that have it as ``size``.

    By broadcast where the table is measured small. Else keys that more than one in ``HUBS`` rows have are looked up by broadcast (there are fewer
    than ``HUBS`` of them whatever the data) and the others by a shuffle, so no key is a large part of one task. A null key finds nothing.
    """
    keys = list(keys)
    how = "inner" if inner else "left"
    found = table.drop(size)
    if bytes_of(found) <= LOOKUP_BYTES:
        return df.join(F.broadcast(found), keys, how)
    total = table.agg(F.sum(size).alias("t"))
    sized = table.withColumn("_hot", F.col(size).cast("double") * HUBS > total.scalar())
    hot, cold = sized.filter("_hot").drop(size), sized.filter("NOT _hot").drop(size, "_hot")
    marked = df.join(F.broadcast(hot), keys, "left")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    parts = marked.filter("_hot").drop("_hot").unionByName(marked.filter(F.col("_hot").isNull() & known).select(*df.columns).join(cold, keys, how))
    return parts if inner else parts.unionByName(marked.filter(~known).drop("_hot"))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", spread: bool | None = None) -> DataFrame:
    """Distinct (keys, value) with its count ``n`` and mid-rank; nulls get no rank."""
    known, spread = ready(df.filter(F.col(value).isNotNull()), keys, spread)
    base = tally(known, keys, value, n=F.lit(1))
    ranked = running(base, keys, value, sums=["n"], spread=spread)
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
    return ranked.select(*keys, value, "n", rank.alias(out))


def with_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, spread: bool | None = None) -> DataFrame:
    """Row-level mid-rank: ranks of distinct values looked up by (keys, value), also where one value is most of the rows."""
    df = fixed(df)
    return looked_up(df, average_rank(df, keys, value, out, spread), [*keys, value], "n")


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, out: str = "pos", descending: bool = False, spread: bool | None = None) -> DataFrame:
    """0-based position along a unique ``order``."""
    marked = df.withColumn("_one", F.lit(1).cast("bigint"))
    done = running(marked, keys, order, sums=["_one"], descending=descending, spread=spread)
    return done.withColumn(out, F.col("cum__one") - 1).drop("cum__one", "_one")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    spread: bool | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles (position (n-1)p), one column per entry of ``probs``."""
    keys = list(keys)
    known, spread = ready(df.filter(F.col(value).isNotNull()), keys, spread)
    base = tally(known, keys, value, n=F.lit(1))
    placed = running(base, keys, value, sums=["n"], spread=spread, totals=["n"]).withColumnRenamed("tot_n", "_total")
    aggs = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("cum_n") - F.col("n") <= pos) & (pos < F.col("cum_n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{name}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_frac_{name}"))
    picked = placed.groupBy(*keys).agg(*aggs)
    return picked.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_frac_{n}")).alias(n)
            for n in probs
        ],
    )


def descending_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", spread: bool | None = None) -> DataFrame:
    """Distinct (keys, value) with its count ``n`` and its rank from the top, ties sharing the smallest rank."""
    known, spread = ready(df.filter(F.col(value).isNotNull()), keys, spread)
    base = tally(known, keys, value, n=F.lit(1).cast("bigint"))
    ranked = running(base, keys, value, sums=["n"], descending=True, spread=spread)
    return ranked.select(*keys, value, "n", (F.col("cum_n") - F.col("n") + 1).alias(out))


def with_descending_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", spread: bool | None = None) -> DataFrame:
    """Rows with their descending rank; a null value has no rank."""
    df = fixed(df)
    return looked_up(df, descending_rank(df, keys, value, out, spread), [*keys, value], "n")
