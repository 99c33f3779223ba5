"""Deterministic pseudo-random integers in plain BIGINT arithmetic.

The same text runs in Spark and in any ANSI engine with 64-bit integers, so
splits, folds, bootstrap draws and permutations can be replayed elsewhere.
Operands stay below 2^31 and squares below 2^62.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: Mersenne prime 2^31 - 1 and three published LCG multipliers
MODULUS = 2147483647
ID_STEP = 48271
REP_STEP = 69621
SEED_STEP = 40692
SHIFT = 1013904223


def phash_sql(key: str, rep: str = "0", seed: int = 42) -> str:
    """SQL text of a hash of (key, rep, seed) in [0, MODULUS)."""
    start = (
        f"((({key}) % {MODULUS}) * {ID_STEP} + ({rep}) * {REP_STEP} "
        f"+ {seed * SEED_STEP + 12345}) % {MODULUS}"
    )
    for shift in (SHIFT, SHIFT + seed + 1):
        start = f"(({start}) * ({start}) + {shift}) % {MODULUS}"
    return f"({start})"


def phash(key: str, rep: str = "CAST(0 AS BIGINT)", seed: int = 42) -> Column:
    """Column form of :func:`phash_sql`; ``key`` and ``rep`` are SQL expressions of BIGINT type."""
    return F.expr(phash_sql(f"CAST({key} AS BIGINT)", f"CAST({rep} AS BIGINT)", seed))
