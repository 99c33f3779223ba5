"""Column expressions for curating ids, labels, covariates and effect sizes.

Every function takes a column (or its name) and returns a Column; all of them
are built-in expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

DAYS_PER_YEAR = 365.25


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_sample_id(c) -> Column:
    """Cut at the first underscore, drop a ``.CEL``/``.CEL.gz`` suffix in any case, trim."""
    return F.trim(F.regexp_replace(F.substring_index(_c(c), "_", 1), r"(?i)\.cel(\.gz)?$", ""))


def first_match(c, patterns: Sequence[str], group: int = 1) -> Column:
    """Capture group of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_c(c), p, group), F.lit("")) for p in patterns])


def keyword_category(c, rules: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """Category of the first rule one of whose keywords occurs in the lower-cased text."""
    low = F.lower(_c(c))

    def any_of(words):
        return reduce(lambda a, b: a | b, [low.contains(w) for w in words])

    chain = F.when(any_of(rules[0][1]), rules[0][0])
    for name, words in rules[1:]:
        chain = chain.when(any_of(words), name)
    return chain.otherwise(F.lit(default))


def map_label(c, mapping: dict[str, int], strict: bool = False) -> Column:
    """Trimmed, lower-cased label to its code; unknown becomes null, or raises when ``strict``."""
    low = F.lower(F.trim(_c(c)))
    pairs = [F.lit(x) for kv in mapping.items() for x in (kv[0].lower(), kv[1])]
    code = F.try_element_at(F.create_map(*pairs), low)
    if strict:
        return F.when(code.isNull() & low.isNotNull(), F.raise_error(F.concat(F.lit("unknown label: "), low)).cast("int")).otherwise(code)
    return code


def strip_prefix(c, prefix: str) -> Column:
    """Drop a ``prefix`` such as ``status:`` (any case), then trim and lower."""
    return F.lower(F.trim(F.regexp_replace(F.trim(_c(c)), f"(?i)^{prefix}", "")))


def number_in(c) -> Column:
    """First decimal number inside a text."""
    return F.nullif(F.regexp_extract(_c(c), r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def years_from_text(c) -> Column:
    """``85 days`` to years by 365.25; other units are taken as years."""
    days = F.lower(_c(c)).contains("day")
    return F.when(days, number_in(c) / F.lit(DAYS_PER_YEAR)).otherwise(number_in(c))


def to_number(c) -> Column:
    """Numeric or null; infinities and NaN become null."""
    x = _c(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def or_missing(c, token: str = "MISSING") -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(token))


def id_number(c) -> Column:
    """Trailing digits of an id."""
    return F.nullif(F.regexp_extract(_c(c), r"(\d+)$", 1), F.lit("")).cast("bigint")


def id_block(c, threshold: int, low: str, high: str) -> Column:
    return F.when(id_number(c) < threshold, low).otherwise(high)


def composite_key(*cols, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[_c(c).cast("string") for c in cols])


def last_tokens(c, n: int = 2, sep: str = "_") -> Column:
    return F.substring_index(_c(c), sep, -n)


def parse_stamp(c, fmt: str = "MM/dd/yy HH:mm:ss") -> Column:
    """Instrument stamp to timestamp; text that does not parse becomes null."""
    return F.try_to_timestamp(_c(c), F.lit(fmt))


# fixed values: published band limits for |d| and I-squared
D_BANDS = ((0.2, "Negligible"), (0.5, "Small"), (0.8, "Moderate"))
I2_BANDS = ((25.0, "Low"), (50.0, "Moderate"), (75.0, "Substantial"))


def _band(x: Column, bands, top: str, missing: str) -> Column:
    chain = F.when(x.isNull(), missing)
    for limit, name in bands:
        chain = chain.when(x < limit, name)
    return chain.otherwise(top)


def effect_band(d) -> Column:
    return _band(F.abs(_c(d)), D_BANDS, "Large", "Not estimable")


def heterogeneity_band(i2) -> Column:
    return _band(_c(i2), I2_BANDS, "High", "Not estimable")


def direction(d) -> Column:
    return F.when(_c(d) > 0, "UP").when(_c(d) < 0, "DOWN").when(_c(d) == 0, "NO_CHANGE")


def same_sign(a, b) -> Column:
    return F.signum(_c(a)) == F.signum(_c(b))


PSEUDOCOUNT = 1e-6


def fold_change(case, control, pseudo: float = PSEUDOCOUNT) -> Column:
    return (_c(case) + F.lit(pseudo)) / (_c(control) + F.lit(pseudo))


def log2_fold_change(case, control, pseudo: float = PSEUDOCOUNT) -> Column:
    return F.log2(fold_change(case, control, pseudo))


def interpretable_log2_fc(case, control) -> Column:
    """log2 ratio, null unless both means are positive."""
    ok = (_c(case) > 0) & (_c(control) > 0)
    return F.when(ok, F.log2(_c(case) / _c(control)))


def clip(c, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(c)))


def logit(p, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def expit(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def rounded(c, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0."""
    return F.round(_c(c), digits) + F.lit(0.0)
