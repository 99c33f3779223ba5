"""Two-group, k-group and rank tests for all features in one pass.

Input is the long table with a 0/1 label on every row. Moments come from one
grouped aggregation; rank statistics from distinct (feature, value) counts, so
neither needs a feature's rows together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.functions import tails
from cohortlab.operators.running import average_rank, looked_up, quantiles, ready, running, tally, with_descending_rank, with_rank
from cohortlab.session import cut, fixed, small


def describe(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean, sd (n-1), min, quartiles by linear interpolation, max."""
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    q = quantiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return moments.join(q, list(keys))


def group_moments(df: DataFrame, keys: Sequence[str], value: str = "value", label: str = "y") -> DataFrame:
    """n, mean and sample variance of both classes per key."""
    aggs = []
    for g in (1, 0):
        x = F.when(F.col(label) == g, F.col(value))
        aggs += [F.count(x).alias(f"n{g}"), F.avg(x).alias(f"mean{g}"), F.var_samp(x).alias(f"var{g}")]
    return df.groupBy(*keys).agg(*aggs)


def _valid_pair() -> Column:
    return (F.col("n1") >= 2) & (F.col("n0") >= 2)


def pooled_variance() -> Column:
    return ((F.col("n1") - 1) * F.col("var1") + (F.col("n0") - 1) * F.col("var0")) / (F.col("n1") + F.col("n0") - 2)


def cohens_d_pooled() -> Column:
    """Mean difference over pooled sd; null for n < 2 or zero sd."""
    sd = F.sqrt(pooled_variance())
    return F.when(_valid_pair() & (sd > 0), (F.col("mean1") - F.col("mean0")) / sd)


def cohens_d_average() -> Column:
    """Mean difference over the root of the mean of both variances."""
    sd = F.sqrt((F.col("var1") + F.col("var0")) / 2.0)
    return F.when(_valid_pair() & (sd > 0), (F.col("mean1") - F.col("mean0")) / sd)


def effect_sizes(df: DataFrame, keys: Sequence[str], value: str = "value", label: str = "y") -> DataFrame:
    m = group_moments(df, keys, value, label)
    return m.select("*", cohens_d_pooled().alias("d_pooled"), cohens_d_average().alias("d_average"))


def t_tests(df: DataFrame, keys: Sequence[str], value: str = "value", label: str = "y") -> DataFrame:
    """Welch and Student t with degrees of freedom and two-sided p."""
    m = group_moments(df, keys, value, label)
    a, b = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0")
    diff = F.col("mean1") - F.col("mean0")
    m = m.select(
        "*",
        F.when(_valid_pair() & (a + b > 0), diff / F.sqrt(a + b)).alias("welch_t"),
        F.when(
            _valid_pair() & (a + b > 0),
            F.pow(a + b, 2) / (F.pow(a, 2) / (F.col("n1") - 1) + F.pow(b, 2) / (F.col("n0") - 1)),
        ).alias("welch_df"),
        F.when(
            _valid_pair() & (pooled_variance() > 0),
            diff / F.sqrt(pooled_variance() * (1 / F.col("n1") + 1 / F.col("n0"))),
        ).alias("student_t"),
        (F.col("n1") + F.col("n0") - 2).cast("double").alias("student_df"),
    )
    return m.withColumn("welch_p", tails.t_p("welch_t", "welch_df")).withColumn(
        "student_p", tails.t_p("student_t", "student_df")
    )


def rank_sums(df: DataFrame, keys: Sequence[str], value: str = "value", label: str = "y", weight: str | None = None, spread: bool | None = None) -> DataFrame:
    """Per key: u1 (wins of class 1 plus half ties), n1, n0 and the tie term sum(t^3 - t)."""
    known = df.filter(F.col(value).isNotNull() & F.col(label).isNotNull())
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    known, spread = ready(known, keys, spread)
    base = tally(known, keys, value, n1=F.when(F.col(label) == 1, w).otherwise(0 * w), n0=F.when(F.col(label) == 0, w).otherwise(0 * w))
    ranked = running(base, keys, value, sums=["n0"], spread=spread)
    t = (F.col("n1") + F.col("n0")).cast("double")
    won = F.col("n1").cast("double") * (F.col("cum_n0") - F.col("n0") / 2.0)
    return ranked.groupBy(*keys).agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum(won).alias("u1"), F.sum(t * t * t - t).alias("ties")
    )


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str = "value", label: str = "y", with_p: bool = True) -> DataFrame:
    """U of class 1, tie- and continuity-corrected z, two-sided p, rank-biserial and ROC-AUC."""
    r = rank_sums(df, keys, value, label)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    spread = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    big = F.greatest(F.col("u1"), n1 * n0 - F.col("u1"))
    out = r.select(
        *keys, "n1", "n0", F.col("u1").alias("u"),
        F.when(spread > 0, (big - n1 * n0 / 2.0 - 0.5) / spread).alias("z"),
        F.when(n1 * n0 > 0, 1.0 - 2.0 * F.col("u1") / (n1 * n0)).alias("rank_biserial"),
        F.when(n1 * n0 > 0, F.col("u1") / (n1 * n0)).alias("auc"),
    )
    if not with_p:
        return out
    # z below zero only through the continuity step at U = mean, where p is 1
    return out.withColumn("p", F.when(F.col("z") <= 0, 1.0).otherwise(tails.norm_p("z")))


def mann_whitney_exact(df: DataFrame, keys: Sequence[str], value: str = "value", label: str = "y", max_rows: int = 300) -> DataFrame:
    """n1, n0, observed mean rank difference, exact two-sided p, and whether it is exact.

    With ties the null distribution is that of the observed mid-ranks. Splits are not listed: the distribution of
    the rank sum is built rank by rank, in time that grows with the fourth power of a key's rows. A key of more than ``max_rows`` rows, where
    the normal form differs in the fourth digit at most, gets the p of ``mann_whitney`` and is marked as not exact; its rows are never gathered.
    """
    keys = list(keys)
    if not keys:
        return mann_whitney_exact(df.withColumn("_g", F.lit(0)), ["_g"], value, label, max_rows).drop("_g")
    ranked = with_rank(df.filter(F.col(value).isNotNull()), keys, value, "_rank")
    is_case = F.col(label) == 1
    sizes = ranked.groupBy(*keys).agg(
        F.count_if(is_case).cast("int").alias("n1"), F.count_if(~is_case).cast("int").alias("n0"),
        (F.avg(F.when(is_case, F.col("_rank"))) - F.avg(F.when(~is_case, F.col("_rank")))).alias("observed"),
        F.sum(F.when(is_case, (F.col("_rank") * 2).cast("bigint"))).alias("_s"),
    ).filter((F.col("n1") > 0) & (F.col("n0") > 0))
    sizes = cut(sizes.withColumn("exact", F.col("n1") + F.col("n0") <= max_rows))
    short = ranked.join(small(sizes.filter("exact").select(*keys, "n1", "_s")), keys)
    packed = short.groupBy(*keys, "n1", "_s").agg(F.collect_list((F.col("_rank") * 2).cast("bigint")).alias("_r"))
    out = sizes.join(packed.select(*keys, tails.rank_sum_p("_r", "n1", "_s").alias("p_exact")), keys, "left").withColumn("_p", F.lit(None).cast("double"))
    if sizes.filter("NOT exact").take(1):
        out = out.drop("_p").join(mann_whitney(df.filter(F.col(value).isNotNull()), keys, value, label).select(*keys, F.col("p").alias("_p")), keys, "left")
    return out.select(*keys, "n1", "n0", "observed", F.coalesce("p_exact", "_p").alias("p_exact"), "exact")


def exact_permutation(df: DataFrame, keys: Sequence[str], value: str = "value", label: str = "y", max_n: int = 60, tol: float = 1e-12) -> DataFrame:
    """All C(n, n1) splits of a key's rows, counted; p is the share with |difference| at least the observed.

    Splits meet in the middle: the sums of all subsets of either half of a key's rows, at most 2^(n / 2) each, are tallied by number of
    cases and sum. A split is a subset of either half with n1 cases together, and is extreme if its sum is at most one limit or
    at least another. So each sum of one half asks how many sums of the other lie beyond limit less sum, by one running total over
    both, split by ranges like every other. The values of a key travel as one array of at most ``max_n`` numbers.
    """
    keys = list(keys)
    if not keys:
        return exact_permutation(df.withColumn("_g", F.lit(0)), ["_g"], value, label, max_n, tol).drop("_g")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value, label)
    longest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest > max_n:
        raise ValueError(f"exact permutation needs at most {max_n} rows per key, found {longest}")
    packed = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("y"), F.col(value).cast("double").alias("x")))).alias("_v")
    ).select(
        *keys,
        F.transform("_v", lambda s: s["x"]).alias("_x"),
        F.aggregate("_v", F.lit(0), lambda a, s: a + s["y"].cast("int")).alias("n1"),
        F.size("_v").alias("_n"),
    )
    packed = packed.withColumn("n0", F.col("_n") - F.col("n1")).filter((F.col("n1") > 0) & (F.col("n0") > 0))
    plus = lambda array: F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    total, cases = plus(F.col("_x")), plus(F.slice("_x", F.col("n0") + 1, F.col("n1")))
    observed = cases / F.col("n1") - (total - cases) / F.col("n0")
    # |S / n1 - (T - S) / n0| >= limit
    limit, slope = F.abs("observed") - tol, 1.0 / F.col("n1") + 1.0 / F.col("n0")
    packed = packed.withColumn("observed", observed).withColumn("_high", (limit + total / F.col("n0")) / slope).withColumn("_low", (total / F.col("n0") - limit) / slope)
    packed = cut(packed.withColumn("_all", limit <= 0))
    middle = F.floor(F.col("_n") / 2).cast("int")
    halves = F.inline(F.array(F.struct(F.lit(0).alias("_half"), F.slice("_x", F.lit(1), middle).alias("_v")), F.struct(F.lit(1).alias("_half"), F.slice("_x", middle + 1, F.col("_n") - middle).alias("_v"))))
    masks = packed.select(*keys, "n1", "_high", "_low", halves)
    masks = masks.withColumn("_h", F.explode(F.expr("sequence(0L, shiftleft(1L, greatest(size(_v) - 12, 0)) - 1)")))
    masks = masks.withColumn("_l", F.explode(F.expr("sequence(0L, shiftleft(1L, least(size(_v), 12)) - 1)"))).withColumn("_mask", F.expr("shiftleft(_h, 12) | _l"))
    picked = plus(F.zip_with("_v", F.sequence(F.lit(0), F.size("_v") - 1), lambda x, i: F.when(F.getbit(F.col("_mask"), i) == 1, x).otherwise(0.0)))
    picked = F.when(F.size("_v") > 0, picked).otherwise(0.0)
    chosen = masks.select(*keys, "n1", "_high", "_low", "_half", F.bit_count("_mask").alias("_k"), picked.alias("_s")).filter(F.col("_k") <= F.col("n1"))
    sums = chosen.groupBy(*keys, "n1", "_high", "_low", "_half", "_k", "_s").agg(F.count(F.lit(1)).alias("_c"))
    # a sum of the second half counts; one of the first asks below its high and up to its low limit
    ask = lambda at, tie: F.struct((F.col(at) - F.col("_s")).alias("v"), F.lit(tie).alias("tie"))
    zero = F.lit(0).cast("bigint")
    events = F.when(F.col("_half") == 1, F.array(F.struct(F.struct(F.col("_s").alias("v"), F.lit(1).alias("tie")).alias("_o"), F.col("_c").alias("w"), zero.alias("q")))).otherwise(
        F.array(F.struct(ask("_high", 0).alias("_o"), zero.alias("w"), F.col("_c").alias("q")), F.struct(ask("_low", 2).alias("_o"), zero.alias("w"), F.col("_c").alias("q")))
    )
    wanted = F.when(F.col("_half") == 1, F.col("_k")).otherwise(F.col("n1") - F.col("_k"))
    placed = tally(sums.select(*keys, wanted.alias("_k"), F.inline(events)), [*keys, "_k"], "_o", w="w", q="q")
    counted = running(placed, [*keys, "_k"], "_o", sums=["w"], totals=["w"])
    above, below = F.col("_o.tie") == 0, F.col("_o.tie") == 2
    hits = F.sum(F.when(above, F.col("q") * (F.col("tot_w") - F.col("cum_w"))).when(below, F.col("q") * F.col("cum_w")))
    found = counted.groupBy(*keys).agg(F.sum(F.when(above, F.col("q") * F.col("tot_w"))).alias("n_splits"), hits.alias("_hits"))
    both = packed.select(*keys, "n1", "n0", "observed", "_all").join(found, keys)
    # every split is as extreme as a difference of zero
    return both.select(*keys, "n1", "n0", "observed", "n_splits", F.when(F.col("_all"), 1.0).otherwise(F.col("_hits") / F.col("n_splits")).alias("p_exact"))


def kruskal_wallis(df: DataFrame, keys: Sequence[str], group: str, value: str = "value", with_p: bool = True) -> DataFrame:
    """H with tie correction over any number of groups."""
    known = fixed(df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()))
    cells = known.groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("m"))
    ranks = average_rank(known, keys, value)
    sums = cells.join(ranks, [*keys, value]).groupBy(*keys, group).agg(
        F.sum("m").alias("m"), F.sum(F.col("m") * F.col("rank")).alias("r")
    )
    ties = ranks.groupBy(*keys).agg(F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"))
    per = sums.groupBy(*keys).agg(
        F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("r") / F.col("m")).alias("q")
    ).join(ties, list(keys))
    n = F.col("n").cast("double")
    h = (12.0 / (n * (n + 1)) * F.col("q") - 3.0 * (n + 1)) / (1.0 - F.col("ties") / (n * n * n - n))
    out = per.select(*keys, "n", "k", h.alias("h"))
    return out.withColumn("p", tails.chi2_p("h", (F.col("k") - 1).cast("double"))) if with_p else out


def correlations(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman r per key with t-based two-sided p."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = with_rank(with_rank(known, keys, x, "_rx"), keys, y, "_ry")
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman")
    )
    dof = (F.col("n") - 2).cast("double")
    for r in ("pearson", "spearman"):
        t = F.col(r) * F.sqrt(dof / F.nullif(1.0 - F.col(r) * F.col(r), F.lit(0.0)))
        out = out.withColumn(f"{r}_p", F.when(F.abs(F.col(r)) >= 1.0, 0.0).otherwise(tails.t_p(t, dof)))
    return out


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b without forming pairs.

    Two rows with different y ranks differ first at exactly one bit when their
    ranks are read from the top. So concordant pairs are counted level by level:
    among rows sharing the bits above, how many rows with a 0 bit come strictly
    earlier in x than each row with a 1 bit. That is n log n rows of ordered
    counting, split by value range like every other running total.
    """
    known = fixed(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()))
    # dense rank of y = number of distinct smaller values
    ys = running(known.groupBy(F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"), F.lit(1).cast("bigint").alias("_one")), [], "_y", sums=["_one"])
    coded = looked_up(known, ys.select(F.col("_y").alias(y), "_n", (F.col("cum__one") - 1).alias("_code")), [y], "_n", inner=True)
    cells = cut(coded.groupBy(x, "_code").agg(F.count(F.lit(1)).alias("_m")))
    top = cells.agg(F.max("_code")).first()[0] or 0
    levels = max(int(top).bit_length(), 1)
    bits = cells.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    code = F.col("_code")
    bits = bits.select(
        x, "_level",
        F.expr("shiftright(_code, _level + 1)").alias("_prefix"),
        F.when(F.getbit(code, F.col("_level")) == 1, F.col("_m")).otherwise(0).alias("ones"),
        F.when(F.getbit(code, F.col("_level")) == 0, F.col("_m")).otherwise(0).alias("zeros"),
    ).groupBy("_level", "_prefix", x).agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    counted = running(bits, ["_level", "_prefix"], x, sums=["zeros"])
    concordant = counted.agg(F.sum(F.col("ones").cast("double") * (F.col("cum_zeros") - F.col("zeros"))).alias("c"))

    def pairs(c: Column) -> Column:
        return c.cast("double") * (c - 1) / 2.0

    def tied(cols: list[str]) -> DataFrame:
        return cells.groupBy(*cols).agg(F.sum("_m").alias("_m")).agg(F.coalesce(F.sum(pairs(F.col("_m"))), F.lit(0.0)))

    totals = cells.agg(pairs(F.sum("_m")).alias("n0")).withColumn("c", concordant.scalar())
    totals = totals.withColumn("n1", tied([x]).scalar()).withColumn("n2", tied(["_code"]).scalar()).withColumn("n3", tied([x, "_code"]).scalar())
    d = F.col("n0") - F.col("n1") - F.col("n2") + F.col("n3") - F.col("c")
    return totals.select(
        F.col("c").alias("concordant"), d.alias("discordant"),
        ((F.col("c") - d) / F.sqrt((F.col("n0") - F.col("n1")) * (F.col("n0") - F.col("n2")))).alias("tau"),
    )


def adjust_fdr(df: DataFrame, p: str = "p", family: Sequence[str] = (), out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg over non-null p values, within each family.

    Works on distinct p values: i is the count of p values up to this one, the
    step-down minimum runs from the largest p.
    """
    family = list(family)
    df = fixed(df)
    known, spread = ready(df.filter(F.col(p).isNotNull()), family, None)
    base = tally(known, family, p, n=F.lit(1).cast("bigint"))
    ranked = running(base, family, p, sums=["n"], spread=spread, totals=["n"])
    raw = ranked.withColumn("_q", F.col(p) * F.col("tot_n") / F.col("cum_n"))
    stepped = running(raw, family, p, mins=["_q"], descending=True, spread=spread)
    q = stepped.select(*family, p, "n", F.least(F.col("cum__q"), F.lit(1.0)).alias(out))
    return looked_up(df, q.withColumnRenamed("n", "_n"), [*family, p], "_n")


def slopes(df: DataFrame, keys: Sequence[str], x: str, y: str = "value") -> DataFrame:
    """Least-squares line of y on x per key: slope, intercept, R2 and the slope's two-sided p."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.filter(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
    )
    dof = (F.col("n") - 2).cast("double")
    t = F.sqrt(F.col("r2") * dof / F.nullif(1.0 - F.col("r2"), F.lit(0.0)))
    return out.withColumn("t_abs", t).withColumn("p", tails.t_p("t_abs", dof))


def meta_analysis(effects: DataFrame, key: str = "feature", d: str = "d", n1: str = "n1", n0: str = "n0") -> DataFrame:
    """Fixed and DerSimonian-Laird random effects per key from standardised differences.

    Studies with a null effect or fewer than two members in a class are left out.
    """
    a, b = F.col(n1).cast("double"), F.col(n0).cast("double")
    usable = effects.filter(F.col(d).isNotNull() & (a > 1) & (b > 1))
    var = (a + b) / (a * b) + F.pow(F.col(d), 2) / (2.0 * (a + b))
    studies = usable.select(key, F.col(d).alias("_d"), var.alias("_v")).withColumn("_w", 1.0 / F.col("_v"))
    fixed = studies.groupBy(key).agg(
        F.count(F.lit(1)).alias("k"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("_w")).alias("_sw2"),
        F.sum(F.col("_w") * F.col("_d")).alias("_swd"), F.sum(F.col("_w") * F.col("_d") * F.col("_d")).alias("_swdd"),
        F.count_if(F.col("_d") > 0).alias("n_up"), F.count_if(F.col("_d") < 0).alias("n_down"),
    ).withColumn("fixed_effect", F.col("_swd") / F.col("_sw")).withColumn(
        "q", F.when(F.col("k") > 1, F.greatest(F.lit(0.0), F.col("_swdd") - F.col("_swd") * F.col("_swd") / F.col("_sw"))).otherwise(0.0)
    )
    dof = (F.col("k") - 1).cast("double")
    c = F.col("_sw") - F.col("_sw2") / F.col("_sw")
    fixed = fixed.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - dof) / F.col("q")) * 100.0).otherwise(0.0)).withColumn(
        "tau2", F.when((F.col("k") > 1) & (c > 0), F.greatest(F.lit(0.0), (F.col("q") - dof) / c)).otherwise(0.0)
    )
    w = 1.0 / (F.col("_v") + F.col("tau2"))
    random = studies.join(fixed.select(key, "tau2"), key).groupBy(key).agg(
        (F.sum(w * F.col("_d")) / F.sum(w)).alias("random_effect"), F.sqrt(1.0 / F.sum(w)).alias("random_se")
    )
    out = fixed.join(random, key).withColumn("fixed_se", F.sqrt(1.0 / F.col("_sw")))
    for m in ("fixed", "random"):
        e, s = F.col(f"{m}_effect"), F.col(f"{m}_se")
        out = out.withColumn(f"{m}_low", e - 1.96 * s).withColumn(f"{m}_high", e + 1.96 * s).withColumn(f"{m}_z", e / s)
        out = out.withColumn(f"{m}_p", tails.norm_p(f"{m}_z"))
    out = out.withColumn("q_p", F.when(F.col("k") > 1, tails.chi2_p("q", (F.col("k") - 1).cast("double"))))
    out = out.withColumn("consistency", F.greatest("n_up", "n_down") / F.col("k"))
    return out.drop("_sw", "_sw2", "_swd", "_swdd")


def direction_concordance(effects: DataFrame, reference: str, dataset: str = "dataset", feature: str = "feature", d: str = "d") -> DataFrame:
    """Per feature: share of other datasets with the reference's sign, and mean, min, max effect."""
    ref = effects.filter(F.col(dataset) == reference).select(feature, F.col(d).alias("reference_d"))
    others = effects.filter(F.col(dataset) != reference).join(ref, feature)
    same = (F.signum(F.col(d)) == F.signum("reference_d")).cast("int")
    return others.groupBy(feature, "reference_d").agg(
        F.count(F.lit(1)).alias("n_datasets"), F.sum(same).alias("n_concordant"), F.avg(same).alias("share_concordant"),
        F.avg(d).alias("mean_d"), F.min(d).alias("min_d"), F.max(d).alias("max_d"),
    )


def magnitude_retention(effects: DataFrame, train: str, other: str, dataset: str = "dataset", feature: str = "feature", d: str = "d") -> DataFrame:
    """|effect elsewhere| over |effect in training|."""
    wide_form = effects.groupBy(feature).agg(
        F.max(F.when(F.col(dataset) == train, F.col(d))).alias("train_d"),
        F.max(F.when(F.col(dataset) == other, F.col(d))).alias("other_d"),
    )
    return wide_form.withColumn("retention", F.abs("other_d") / F.nullif(F.abs("train_d"), F.lit(0.0)))


def fisher_exact(df: DataFrame, flag: str, block: str, levels: tuple) -> DataFrame:
    """2x2 counts of a boolean flag by two block levels, with the two-sided exact p."""
    x, b = F.col(flag), F.col(block)
    counts = df.agg(
        F.count_if(x & (b == levels[0])).alias("a"), F.count_if(~x & (b == levels[0])).alias("b"),
        F.count_if(x & (b == levels[1])).alias("c"), F.count_if(~x & (b == levels[1])).alias("d"),
    )
    return counts.withColumn("p", tails.fisher_p("a", "b", "c", "d"))


def moderated_t(df: DataFrame, keys: Sequence[str] = ("feature",), value: str = "value", label: str = "y") -> DataFrame:
    """Two-group t with variances shrunk towards a common prior (empirical Bayes).

    The prior df and variance come from mean and variance of log s2 over features;
    only that one row meets the trigamma inverse.
    """
    m = cut(group_moments(df, keys, value, label).withColumn("s2", pooled_variance()).filter(F.col("s2") > 0))
    dof = (F.col("n1") + F.col("n0") - 2).cast("double")
    e = F.log("s2") - tails.digamma_col(dof / 2.0) + F.log(dof / 2.0)
    # trigamma(dof/2) is the sampling variance of log s2; its mean is subtracted below
    base = m.withColumn("_e", e).withColumn("_dof", dof)
    prior = base.agg(F.avg("_e").alias("me"), F.var_samp("_e").alias("ve"), F.avg(trigamma(F.col("_dof") / 2.0)).alias("tg"))
    prior = prior.withColumn("_x", F.col("ve") - F.col("tg")).withColumn("_inv", tails.trigamma_inv(F.when(F.col("_x") > 0, F.col("_x"))))
    prior = prior.select(
        F.struct(
            (2.0 * F.col("_inv")).alias("d0"),
            F.exp(F.col("me") + F.coalesce(tails.digamma_col("_inv") - F.log("_inv"), F.lit(0.0))).alias("s02"),
        ).alias("p")
    )
    out = base.withColumn("_p", prior.scalar()).withColumn("d0", F.col("_p.d0")).withColumn("s02", F.col("_p.s02"))
    # no excess spread: every variance is the prior one and the prior df is infinite
    shrunk = F.when(F.col("d0").isNull(), F.col("s02")).otherwise((F.col("d0") * F.col("s02") + F.col("_dof") * F.col("s2")) / (F.col("d0") + F.col("_dof")))
    out = out.withColumn("s2_post", shrunk)
    t = (F.col("mean1") - F.col("mean0")) / F.sqrt(F.col("s2_post") * (1 / F.col("n1") + 1 / F.col("n0")))
    out = out.withColumn("t", t)
    p = F.when(F.col("d0").isNull(), tails.norm_p("t")).otherwise(tails.t_p("t", F.col("_dof") + F.col("d0")))
    return out.withColumn("p", p).drop("_p", "_e", "_dof")


def trigamma(x: Column) -> Column:
    """Trigamma by eight recurrence steps and the asymptotic series."""
    total = F.lit(0.0)
    for i in range(8):
        total = total + 1.0 / F.pow(x + i, 2)
    z = x + 8
    return total + 1.0 / z + 1.0 / (2.0 * z * z) + 1.0 / (6.0 * F.pow(z, 3)) - 1.0 / (30.0 * F.pow(z, 5)) + 1.0 / (42.0 * F.pow(z, 7))


def ranked_table(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Mean and sd of the descending ranks over several score columns, and the re-ranked mean."""
    long = df.unpivot([key], list(cols), "measure", "score").filter(F.col("score").isNotNull())
    ranks = with_descending_rank(long, ["measure"], "score")
    mean = ranks.groupBy(key).agg(F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("sd_rank"))
    flipped = mean.withColumn("_neg", -F.col("mean_rank"))
    return with_descending_rank(flipped, [], "_neg", "final_rank").drop("_neg")
