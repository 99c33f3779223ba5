import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import running


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows and one value a third of them."""
    rng = np.random.default_rng(3)
    key = np.where(rng.random(3000) < 0.8, "hot", rng.choice(["a", "b", "c"], 3000))
    value = np.where(rng.random(3000) < 0.33, 1.0, rng.normal(size=3000).round(2) * 10.0 ** rng.integers(-3, 4, 3000))
    pdf = pd.DataFrame({"k": key, "v": value})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("forced", [True, False])
def test_average_rank_matches_pandas(skewed, forced):
    pdf, df = skewed
    got = running.average_rank(df, ["k"], "v", spread=forced).toPandas()
    want = pdf.assign(rank=pdf.groupby("k").v.rank()).drop_duplicates(["k", "v"])
    merged = got.merge(want, on=["k", "v"], suffixes=("", "_w"))
    assert len(merged) == len(want) == len(got)
    assert np.allclose(merged["rank"], merged["rank_w"])


@pytest.mark.parametrize("descending", [True, False])
def test_running_sum_and_min_both_paths(skewed, descending):
    _, df = skewed
    base = running.tally(df, ["k"], "v", n=F.lit(1).cast("bigint")).withColumn("m", F.col("v") * -1)
    parts = [
        running.running(base, ["k"], "v", sums=["n"], mins=["m"], descending=descending, spread=s).orderBy("k", "v").toPandas() for s in (True, False)
    ]
    pd.testing.assert_frame_equal(parts[0][["k", "v", "cum_n", "cum_m"]], parts[1][["k", "v", "cum_n", "cum_m"]])


def test_quantiles_without_keys(skewed, spread):
    pdf, df = skewed
    got = running.quantiles(df, [], "v", {"a": 0.1, "b": 0.5, "c": 0.975}).first()
    assert np.allclose(list(got), pdf.v.quantile([0.1, 0.5, 0.975]))


def test_quantiles_per_key(skewed, spread):
    pdf, df = skewed
    got = running.quantiles(df, ["k"], "v", {"q": 0.25}).toPandas().set_index("k").q
    assert np.allclose(got.sort_index(), pdf.groupby("k").v.quantile(0.25).sort_index())


def test_row_numbers_over_structs(skewed, spread):
    _, df = skewed
    numbered = df.withColumn("id", F.monotonically_increasing_id()).withColumn("o", F.struct("v", "id"))
    got = running.row_numbers(numbered, ["k"], "o").toPandas()
    for _, part in got.groupby("k"):
        ordered = part.sort_values("pos")
        assert list(ordered.pos) == list(range(len(part)))
        assert (ordered.v.diff().dropna() >= 0).all()


def test_spread_path_splits_the_hot_key(skewed):
    """No (key, range) cell may hold a large part of the hot key."""
    _, df = skewed
    base = running.tally(df, ["k"], "v", n=F.lit(1))
    ranged = running._with_range(base, running._limits(base, ["k"], "v", 16), "v", 16)
    cell = ranged.groupBy("k", "_range").count().agg(F.max("count")).first()[0]
    assert cell < base.count() / 30


def test_descending_rank_ties_share_smallest(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (2.0,), (1.0,)], "x double")
    got = {r.x: r["rank"] for r in running.descending_rank(df, [], "x").collect()}
    assert got == {3.0: 1, 2.0: 3, 1.0: 4}


@pytest.mark.parametrize("forced", [True, False])
def test_null_keys_keep_their_group(spark, forced):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "k string, v double")
    got = {r.k: r.m for r in running.quantiles(df, ["k"], "v", {"m": 0.5}, spread=forced).collect()}
    assert got == {None: 2.0, "a": 2.0}


def test_totals_agree_between_paths(skewed):
    _, df = skewed
    base = running.tally(df, ["k"], "v", n=F.lit(1).cast("bigint"))
    a, b = [running.running(base, ["k"], "v", sums=["n"], totals=["n"], spread=s).orderBy("k", "v").toPandas() for s in (True, False)]
    pd.testing.assert_frame_equal(a[["k", "v", "cum_n", "tot_n"]], b[["k", "v", "cum_n", "tot_n"]])


def test_null_value_has_no_rank(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0)], "i int, x double")
    got = {r.i: r["rank"] for r in running.with_descending_rank(df, [], "x").collect()}
    assert got == {1: 2, 2: None, 3: 1}


def test_grouped_values_are_materialised_before_they_are_read_twice(spark):
    from cohortlab.session import fixed

    df = spark.range(10).select((F.col("id") % 3).alias("k"), F.rand(1).alias("v"))
    assert fixed(df) is df
    plan = fixed(df.groupBy("k").agg(F.avg("v").alias("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_ranges_grow_with_the_rows():
    assert running.fan_of(1000) == 16
    assert running.fan_of(10**12) ** 2 * running.RANGE_ROWS >= 10**12


@pytest.mark.parametrize("lookup_bytes", [1 << 25, 0])
def test_one_value_on_nine_rows_of_ten(spark, monkeypatch, lookup_bytes):
    """Ranks, FDR, tau and quantile maps of tied and null values, by broadcast of the table or of its hot keys only."""
    from cohortlab.operators import prep, running, twogroup

    monkeypatch.setattr(running, "LOOKUP_BYTES", lookup_bytes)
    rng = np.random.default_rng(8)
    v = np.where(rng.random(400) < 0.9, 1.0, rng.integers(0, 9, 400).astype(float))
    w = rng.integers(0, 30, 400).astype(float)
    rows = [(i, "a" if i % 2 else "b", float(v[i]) if i % 17 else None, float(w[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, k string, v double, w double")
    got = {r["id"]: r for r in running.with_rank(running.with_descending_rank(df, ["k"], "v", "down"), ["k"], "v", "mid").collect()}
    assert len(got) == 400
    for k in "ab":
        part = pd.Series({r[0]: r[2] for r in rows if r[1] == k}, dtype=float)
        mid, down = part.rank(), part.rank(method="min", ascending=False)
        for i in part.index:
            assert (got[i]["mid"], got[i]["down"]) == ((None, None) if np.isnan(part[i]) else (mid[i], down[i]))
    p = spark.createDataFrame([(i, 1.0 if i < 180 else float(i) / 400 - 0.4) for i in range(200)] + [(999, None)], "id bigint, p double")
    fdr = {r["id"]: r["fdr"] for r in twogroup.adjust_fdr(p).collect()}
    ps = np.array([1.0 if i < 180 else i / 400 - 0.4 for i in range(200)])
    order = np.argsort(ps)
    want = np.empty(200)
    want[order] = np.minimum(np.minimum.accumulate((ps[order] * 200 / np.arange(1, 201))[::-1])[::-1], 1)
    assert fdr.pop(999) is None and all(fdr[i] == pytest.approx(want[i]) for i in range(200))
    known = [r for r in rows if r[2] is not None]
    con = sum((a[2] - b[2]) * (a[3] - b[3]) > 0 for i, a in enumerate(known) for b in known[:i])
    dis = sum((a[2] - b[2]) * (a[3] - b[3]) < 0 for i, a in enumerate(known) for b in known[:i])
    tau = twogroup.kendall_tau(df, "v", "w").first()
    assert (tau["concordant"], tau["discordant"]) == (con, dis)
    target = spark.createDataFrame([(i, "f", float(v[i])) for i in range(400)], "sample_id bigint, feature string, value double")
    short = spark.createDataFrame([(i, "f", float(10 * i)) for i in range(3)], "sample_id bigint, feature string, value double")
    mapped = {r["sample_id"]: r["mapped"] for r in prep.quantile_map(target, short).collect()}
    place = np.empty(400)
    place[np.lexsort((np.arange(400), v))] = np.arange(400)
    at = np.clip((place + 0.5) / 400 * 3 - 0.5, 0, 2)
    assert len(mapped) == 400 and all(mapped[i] == pytest.approx(10 * at[i]) for i in range(400))
