"""Registered queries against their SQL. COHORTLAB_ALL=1 runs every one; otherwise a quick selection."""

import glob
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from cohortlab.plans import q_models, q_network

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
QUICK = ["effect_sizes", "crosstab", "nesting", "average_precision", "quantile_map", "read_blocks_join", "best_probe", "seed_degree", "composition", "fisher_exact", "stratified_folds", "pattern_counts"]

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="shared tables not present")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in pdf.where(pdf.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("COHORTLAB_ALL") else QUICK)
def test_query_equals_sql(spark, sql, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = sql.sql(entry.oracle_sql()[name]).df()
    assert set(got.columns) == set(want.columns)
    assert _rows(got) == _rows(want)


def test_flagship_has_one_row_per_feature(spark):
    df = entry.entry(spark)
    assert df.count() == 64 and "fdr" in df.columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_full_counts_are_registered(spark):
    q = entry.queries()
    got = {r["model"]: r["n_valid"] for r in q["bootstrap_auc_full"](spark, DATA).collect()}
    assert got == {"score": 10000, "score_b": 10000}
    null = q["permutation_null_full"](spark, DATA).first()
    assert null["replicates"] == 10000 and abs(null["p"] - (null["n_extreme"] + 1) / 10001) < 1e-6
    seeds = {r["n_name"] for r in spark.read.parquet(f"{DATA}/nation.parquet").filter("n_regionkey = 2").collect()}
    near = {}
    for r in q_network.views.edge(spark, DATA).collect():
        for seed, other in ((r["a"], r["b"]), (r["b"], r["a"])):
            if seed in seeds and r["score"] >= 0.1 and other != seed:
                near.setdefault(other, set()).add(seed)
    assert {r["neighbour"] for r in q["common_neighbours_full"](spark, DATA).collect()} == {n for n, of in near.items() if of == seeds}


def test_full_panels_equal_brute_force(spark):
    """1000 panels of three; some again by coordinate descent in numpy, scaled on training values."""
    np = pytest.importorskip("numpy")
    got = {r["panel"]: r["auc"] for r in entry.queries()["panel_transfer_null_full"](spark, DATA).collect()}
    assert sorted(got) == list(range(1000))
    m = q_models.views.labelled(spark, DATA, ["cohort", "y"])
    panels = q_models.models.random_panels(m, 1000, 3).filter("panel IN (0, 500, 999)").collect()
    wide = m.toPandas().pivot(index=["sample_id", "cohort", "y"], columns="feature", values="value").reset_index()
    train, other = wide[wide.cohort == "train"], wide[wide.cohort == "transfer"]
    for k in (0, 500, 999):
        names = [p["feature"] for p in panels if p["panel"] == k]
        assert len(set(names)) == 3
        mean, sd = train[names].mean(), train[names].std(ddof=0)
        x, y, b = np.c_[np.ones(len(train)), ((train[names] - mean) / sd).to_numpy()], train.y.to_numpy(), np.zeros(4)
        step = 4 / np.linalg.eigvalsh(x.T @ x)[-1]
        for _ in range(4000):
            b = b - step * x.T @ (1 / (1 + np.exp(-x @ b)) - y)
            b = np.sign(b) * np.maximum(np.abs(b) - step / 0.3, 0)
        s = ((other[names] - mean) / sd).to_numpy() @ b[1:]
        d = s[other.y.to_numpy() == 1][:, None] - s[other.y.to_numpy() == 0]
        assert abs(got[k] - (np.mean(d > 0) + np.mean(d == 0) / 2)) < 2e-6


def test_registered_lasso_is_optimal(spark):
    """The registered fit meets the conditions of the L1 minimum on scaled training values, intercept included."""
    np = pytest.importorskip("numpy")
    got = {r["feature"]: r["coefficient"] for r in entry.queries()["lasso_fit"](spark, DATA).collect()}
    wide = q_models.views.labelled(spark, DATA, ["cohort", "y"]).filter("cohort = 'train'").toPandas().pivot(index=["sample_id", "y"], columns="feature", values="value").reset_index()
    names = sorted(got)
    x, y = wide[names].to_numpy(), wide.y.to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    b = np.array([got[n] for n in names])
    lo, hi = -5.0, 5.0
    for _ in range(80):  # the intercept that fits these coefficients
        mid = (lo + hi) / 2
        g = (1 / (1 + np.exp(-(mid + z @ b))) - y).sum() + np.sign(mid) / 0.3
        lo, hi = (lo, mid) if g > 0 else (mid, hi)
    slope = z.T @ (1 / (1 + np.exp(-(mid + z @ b))) - y)
    on = np.abs(b) > 1e-9
    assert 0 < on.sum() < 64
    assert np.allclose(slope[on], -np.sign(b[on]) / 0.3, atol=2e-2) and np.all(np.abs(slope[~on]) <= 1 / 0.3 + 2e-2)
