"""Path attributions against enumeration of feature sets over the node tables."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import models, treepaths


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(160, 10)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=160) > 0).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(160)], "sample_id bigint, y int, x array<double>").cache()
    return x, rows, [f"f{j}" for j in range(10)]


def expected(tree, known, row, node=0):
    """A tree's prediction when only the features in ``known`` are."""
    n = tree[node]
    if n.left < 0:
        return n.value
    if n.feature in known:
        return expected(tree, known, row, n.left if row[n.feature] <= n.threshold else n.right)
    return sum(tree[c].cover / n.cover * expected(tree, known, row, c) for c in (n.left, n.right))


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_values_equal_enumeration(spark, study, kind):
    x, rows, names = study
    model = models.fit_forest(rows, trees=4, depth=4) if kind == "forest" else models.fit_boosting(rows, rounds=5, depth=3, rate=0.3)
    nodes = treepaths.node_table(model, spark).toPandas()
    trees = [{r.node: r for r in t.itertuples()} for _, t in nodes.groupby("tree")]
    got = {(r["sample_id"], r["feature"]): r["phi"] for r in treepaths.attributions(model, rows.filter("sample_id < 3"), names, ["sample_id"]).collect()}
    assert len(got) == 30
    for i in range(3):
        for j in range(10):
            want = 0.0
            for tree in trees:
                used = {n.feature for n in tree.values() if n.left >= 0}
                if j not in used:
                    continue
                others = sorted(used - {j})
                for size in range(len(others) + 1):
                    w = factorial(size) * factorial(len(others) - size) / factorial(len(others) + 1)
                    want += sum(w * (expected(tree, {*s, j}, x[i]) - expected(tree, set(s), x[i])) for s in combinations(others, size))
            assert got[i, f"f{j}"] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_values_add_up_to_the_prediction(spark, study, kind):
    x, rows, names = study
    model = models.fit_forest(rows, trees=60) if kind == "forest" else models.fit_boosting(rows, rounds=20)
    base = treepaths.Paths(treepaths.node_table(model, spark).toPandas(), 10).base
    sums = treepaths.attributions(model, rows, names, ["sample_id"]).groupBy("sample_id").agg(F.sum("phi").alias("s"))
    both = sums.join(models.predict(model, rows, ["sample_id"]), "sample_id").collect()
    for r in both:
        p = r["probability"]
        assert base + r["s"] == pytest.approx(p if kind == "forest" else np.log(p / (1 - p)), abs=1e-9)
    assert len(both) == 160 and treepaths.attributions(model, rows.limit(0), names, ["sample_id"]).count() == 0


def test_pattern_tables_equal_polynomials(monkeypatch):
    """Shares looked up by the pattern of a leaf's ranges are those worked out row by row; leaves beyond the byte limit have no table."""
    rng = np.random.default_rng(8)
    groups = []
    for d in (1, 3, 5):
        feature = np.array([rng.permutation(6)[:d] for _ in range(9)])
        low = rng.normal(size=(9, d)) - 1
        groups.append((d, feature, low, low + 1.5, rng.random((9, d)), rng.normal(size=9)))
    x = rng.normal(size=(20, 6))
    tables = treepaths.pattern_tables(groups)
    assert [t.shape for t in tables] == [(1, 2, 9), (3, 8, 9), (5, 32, 9)]
    want = treepaths.leaf_values(groups, 6, x)
    assert np.array_equal(treepaths.leaf_values(groups, 6, x, tables), want)
    monkeypatch.setattr(treepaths, "TABLE_BYTES", 2000)
    some = treepaths.pattern_tables(groups)
    assert [t is None for t in some] == [False, False, True] and np.array_equal(treepaths.leaf_values(groups, 6, x, some), want)
