"""Attributions of fitted tree ensembles by paths: exact Shapley values under the trees' own covers, for any number of features and trees.

A tree's prediction with only the features of a set known is the average over its leaves of the chance to reach them: a split on a known feature sends
a row one way, any other split sends it both ways in proportion to the training weight of its children. A leaf's share of a feature's value depends only on the
features on its path, of which there are at most as many as the tree is deep. So every leaf is a short list of (feature, range, cover share),
and for a block of rows all leaves with equally many features are worked out together: polynomials whose coefficients sum
over the feature sets of each size.

Work for a row grows with leaves times the square of the depth, not with the number of features. Rows are never joined; the leaf lists, of the size of the model, are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortlab.session import scratch_path

ROWS = 256
CELLS = 1 << 22
TABLE_BYTES = 32 << 20


def node_table(model, spark) -> DataFrame:
    """(tree, weight, node, left, right, feature, threshold, cover, value) of a fitted forest or boosted ensemble, read back from its saved form.

    ``value`` is what the node adds to the prediction: to the probability of class 1 for a forest, to the log-odds for boosting.
    """
    path = scratch_path(spark, "model")
    model.write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
    n, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    boosted = type(model).__name__.startswith("GBT")
    every = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    value = 2.0 * F.col("weight") * n["prediction"] if boosted else stats[1] / every / float(model.getNumTrees)
    return spark.read.parquet(f"{path}/data").join(F.broadcast(weights), "treeID").select(
        F.col("treeID").alias("tree"), "weight", n["id"].alias("node"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), (stats[0] if boosted else every).alias("cover"), value.alias("value"),
    )


class Paths:
    """The leaves of an ensemble by number of features on their paths."""

    def __init__(self, nodes: pd.DataFrame, features: int):
        self.features, self.base = features, 0.0
        found: dict[int, list] = {}
        for _, tree in nodes.groupby("tree"):
            at = {r.node: r for r in tree.itertuples()}
            total = at[0].cover
            stack: list[tuple[int, dict]] = [(0, {})]
            while stack:
                k, path = stack.pop()
                node = at[k]
                if node.left < 0:
                    self.base += node.value * node.cover / total
                    found.setdefault(len(path), []).append((node.value, path))
                    continue
                for child, low, high in ((node.left, -math.inf, node.threshold), (node.right, node.threshold, math.inf)):
                    was = path.get(node.feature, (-math.inf, math.inf, 1.0))
                    share = at[child].cover / node.cover
                    stack.append((child, path | {node.feature: (max(low, was[0]), min(high, was[1]), was[2] * share)}))
        self.groups = []
        for d, leaves in sorted(found.items()):
            if d:
                feature = np.array([list(p) for _, p in leaves])
                low, high, share = (np.array([[v[c] for v in p.values()] for _, p in leaves], float) for c in range(3))
                self.groups.append((d, feature, low, high, share, np.array([v for v, _ in leaves])))


def _share(i: int, o: np.ndarray, z: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(rows, leaves): what feature ``i`` of each leaf's path adds, for ranges that hold (1) or not (0) a row's values: ``o`` (rows, leaves or 1, d)."""
    d = z.shape[1]
    weights = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
    poly = [np.ones((len(o), len(z)))]
    for j in range(d):
        if j != i:
            a, b = z[:, j], o[:, :, j]
            poly = [(poly[k] * a if k < len(poly) else 0.0) + (poly[k - 1] * b if k else 0.0) for k in range(len(poly) + 1)]
    return v * (o[:, :, i] - z[:, i]) * sum(w * e for w, e in zip(weights, poly, strict=True))


def pattern_tables(groups: list[tuple]) -> list[np.ndarray | None]:
    """(d, patterns, leaves) for each group: the shares of every pattern of ranges, or None where the tables would take too much."""
    made, left = [], TABLE_BYTES
    for d, feature, _, _, share, value in groups:
        size = 8 * d * 2**d * len(feature)
        if size > left:
            made.append(None)
            continue
        left -= size
        pattern = (np.arange(2**d)[:, None] >> np.arange(d) & 1).astype(float)[:, None, :]
        made.append(np.stack([_share(i, pattern, share, value) for i in range(d)]))
    return made


def leaf_values(groups: list[tuple], features: int, x: np.ndarray, tables: Sequence[np.ndarray | None] | None = None) -> np.ndarray:
    """(rows, features): what each feature adds to the base value, for the leaves of ``Paths``."""
    out = np.zeros((len(x), features))
    for (d, feature, low, high, share, value), table in zip(groups, tables or [None] * len(groups), strict=True):
        step = max(1, CELLS // (d * max(1, len(x))))
        for at in range(0, len(feature), step):
            f, z, v = feature[at : at + step], share[at : at + step], value[at : at + step]
            within = []
            for j in range(d):
                seen = x[:, f[:, j]]
                within.append((seen > low[at : at + step, j]) & (seen <= high[at : at + step, j]))
            if table is None:
                o = np.stack(within, axis=2).astype(float)
            else:
                place = np.zeros(within[0].shape, np.int64)
                for j in range(d):
                    place += within[j].astype(np.int64) << j
                place = place * len(feature) + np.arange(at, at + len(f))
            for i in range(d):
                part = _share(i, o, z, v) if table is None else table[i].ravel().take(place)
                order = np.argsort(f[:, i], kind="stable")
                names, begin = np.unique(f[order, i], return_index=True)
                out[:, names] += np.add.reduceat(part[:, order], begin, axis=1)
    return out


def attributions(model, rows: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, feature, phi) for array column ``x`` (features in the order of ``names``): a row's phi and the base value add up to its prediction."""
    spark = rows.sparkSession
    paths = Paths(node_table(model, spark).toPandas(), len(names))
    sent, features = spark.sparkContext.broadcast((paths.groups, pattern_tables(paths.groups))), len(names)

    @F.pandas_udf("array<double>")
    def phi(x: pd.Series) -> pd.Series:
        groups, tables = sent.value
        parts = [leaf_values(groups, features, np.stack(x.iloc[i : i + ROWS].to_numpy()), tables) for i in range(0, len(x), ROWS)]
        return pd.Series(list(np.concatenate(parts)) if parts else [], dtype=object)

    long = rows.filter(F.col("x").isNotNull()).select(*keys, F.posexplode(phi("x")).alias("_i", "phi"))
    return long.select(*keys, F.element_at(F.lit(list(names)), F.col("_i") + 1).alias("feature"), "phi")
