"""SQL fragments shared by the oracle texts: rounding, mid-ranks and numeric tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cohortlab.functions.scalars import rounded


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0e0"


def shape(df: DataFrame, keep: Sequence[str], values: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Final projection of a query: ids as they are, doubles rounded."""
    return df.select(*keep, *[rounded(c, digits).alias(c) for c in values])


def midrank(keys: str, value: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    tie = f"PARTITION BY {keys + ', ' if keys else ''}{value}"
    return f"(rank() OVER ({part}ORDER BY {value}) + (count(*) OVER ({tie}) - 1) / 2e0)"


_STEPS = 2000


def _simpson(body: str, upper: str) -> str:
    """Integral from 0 to ``upper`` of ``body`` in the variable {u}."""
    weight = f"(CASE WHEN i = 0 OR i = {_STEPS} THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END)"
    at = f"({upper} * i / {_STEPS}e0)"
    return f"(list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: {weight} * {body.format(u=at)})) * {upper} / {3 * _STEPS}e0)"


def norm_p(z: str) -> str:
    return f"(1e0 - 2e0 * {_simpson('exp(-0.5e0 * pow({u}, 2))', f'least(abs({z}), 9e0)')} / sqrt(2e0 * pi()))"


def t_p(t: str, df: str) -> str:
    body = "pow(1e0 + pow({u}, 2) / " + f"({df}), -(({df}) + 1e0) / 2e0)"
    const = f"(exp(lgamma((({df}) + 1e0) / 2e0) - lgamma(({df}) / 2e0)) / sqrt(({df}) * pi()))"
    return f"(1e0 - 2e0 * {const} * {_simpson(body, f'abs({t})')})"


def chi2_p(x: str, k: str) -> str:
    body = "pow({u}, " + f"({k}) - 1e0)" + " * exp(-0.5e0 * pow({u}, 2))"
    const = f"(2e0 / (pow(2e0, ({k}) / 2e0) * exp(lgamma(({k}) / 2e0))))"
    return f"(1e0 - {const} * {_simpson(body, f'sqrt({x})')})"


def digamma(x: str) -> str:
    z = f"(({x}) + 30e0)"
    return (f"(ln({z}) - 1e0 / (2e0 * {z}) - 1e0 / (12e0 * pow({z}, 2)) + 1e0 / (120e0 * pow({z}, 4)) - 1e0 / (252e0 * pow({z}, 6))"
            f" - list_sum(list_transform(range(0, 30), lambda i: 1e0 / (({x}) + i))))")


def trigamma(x: str) -> str:
    z = f"(({x}) + 30e0)"
    return (f"(1e0 / {z} + 1e0 / (2e0 * pow({z}, 2)) + 1e0 / (6e0 * pow({z}, 3)) - 1e0 / (30e0 * pow({z}, 5)) + 1e0 / (42e0 * pow({z}, 7))"
            f" + list_sum(list_transform(range(0, 30), lambda i: 1e0 / pow(({x}) + i, 2))))")


def auc_sql(source: str, keys: str, score: str, label: str = "y") -> str:
    """Table expression (keys, n1, n0, u1, auc) by summed mid-ranks."""
    k = f"{keys}, " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""(SELECT {k}n1, n0, s1 - n1 * (n1 + 1) / 2e0 AS u1,
      CASE WHEN n1 > 0 AND n0 > 0 THEN (s1 - n1 * (n1 + 1) / 2e0) / (n1 * 1e0 * n0) END AS auc
      FROM (SELECT {k}CAST(sum({label}) AS BIGINT) AS n1, CAST(sum(1 - {label}) AS BIGINT) AS n0, coalesce(sum(rk) FILTER ({label} = 1), 0) AS s1
            FROM (SELECT {k}{label}, {midrank(keys, score)} AS rk FROM {source} WHERE {score} IS NOT NULL AND {label} IS NOT NULL) {grp}))"""


def logistic_sql(source: str, features: Sequence[str], model: str = "model", label: str = "y", l2: float = 0.0, penalise_first: bool = False, offset: str | None = None, weight: str | None = None, steps: int = 12, prefix: str = "nt") -> str:
    """Chain of CTEs: Newton steps for a logistic fit per model with an intercept and up to two features.

    The last CTE is ``{prefix}_fit`` with (model, b0.., log_lik, n, i00.. = inverse information diagonal).
    """
    k = len(features) + 1
    xs = ["1e0", *features]
    off = offset or "0e0"
    w = weight or "1e0"
    pen = [l2 if (i > 0 or penalise_first) else 0.0 for i in range(k)]
    cols = ", ".join(f"CAST({0.0} AS DOUBLE) AS b{i}" for i in range(k))
    out = [f"{prefix}0 AS (SELECT {model} AS model, {cols} FROM {source} GROUP BY 1)"]
    for s in range(steps + 1):
        prev = f"{prefix}{s}"
        eta = " + ".join([off] + [f"b{i} * {xs[i]}" for i in range(k)])
        sums = ["sum(w * (yy - pp) * x%d) AS r%d" % (i, i) for i in range(k)]
        sums += ["sum(w * pp * (1e0 - pp) * x%d * x%d) AS q%d%d" % (i, j, i, j) for i in range(k) for j in range(i, k)]
        inner = ", ".join(f"{xs[i]} AS x{i}" for i in range(k))
        bs = ", ".join(f"b{i}" for i in range(k))
        out.append(f"""{prefix}a{s} AS (SELECT model, {bs}, {', '.join(sums)}, sum(w) AS n,
          sum(w * (yy * eta - greatest(eta, 0e0) - ln(1e0 + exp(-abs(eta))))) AS log_lik
          FROM (SELECT *, 1e0 / (1e0 + exp(-eta)) AS pp FROM (
            SELECT p.model, {', '.join('p.b%d' % i for i in range(k))}, {inner}, CAST(t.{label} AS DOUBLE) AS yy, {w} AS w, {eta} AS eta
            FROM {source} t JOIN {prev} p ON t.{model} = p.model)) GROUP BY model, {bs})""")
        g = [f"(r{i} - {pen[i]}e0 * b{i})" for i in range(k)]
        h = {(i, j): (f"(q{i}{j} + {pen[i]}e0)" if i == j else f"q{min(i, j)}{max(i, j)}") for i in range(k) for j in range(k)}
        if k == 1:
            det, inv = h[0, 0], {(0, 0): f"1e0 / {h[0, 0]}"}
        elif k == 2:
            det = f"({h[0,0]} * {h[1,1]} - {h[0,1]} * {h[0,1]})"
            inv = {(0, 0): f"{h[1,1]} / {det}", (1, 1): f"{h[0,0]} / {det}", (0, 1): f"-{h[0,1]} / {det}"}
        else:
            cof = {}
            for i in range(3):
                for j in range(i, 3):
                    rows = [a for a in range(3) if a != i]
                    cs = [a for a in range(3) if a != j]
                    sign = "-" if (i + j) % 2 else ""
                    cof[i, j] = f"{sign}({h[rows[0], cs[0]]} * {h[rows[1], cs[1]]} - {h[rows[0], cs[1]]} * {h[rows[1], cs[0]]})"
            det = "(" + " + ".join(f"{h[0, j]} * {cof[0, j]}" for j in range(3)) + ")"
            inv = {ij: f"({c}) / {det}" for ij, c in cof.items()}
        if s < steps:
            new = [f"b{i} + " + " + ".join(f"({inv[min(i, j), max(i, j)]}) * {g[j]}" for j in range(k)) + f" AS b{i}" for i in range(k)]
            out.append(f"{prefix}{s + 1} AS (SELECT model, {', '.join(new)} FROM {prefix}a{s})")
        else:
            diag = ", ".join(f"{inv[i, i]} AS i{i}" for i in range(k))
            out.append(f"{prefix}_fit AS (SELECT model, {bs}, n, log_lik, {diag} FROM {prefix}a{s})")
    return ",\n".join(out)


def gram_rank_sql(source: str, columns: Sequence[str], name: str, prefix: str) -> tuple[str, str]:
    """(CTE chain, final select): rank of [1, columns] by eliminating the scaled cross-product matrix pivot by pivot."""
    cols = ["1e0", *columns]
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    g = lambda i, j: f"g{min(i, j)}_{max(i, j)}"
    chain = [f"{prefix}b AS (SELECT count(*) AS n, {', '.join(f'sum(CAST({cols[i]} AS DOUBLE) * CAST({cols[j]} AS DOUBLE)) AS {g(i, j)}' for i, j in pairs)} FROM {source})",
             f"{prefix}0 AS (SELECT n, 0 AS rank, {', '.join(f'{g(i, j)} / sqrt({g(i, i)} * {g(j, j)}) AS {g(i, j)}' for i, j in pairs)} FROM {prefix}b)"]
    for p in range(k):
        rest = [(i, j) for i, j in pairs if i > p]
        step = "".join(f", CASE WHEN {g(p, p)} > 1e-8 THEN {g(i, j)} - {g(p, i)} * {g(p, j)} / {g(p, p)} ELSE {g(i, j)} END AS {g(i, j)}" for i, j in rest)
        chain.append(f"{prefix}{p + 1} AS (SELECT n, rank + CASE WHEN {g(p, p)} > 1e-8 THEN 1 ELSE 0 END AS rank{step} FROM {prefix}{p})")
    final = f"SELECT '{name}' AS design, n AS n_samples, CAST({k} AS INTEGER) AS n_columns, CAST(rank AS INTEGER) AS rank, rank = {k} AS identifiable FROM {prefix}{k}"
    return ", ".join(chain), final
