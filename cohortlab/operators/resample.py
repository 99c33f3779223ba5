"""Bootstrap and permutation with replayable draws.

A draw is a hash of (slot, replicate), so any engine can repeat it. ``poisson`` weights need no exchange at all and suit tables too large
for exact draws.

AUC and average precision of replicates come from one global order of the scores: up to ``ORDERED_BYTES`` the scored rows are
packed once (sorted order, ties and labels of every model), broadcast, and each task runs through its own replicates with an array
of row weights and running totals over the order; nothing is exploded, sorted or shuffled per replicate. Beyond that size replicates
are exploded from the rows, rows times replicates spread over (replicate, ...) keys. Poisson weights hang on the row alone: there the
rows are cut into blocks in score order, a task works out all replicates of its blocks, and only totals by block and replicate are shuffled.
Effect sizes add up the values at the drawn places, of both classes in one array.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.functions.hashing import ID_STEP, MODULUS, REP_STEP, SEED_STEP, SHIFT, phash
from cohortlab.operators import running as run
from cohortlab.operators.running import quantiles, row_numbers, with_rank
from cohortlab.operators.twogroup import rank_sums
from cohortlab.session import cut, small

ORDERED_BYTES = 64 << 20
MOST_ATTEMPTS = 1000
BLOCK_ROWS = 1 << 15
POISSON_CUTS = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12))


def _reps(df: DataFrame, replicates: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count for a uniform in [0, 1)."""
    chain = F.when(u < POISSON_CUTS[0], 0)
    for k, cutoff in enumerate(POISSON_CUTS[1:], 1):
        chain = chain.when(u < cutoff, k)
    return chain.otherwise(len(POISSON_CUTS)).cast("bigint")


def bootstrap_weights(df: DataFrame, key: str, replicates: int, by: Sequence[str] = (), seed: int = 42, method: str = "draws") -> DataFrame:
    """(rep, row columns, weight): how often a row is drawn in a replicate.

    ``draws``: exactly n draws with replacement, within each level of ``by`` if
    given. ``poisson``: independent Poisson(1) weights.
    """
    if method == "poisson":
        u = phash(key, "rep", seed) / F.lit(float(MODULUS))
        return _reps(df, replicates).withColumn("weight", poisson_weight(u)).filter(F.col("weight") > 0)
    by = list(by)
    placed = cut(row_numbers(df, by, key, "_pos"))
    size = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    slots = placed.join(small(size), by) if by else placed.withColumn("_n", size.scalar())
    drawn = _reps(slots.select(*by, "_pos", "_n"), replicates).select(*by, "rep", (phash("_pos", "rep", seed) % F.col("_n")).alias("_pos"))
    weights = drawn.groupBy(*by, "rep", "_pos").agg(F.count(F.lit(1)).alias("weight"))
    return placed.join(weights, [*by, "_pos"]).drop("_pos")


def _less(h: np.ndarray, out: np.ndarray) -> None:
    """Bring values below 2^63 to below about 2^32 in place, equal modulo ``MODULUS`` = 2^31 - 1."""
    np.right_shift(h, 31, out=out)
    h &= MODULUS
    h += out


class Hasher:
    """``hashes`` of the same keys for many replicates, without a division."""

    def __init__(self, keys: np.ndarray, seed: int = 42):
        self.start, self.seed = np.mod(np.fmod(keys, MODULUS) * ID_STEP, MODULUS), seed

    def __call__(self, rep: int, rows: slice = slice(None)) -> np.ndarray:
        h = self.start[rows] + (rep * REP_STEP + self.seed * SEED_STEP + 12345) % MODULUS
        spare = np.empty_like(h)
        _less(h, spare)
        for shift in (SHIFT, SHIFT + self.seed + 1):
            h *= h
            h += shift
            _less(h, spare)
            _less(h, spare)
        h[h >= MODULUS] -= MODULUS
        return h


def hashes(keys: np.ndarray, rep: int, seed: int = 42) -> np.ndarray:
    """``phash`` of whole-number keys in numpy."""
    h = (np.fmod(keys, MODULUS) * ID_STEP + rep * REP_STEP + seed * SEED_STEP + 12345) % MODULUS
    for shift in (SHIFT, SHIFT + seed + 1):
        h = (h * h + shift) % MODULUS
    return h


def drawn_counts(n: int, rep: int, seed: int = 42) -> np.ndarray:
    """How often each of ``n`` positions is drawn in a replicate."""
    return np.bincount(hashes(np.arange(n, dtype=np.int64), rep, seed) % n, minlength=n)


def _sorted_scores(label: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Labels in key order, and for every model the order of its scores, descending, with the ends of ties. Plain arrays, to be sent to tasks."""
    order = [np.argsort(-s, kind="stable") for s in scores]
    return label.astype(float), order, [np.flatnonzero(np.append(s[o][1:] != s[o][:-1], True)) for s, o in zip(scores, order, strict=True)]


def _metrics(label: np.ndarray, order: np.ndarray, last: np.ndarray, weight: np.ndarray) -> tuple[float | None, float | None]:
    """AUC and average precision under row weights, by running totals over the order; null for a single class."""
    w = weight[order]
    tp, total = np.cumsum(w * label[order])[last], np.cumsum(w)[last]
    fp = total - tp
    n1, n0 = tp[-1], fp[-1]
    if n1 == 0 or n0 == 0:
        return None, None
    before, behind = np.append(0.0, tp[:-1]), np.append(0.0, fp[:-1])
    area = ((fp - behind) * (tp + before)).sum() / (2 * n1 * n0)
    precision = np.divide(tp, total, out=np.zeros_like(tp), where=total > 0)
    return float(area), float(((tp - before) * precision).sum() / n1)


def _ordered(df: DataFrame, key: str, scores: Sequence[str], label: str) -> tuple[np.ndarray, tuple] | None:
    """The packed rows in key order, or None beyond ``ORDERED_BYTES``."""
    n = df.count()
    if n * 8 * (3 * len(scores) + 2) > ORDERED_BYTES:
        return None
    rows = df.select(key, F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double") for c in scores]).toPandas().sort_values(key, kind="stable")
    return rows[key].to_numpy(), _sorted_scores(rows["_y"].to_numpy(), rows[list(scores)].to_numpy().T)


def _by_replicate(df: DataFrame, replicates: int, shape: str, work) -> DataFrame:
    """One row for each that ``work(rep)`` returns, replicates spread over tasks."""
    names = [c.split()[0] for c in shape.split(", ")]
    kinds = [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in shape.split(", ")]

    def run(batches):
        for batch in batches:
            found = [row for rep in batch.column(0).to_pylist() for row in work(rep)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)

    spark = df.sparkSession
    tasks = max(1, min(replicates, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, replicates, 1, tasks).mapInArrow(run, shape)


def bootstrap_metrics(df: DataFrame, key: str, scores: Sequence[str], replicates: int, label: str = "y", seed: int = 42, redraw: bool = False) -> DataFrame:
    """(rep, model, auc, average_precision, attempts): the same draw for every score. Rows with a null score or label are left out.

    A replicate that drew a single class has null metrics; with ``redraw`` it is drawn again, attempt k of replicate r being draw r + k * replicates,
    until both classes are in it (null after ``MOST_ATTEMPTS``, as when the rows hold a single class).
    """
    known = df.filter(F.col(label).isNotNull())
    for c in scores:
        known = known.filter(F.col(c).isNotNull())
    names = list(scores)
    packed = _ordered(known, key, names, label)
    if packed is None:
        if redraw:
            return _redrawn_rows(known, key, names, replicates, label, seed)
        return _row_metrics(known, key, names, range(replicates), label, seed).withColumn("attempts", F.lit(1))
    sent = df.sparkSession.sparkContext.broadcast(packed[1])
    n = len(packed[0])

    def work(rep):
        label, order, last = sent.value
        attempts, weight = 0, np.zeros(n)
        while n and attempts < (MOST_ATTEMPTS if redraw else 1):
            weight = drawn_counts(n, rep + attempts * replicates, seed).astype(float)
            attempts += 1
            cases = (weight * label).sum()
            if 0 < cases < n:
                break
        return [(rep, name, *(_metrics(label, order[k], last[k], weight) if n else (None, None)), attempts) for k, name in enumerate(names)]

    return _by_replicate(df, replicates, "rep int, model string, auc double, average_precision double, attempts int", work)


def _row_metrics(rows: DataFrame, key: str, scores: Sequence[str], reps: Sequence[int], label: str, seed: int) -> DataFrame:
    """The same from rows exploded by replicate, for tables of any size."""
    from cohortlab.operators.evaluate import average_precision

    placed = cut(row_numbers(rows.select(key, F.col(label).alias("y"), *scores), [], key, "_pos"))
    n = placed.count()
    drawn = placed.select("_pos").withColumn("rep", F.explode(F.lit(list(reps)))).select("rep", (phash("_pos", "rep", seed) % n).alias("_pos"))
    weights = drawn.groupBy("rep", "_pos").agg(F.count(F.lit(1)).alias("weight"))
    long = cut(placed.join(weights, "_pos").unpivot(["rep", "y", "weight"], list(scores), "model", "score"))
    r = rank_sums(long, ["rep", "model"], "score", "y", weight="weight", spread=n > run.WIDE_ROWS)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    area = r.select("rep", "model", F.when(n1 * n0 > 0, F.col("u1") / (n1 * n0)).alias("auc"))
    every = long.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    precise = average_precision(every, ["rep", "model"], "score", "y").select("rep", "model", "average_precision")
    out = area.join(precise, ["rep", "model"], "left")
    return out.select(F.col("rep").cast("int").alias("rep"), "model", "auc", F.when(F.col("auc").isNotNull(), F.col("average_precision")).alias("average_precision"))


def _redrawn_rows(rows: DataFrame, key: str, scores: Sequence[str], replicates: int, label: str, seed: int) -> DataFrame:
    """Redraws by rounds: replicates that have both classes are done, the others are drawn again."""
    todo, done = list(range(replicates)), []
    for attempt in range(MOST_ATTEMPTS):
        found = cut(_row_metrics(rows, key, scores, [r + attempt * replicates for r in todo], label, seed).withColumn("rep", (F.col("rep") - attempt * replicates).cast("int")).withColumn("attempts", F.lit(attempt + 1)))
        good = found.filter("auc IS NOT NULL")
        left = sorted(set(todo) - {r["rep"] for r in good.select("rep").distinct().collect()})
        done.append(good if left and attempt + 1 < MOST_ATTEMPTS else found)
        todo = left
        if not todo:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def bootstrap_auc(df: DataFrame, key: str, scores: Sequence[str], replicates: int, label: str = "y", seed: int = 42, method: str = "draws") -> DataFrame:
    """AUC per (rep, model); replicates that drew a single class have a null AUC. The same draw serves every score."""
    if method == "draws":
        return bootstrap_metrics(df, key, scores, replicates, label, seed).select("rep", "model", "auc")
    return _poisson_auc(df.select(key, label, *scores), key, scores, replicates, label, seed)


def _poisson_limits() -> np.ndarray:
    """The smallest hash that counts k + 1 times, for every k; compared as ``poisson_weight`` does."""
    low = [int(c * MODULUS) - 2 for c in POISSON_CUTS]
    return np.array([next(h for h in range(at, at + 6) if h / float(MODULUS) >= c) for at, c in zip(low, POISSON_CUTS, strict=True)])


def _score_blocks(long: DataFrame, parts: int) -> DataFrame:
    """(model, size, first, between, last, k, known, one, zero, ends): blocks of at most ``BLOCK_ROWS`` rows of a model in descending order of the score, as bytes.

    ``first``, ``between`` and ``last`` are the block's highest score, one between and the lowest, ``ends`` where its ties end.
    """
    def made(table: pa.Table) -> pa.RecordBatch:
        s, k = table.column("s").to_numpy(), table.column("k")
        y = table.column("y").to_numpy()
        ends = np.flatnonzero(np.append((s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1])), True))
        plain = {"model": table.column("model")[0].as_py(), "size": len(s), "first": s[0], "between": s[ends[min(1, len(ends) - 1)]], "last": s[-1]}
        arrays = {"k": k.fill_null(0).to_numpy(), "known": k.is_valid().to_numpy(), "one": (y == 1).astype(np.uint8), "zero": (y == 0).astype(np.uint8), "ends": ends.astype(np.int64)}
        return pa.RecordBatch.from_pylist([plain | {n: v.tobytes() for n, v in arrays.items()}])

    def run(batches):
        held = []
        for batch in batches:
            table = pa.table(batch) if not held else pa.concat_tables([*held, pa.Table.from_batches([batch])])
            held = [table]
            while held:
                table = held[0]
                name = table.column("model")
                same = int(np.argmin(np.append(np.asarray(name.to_numpy(zero_copy_only=False) == name[0].as_py()), False)))
                if same == table.num_rows and same < BLOCK_ROWS:
                    break
                cut_at = min(same, BLOCK_ROWS)
                yield made(table.slice(0, cut_at))
                held = [table.slice(cut_at)] if cut_at < table.num_rows else []
        if held:
            yield made(held[0])

    shape = "model string, size bigint, first double, between double, last double, k binary, known binary, one binary, zero binary, ends binary"
    return long.repartitionByRange(parts, "model", F.desc("s"), "k").sortWithinPartitions("model", F.desc("s")).mapInArrow(run, shape)


def _poisson_auc(rows: DataFrame, key: str, scores: Sequence[str], replicates: int, label: str, seed: int) -> DataFrame:
    """AUC under Poisson weights. A block of rows in score order gives for each replicate the weights of its first and last score, which other blocks may
    share, and the weights and wins of the scores between; summed up by replicate and score these are a replicate's curve.
    """
    named = [F.struct(F.lit(c).alias("model"), (F.col(c).cast("double") + 0.0).alias("s")) for c in scores]
    y = F.when(F.col(label) == 1, 1).when(F.col(label) == 0, 0).otherwise(2)
    long = rows.filter(F.col(label).isNotNull()).select(F.col(key).cast("bigint").alias("k"), y.alias("y"), F.explode(F.array(*named)).alias("_s")).select("_s.model", "_s.s", "k", "y").filter("s IS NOT NULL")
    long = cut(long)
    n, at_once = long.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = cut(_score_blocks(long, max(1, -(-n // (8 * BLOCK_ROWS)))))
    held = blocks.count()
    chunks = max(1, min(replicates, -(-4 * at_once // max(1, held))))
    dealt = blocks.withColumn("_b", F.monotonically_increasing_id()).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    dealt = dealt.repartition(max(1, min(held * chunks, 4 * at_once)), "_b", "chunk").drop("_b")
    limits = _poisson_limits()

    def curves(batches):
        for batch in batches:
            for b in batch.to_pylist():
                get = lambda c, kind: np.frombuffer(b[c], kind)  # noqa: B023
                hasher, unknown = Hasher(get("k", np.int64), seed), np.flatnonzero(~get("known", bool))
                one, zero, ends = get("one", np.uint8), get("zero", np.uint8), get("ends", np.int64)
                reps = np.arange(b["chunk"], replicates, chunks)
                found = np.array([_block_curve(_poisson_weights(hasher(int(rep)), limits, unknown), one, zero, ends) for rep in reps])
                # the first score, those between, the last
                for i, place in enumerate(("first", "between", "last")):
                    if len(ends) > (0, 2, 1)[i]:
                        n1, n0, u, seen = found[:, i].T
                        yield pa.RecordBatch.from_pydict({
                            "rep": pa.array(reps, pa.int32()), "model": pa.array([b["model"]] * len(reps)), "s": pa.array(np.full(len(reps), b[place])), "inner": pa.array(np.full(len(reps), i == 1)),
                            "n1": pa.array(n1), "n0": pa.array(n0), "u": pa.array(u), "seen": pa.array(seen),
                        })

    parts = dealt.mapInArrow(curves, "rep int, model string, s double, inner boolean, n1 double, n0 double, u double, seen double").repartition("rep", "model")
    points = parts.groupBy("rep", "model", "s").agg(*(F.sum(c).alias(c) for c in ("n1", "n0", "u", "seen")), F.max("inner").alias("inner"))
    before = F.coalesce(F.sum("n1").over(Window.partitionBy("rep", "model").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = F.col("n0") * before + F.when(F.col("inner"), F.col("u")).otherwise(F.col("n1") * F.col("n0") / 2.0)
    r = points.withColumn("won", won).groupBy("rep", "model").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum("won").alias("u1"), F.sum("seen").alias("seen")).filter("seen > 0")
    product = F.col("n1") * F.col("n0")
    return r.select("rep", "model", F.when(product > 0, F.col("u1") / product).alias("auc"))


def _poisson_weights(h: np.ndarray, limits: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """``poisson_weight`` of hashes; a row without a key counts most, as there."""
    h = h.astype(np.int32)
    w = np.zeros(len(h), np.uint8)
    for low in limits[:4]:
        w += h >= low
    often = np.flatnonzero(w == 4)
    w[often] += (h[often, None] >= limits[4:]).sum(axis=1).astype(np.uint8)
    w[unknown] = len(limits)
    return w


def _block_curve(w: np.ndarray, one: np.ndarray, zero: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """(cases, controls, wins, weight) of the first score of a block, those between and the last."""
    n1, n0 = (np.diff(np.cumsum(w * c, dtype=np.int64)[ends], prepend=0).astype(float) for c in (one, zero))
    edge = ends[0] + 1, (ends[-2] + 1 if len(ends) > 1 else len(w))
    seen = [float(part.sum(dtype=np.int64)) for part in (w[: edge[0]], w[edge[0] : edge[1]], w[edge[1] :])]
    inner1, inner0 = n1[1:-1], n0[1:-1]
    wins = float((inner0 * (np.cumsum(inner1) - inner1 / 2.0)).sum())
    return [(n1[0], n0[0], 0.0, seen[0]), (inner1.sum(), inner0.sum(), wins, seen[1]), (n1[-1], n0[-1], 0.0, seen[2])]


def interval(replicates: DataFrame, keys: Sequence[str], value: str, null_value: float | None = None) -> DataFrame:
    """Mean, sd and percentile interval of replicate values, valid replicates only."""
    known = replicates.filter(F.col(value).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n_valid"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")]
    if null_value is not None:
        aggs.append(F.avg((F.col(value) > null_value).cast("double")).alias("share_above"))
    a = known.groupBy(*keys).agg(*aggs)
    q = quantiles(known, keys, value, {"low": 0.025, "median": 0.5, "high": 0.975})
    if keys:
        return a.join(q, list(keys))
    return a.withColumn("_q", q.select(F.struct("*").alias("q")).scalar()).select("*", "_q.*").drop("_q")


def paired_delta(replicate_auc: DataFrame, first: str, second: str) -> DataFrame:
    """AUC difference per replicate between two models scored on the same draw."""
    both = replicate_auc.groupBy("rep").agg(
        F.max(F.when(F.col("model") == first, F.col("auc"))).alias("a"), F.max(F.when(F.col("model") == second, F.col("auc"))).alias("b")
    )
    return both.select("rep", (F.col("a") - F.col("b")).alias("delta"))


def winner_share(replicate_auc: DataFrame) -> DataFrame:
    """How often each model has the best AUC; equal best goes to the first name."""
    best = replicate_auc.filter(F.col("auc").isNotNull()).groupBy("rep").agg(F.min(F.struct(-F.col("auc"), F.col("model"))).alias("b"))
    wins = best.groupBy(F.col("b.model").alias("model")).agg(F.count(F.lit(1)).alias("wins"))
    return wins.withColumn("_n", wins.agg(F.sum("wins")).scalar()).select("model", "wins", (F.col("wins") / F.col("_n")).alias("share"))


def permutation_auc(df: DataFrame, key: str, replicates: int, score: str = "score", label: str = "y", seed: int = 42) -> DataFrame:
    """Null AUC per replicate: scores stay, the first n1 rows in hash order become cases. Ranks are computed once."""
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(key, score, label)
    packed = _ordered(rows, key, [score], label) if dict(rows.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") else None
    if packed is not None and len(packed[0]):
        keys, (labels, order, last) = packed
        rank = np.empty(len(keys))
        at, ends = order[0], last[0]
        begins = np.append(0, ends[:-1] + 1)
        rank[at] = len(keys) - np.repeat((begins + ends) / 2.0, ends - begins + 1)  # from 1, ties at their mean
        n1 = int(labels.sum())
        sent = df.sparkSession.sparkContext.broadcast((keys.astype(np.int64), rank))

        def work(rep):
            keys, rank = sent.value
            cases = np.lexsort((keys, hashes(keys, rep, seed)))[:n1]
            n0 = len(keys) - n1
            return [(rep, float((rank[cases].sum() - n1 * (n1 + 1) / 2.0) / (n1 * n0)) if n1 * n0 else None)]

        return _by_replicate(df, replicates, "rep int, auc double", work)
    ranked = cut(with_rank(rows, [], score, "_rank"))
    sizes = ranked.agg(F.struct(F.sum(F.col(label).cast("bigint")).alias("n1"), F.count(F.lit(1)).alias("n")))
    order = _reps(ranked, replicates).withColumn("_o", F.struct(phash(key, "rep", seed), F.col(key)))
    spread = ranked.count() > run.WIDE_ROWS
    placed = row_numbers(order, ["rep"], "_o", "_pos", spread=spread).withColumn("_s", sizes.scalar())
    case_ranks = placed.filter(F.col("_pos") < F.col("_s.n1")).groupBy("rep", "_s").agg(F.sum("_rank").alias("_r"))
    n1, n0 = F.col("_s.n1").cast("double"), (F.col("_s.n") - F.col("_s.n1")).cast("double")
    return case_ranks.select("rep", ((F.col("_r") - n1 * (n1 + 1) / 2.0) / (n1 * n0)).alias("auc"))


def permutation_p(null: DataFrame, observed: DataFrame) -> DataFrame:
    """(k + 1) / (B + 1) on distance from one half; ``observed`` is one row with ``auc``."""
    marked = null.withColumn("observed", observed.select("auc").scalar())
    hit = F.abs(F.col("auc") - 0.5) >= F.abs(F.col("observed") - 0.5) - 1e-12
    return marked.groupBy("observed").agg(
        F.count(F.lit(1)).alias("replicates"), F.avg("auc").alias("null_mean"), F.count_if(hit).alias("n_extreme")
    ).withColumn("p", (F.col("n_extreme") + 1) / (F.col("replicates") + 1))


def bootstrap_effect(df: DataFrame, key: str, replicates: int, value: str = "value", label: str = "y", seed: int = 42) -> DataFrame:
    """Cohen's d (mean-variance sd) per replicate, resampled within each class."""
    rows = df.select(key, value, label)
    s = _effect_rows(rows, key, replicates, value, label, seed) if rows.count() * 8 > ORDERED_BYTES else _effect_sums(rows, key, replicates, value, label, seed)

    def var(g: int) -> Column:
        return (F.col(f"q{g}") - F.col(f"x{g}") * F.col(f"x{g}") / F.col(f"s{g}")) / (F.col(f"s{g}") - 1)

    d = (F.col("x1") / F.col("s1") - F.col("x0") / F.col("s0")) / F.sqrt((var(1) + var(0)) / 2.0)
    return s.select("rep", d.alias("d"))


def _effect_sums(rows: DataFrame, key: str, replicates: int, value: str, label: str, seed: int) -> DataFrame:
    """(rep, s1, x1, q1, s0, x0, q0): draws, sum and sum of squares of both classes, from their values in key order, packed once."""
    placed = row_numbers(rows.filter(F.col(label).isNotNull()), [label], key, "_pos")
    kind = F.when(F.col(label) == 1, 1).when(F.col(label) == 0, 0).otherwise(2).cast("int")
    held = placed.select(kind.alias("y"), "_pos", F.col(value).isNotNull().alias("known"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")).toPandas()
    packed = []
    for g in (1, 0):
        own = held[held["y"] == g].sort_values("_pos")
        known = own["known"].to_numpy(bool)
        packed.append((own["v"].to_numpy(float), None if known.all() else known))
    if not len(held):
        replicates = 0
    sent = rows.sparkSession.sparkContext.broadcast(packed)
    hashers: list[Hasher] = []

    def work(rep):
        if not hashers:
            hashers.extend(Hasher(np.arange(len(v), dtype=np.int64), seed) for v, _ in sent.value)
        out: list = [rep]
        for (v, known), hasher in zip(sent.value, hashers, strict=True):
            n, total, square, valid = len(v), 0.0, 0.0, 0
            for low in range(0, n, BLOCK_ROWS):
                h = hasher(rep, slice(low, low + BLOCK_ROWS)).astype(np.uint32)
                hit = h - h // np.uint32(n) * np.uint32(n)
                x = v[hit]
                total += float(x.sum())
                square += float(x @ x)
                valid += len(x) if known is None else int(known[hit].sum())
            out += [n or None, total if valid else None, square if valid else None]
        return [tuple(out)]

    return _by_replicate(rows, replicates, "rep int, s1 bigint, x1 double, q1 double, s0 bigint, x0 double, q0 double", work)


def _effect_rows(rows: DataFrame, key: str, replicates: int, value: str, label: str, seed: int) -> DataFrame:
    """The same from rows exploded by replicate, for tables of any size."""
    w = bootstrap_weights(rows, key, replicates, by=[label], seed=seed)
    x, m = F.col(value), F.col("weight")

    def part(g: int) -> list[Column]:
        on = F.col(label) == g
        return [F.sum(F.when(on, m)).alias(f"s{g}"), F.sum(F.when(on, m * x)).alias(f"x{g}"), F.sum(F.when(on, m * x * x)).alias(f"q{g}")]

    return w.groupBy("rep").agg(*part(1), *part(0))
