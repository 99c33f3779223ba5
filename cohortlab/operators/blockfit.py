"""Many penalised logistic regressions advanced together over blocks of samples.

Samples are packed once: a block is one row with the value matrix, labels, bootstrap counts and fold numbers of
``BLOCK_ROWS`` samples. A model of a batch is told apart by its penalty, the bootstrap replicate whose counts are its
sample weights, the fold it leaves out, and the features it may use; no sample is repeated for it. A pass
broadcasts the current coefficients of the batch, and every task returns one sum of gradients (and, in some passes, of
second derivatives) for each model, whatever the number of its samples. The sums of a chunk of models meet in one
task, which moves them: coordinate descent on the second derivatives for L1, a linear solve otherwise. Sample tables grow with the
data; what is broadcast and summed grows with models times features and is kept below ``BATCH_BYTES`` by splitting batches.

Features are scaled inside each model, with the weighted mean and standard deviation of its own training samples. With a
covariate, each feature is first taken as its residual on the covariate, fitted on the training controls.
Second derivatives are summed anew only when steps with old ones stop gaining; a step that does not lower the
objective is halved. A model is done when its optimality conditions hold to ``TOLERANCE`` per sample.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlab.operators.evaluate import auc, average_precision
from cohortlab.operators.resample import drawn_counts, hashes
from cohortlab.operators.running import row_numbers
from cohortlab.session import cut, discard, scratch_path, small

BLOCK_ROWS = 1024
CHUNK = 128
TASKS = 4
BATCH_BYTES = 64 << 20
TOLERANCE = 1e-11
MAX_PASSES = 200
DRAWN = 50_000_000
ALONE = -2
PACKED = 4_000_000


@dataclass(frozen=True)
class Blocks:
    """Packed samples: a table with a row for each block, the feature names, the number of samples and the centre of each column."""

    table: DataFrame
    names: tuple[str, ...]
    n: int
    centre: np.ndarray
    has_covariate: bool = False
    rows: int = BLOCK_ROWS

    @property
    def p(self) -> int:
        return len(self.names)


@dataclass(frozen=True)
class Models:
    """One entry for each model of a batch. ``boot``, ``part`` are columns of the counts and fold sets (-1: none), ``held`` the fold left out.

    A sample whose fold number in the set is negative is in none of its folds. ``part`` ALONE leaves out the one sample at position ``held``.
    ``label`` is the number of a label shuffle (-1: the true labels; None: all true). Features: all, those ``allowed`` (models, features), or a few
    ``columns`` (models, size) by number; with columns, coefficients and scalings have their order.
    """

    c: np.ndarray
    boot: np.ndarray
    part: np.ndarray
    held: np.ndarray
    allowed: np.ndarray | None = None
    columns: np.ndarray | None = None
    label: np.ndarray | None = None

    @classmethod
    def of(cls, n: int = 1, c: float | Sequence[float] = np.inf, boot=-1, part=-1, held=-1, allowed: np.ndarray | None = None, columns: np.ndarray | None = None, label=None) -> Models:
        whole = lambda v, kind: np.broadcast_to(np.asarray(v, kind), (n,)).copy()
        return cls(whole(c, float), whole(boot, np.int64), whole(part, np.int64), whole(held, np.int64), allowed, columns, None if label is None else whole(label, np.int64))

    def __len__(self) -> int:
        return len(self.c)

    def some(self, at) -> Models:
        own = [None if v is None else v[at] for v in (self.allowed, self.columns, self.label)]
        return Models(self.c[at], self.boot[at], self.part[at], self.held[at], *own)

    def size(self, features: int) -> int:
        return features if self.columns is None else self.columns.shape[1]


@dataclass
class Fits:
    """Coefficients of scaled features (intercept first) and the scaling of each model: z = (x - shift - slope * covariate) / scale."""

    beta: np.ndarray
    shift: np.ndarray
    slope: np.ndarray
    scale: np.ndarray
    variance: np.ndarray
    n: np.ndarray
    cases: np.ndarray
    kkt: np.ndarray = field(default_factory=lambda: np.empty(0))
    passes: int = 0

    def raw(self) -> np.ndarray:
        """Coefficients of [1, features, covariate] as they were packed (less the centre), a row for each model."""
        a = self.beta[:, 1:] / self.scale
        return np.column_stack([self.beta[:, 0] - (a * self.shift).sum(axis=1), a, -(a * self.slope).sum(axis=1)])


def _counts(spark: SparkSession, n: int, replicates: int, seed: int, block_rows: int) -> DataFrame:
    """(block, counts): bootstrap counts of all replicates for the samples of a block, one byte each, by sample."""
    if n > DRAWN:
        raise ValueError(f"a replicate of exact draws is one array of all samples; {n} exceed {DRAWN}")

    def draw(batches):
        for batch in batches:
            for rep in batch.column(0).to_pylist():
                counts = drawn_counts(n, rep, seed)
                if counts.max(initial=0) > 255:
                    raise OverflowError("a sample was drawn more than 255 times")
                counts = counts.astype(np.uint8)
                at = range(0, n, block_rows)
                yield pa.RecordBatch.from_arrays([pa.array([i // block_rows for i in at], pa.int64()), pa.array([rep] * len(at), pa.int64()), pa.array([counts[i : i + block_rows].tobytes() for i in at], pa.binary())], ["block", "rep", "c"])

    def stack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rep").to_numpy())
        rows = [np.frombuffer(table.column("c")[int(i)].as_buffer(), np.uint8) for i in order]
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([np.stack(rows, axis=1).tobytes()], pa.binary())})

    parts = max(1, min(replicates // 8, 2000))
    return spark.range(0, replicates, 1, parts).mapInArrow(draw, "block bigint, rep bigint, c binary").groupBy("block").applyInArrow(stack, "block bigint, counts binary")


def _shuffled(placed: DataFrame, key: str, n: int, shuffles: int, seed: int, block_rows: int) -> DataFrame:
    """(block, labels): for each sample of a block one bit for each shuffle."""
    if n > DRAWN:
        raise ValueError(f"a label shuffle is one array of all samples; {n} exceed {DRAWN}")
    rows = placed.select("_pos", F.col(key).cast("bigint").alias("k"), "_y").toPandas().sort_values("_pos")
    sent = placed.sparkSession.sparkContext.broadcast((rows["k"].to_numpy(), int(rows["_y"].sum())))

    def draw(batches):
        keys, cases = sent.value
        for batch in batches:
            for eight in batch.column(0).to_pylist():  # eight shuffles are one byte of every sample
                bits = np.zeros((n, 8), np.uint8)
                for k in range(min(8, shuffles - 8 * eight)):
                    bits[np.lexsort((keys, hashes(keys, 8 * eight + k, seed)))[:cases], k] = 1
                packed = np.packbits(bits, axis=1)[:, 0]
                at = range(0, n, block_rows)
                yield pa.RecordBatch.from_arrays([pa.array([i // block_rows for i in at], pa.int64()), pa.array([eight] * len(at), pa.int64()), pa.array([packed[i : i + block_rows].tobytes() for i in at], pa.binary())], ["block", "rep", "c"])

    def stack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rep").to_numpy())
        rows = [np.frombuffer(table.column("c")[int(i)].as_buffer(), np.uint8) for i in order]
        return pa.table({"block": table.column("block")[:1], "labels": pa.array([np.stack(rows, axis=1).tobytes()], pa.binary())})

    eights = -(-shuffles // 8)
    made = placed.sparkSession.range(0, eights, 1, max(1, min(eights, 2000))).mapInArrow(draw, "block bigint, rep bigint, c binary")
    return made.groupBy("block").applyInArrow(stack, "block bigint, labels binary")


def pack(rows: DataFrame, names: Sequence[str], key: str = "sample_id", label: str = "y", covariate: str | None = None, folds: DataFrame | None = None, replicates: int = 0, shuffles: int = 0, seed: int = 42, block_rows: int = BLOCK_ROWS) -> Blocks:
    """Blocks from (key, label, x array, covariate). ``folds`` is (key, rep, fold) with one fold for each sample and repetition.

    ``shuffles`` label shuffles keep the number of cases: the first samples in the hash order of (whole-number key, shuffle) are cases.

    A null or missing value counts as the feature's mean over all rows. Rows with a null label are left out.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col(label).isNotNull())
    placed = cut(row_numbers(rows.select(key, F.col(label).cast("double").alias("_y"), "x", (F.col(covariate) if covariate else F.lit(None)).cast("double").alias("_a")), [], key, "_pos"))
    n = placed.count()
    if folds is not None:
        sets = folds.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", "fold"))), lambda s: s["fold"].cast("int")).alias("_f"))
        placed = placed.join(sets, key, "left")
    else:
        placed = placed.withColumn("_f", F.lit(None).cast("array<int>"))

    def stack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        rows = table.num_rows
        flat = lambda c, kind: np.array(table.column(c).to_pylist(), kind).reshape(rows, -1)
        made = {
            "block": table.column("block")[:1], "first": table.column("_pos")[:1], "rows": pa.array([rows], pa.int64()), "keys": pa.array([table.column(key).to_pylist()], pa.list_(table.schema.field(key).type)),
            "x": pa.array([flat("x", float).tobytes()], pa.binary()), "y": pa.array([flat("_y", float).tobytes()], pa.binary()),
            "a": pa.array([flat("_a", float).tobytes()], pa.binary()), "f": pa.array([b"" if table.column("_f").null_count else flat("_f", np.int32).tobytes()], pa.binary()),
        }
        return pa.table(made)

    kind = dict(rows.dtypes)[key]
    packed = placed.withColumn("block", F.floor(F.col("_pos") / block_rows)).groupBy("block").applyInArrow(stack, f"block bigint, first bigint, rows bigint, keys array<{kind}>, x binary, y binary, a binary, f binary")
    if replicates and n:
        # counts compress so well that their size on disk would suggest a broadcast
        packed = packed.join(_counts(spark, n, replicates, seed, block_rows).hint("merge"), "block")
    else:
        packed = packed.withColumn("counts", F.lit(None).cast("binary"))
    if shuffles and n:
        packed = packed.join(_shuffled(placed, key, n, shuffles, seed, block_rows).hint("merge"), "block")
    else:
        packed = packed.withColumn("labels", F.lit(None).cast("binary"))
    path = scratch_path(spark, "blocks")
    packed.write.parquet(path)
    blocks = Blocks(spark.read.schema(packed.schema).parquet(path), tuple(names), n, np.zeros(len(names) + 1), covariate is not None, block_rows)

    columns = len(names) + 1

    def sums(batches):
        total = np.zeros((2, columns))
        for b in _read(batches, np.full(columns, np.nan)):
            total += np.stack([np.nansum(b.x, axis=0), (~np.isnan(b.x)).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    parts = [np.frombuffer(r[0]).reshape(2, -1) for r in blocks.table.mapInArrow(sums, "s binary").toLocalIterator()]
    total = sum(parts, np.zeros((2, blocks.p + 1)))
    return replace(blocks, centre=total[0] / np.maximum(total[1], 1))


@dataclass
class _Block:
    x: np.ndarray  # values and covariate less the centre, or with their NaN if the centre is NaN
    y: np.ndarray
    folds: np.ndarray
    counts: np.ndarray | None
    keys: pa.Array
    slice: int = 0
    first: int = 0
    shuffled: np.ndarray | None = None

    def labels(self, models: Models) -> np.ndarray:
        """(samples, models), or (samples, 1) where all models have the true labels."""
        if models.label is None:
            return self.y[:, None]
        out = np.repeat(self.y[:, None], len(models), axis=1)
        at = np.flatnonzero(models.label >= 0)
        if len(at):
            k = models.label[at]
            out[:, at] = self.shuffled[:, k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1
        return out

    def left_out(self, models: Models) -> np.ndarray:
        """(samples, models): whether the model leaves the sample out to be scored."""
        mask = np.zeros((len(self.y), len(models)), bool)
        split = models.part >= 0
        if split.any():
            mask[:, split] = self.folds[:, models.part[split]] == models.held[split]
        alone = np.flatnonzero(models.part == ALONE)
        at = models.held[alone] - self.first
        inside = (at >= 0) & (at < len(self.y))
        mask[at[inside], alone[inside]] = True
        return mask

    def weights(self, models: Models) -> np.ndarray:
        """Sample weights (rows, models): bootstrap counts, zero in the fold left out."""
        w = np.ones((len(self.y), len(models)))
        if self.counts is not None:
            drawn = models.boot >= 0
            w[:, drawn] = self.counts[:, models.boot[drawn]]
        alone = np.flatnonzero(models.part == ALONE)
        if len(alone):
            at = models.held[alone] - self.first
            inside = (at >= 0) & (at < len(self.y))
            w[at[inside], alone[inside]] = 0.0
        split = models.part >= 0
        if split.any():
            folds = self.folds[:, models.part[split]]
            w[:, split] *= (folds != models.held[split]) & (folds >= 0)
        return w


def _read(batches, centre: np.ndarray) -> Iterator[_Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            value = {n: batch.column(n)[row] for n in batch.schema.names}
            n = value["rows"].as_py()
            get = lambda c, kind: np.frombuffer(value[c].as_buffer(), kind).reshape(n, -1) if value[c].is_valid else None  # noqa: B023
            x = np.column_stack([get("x", float), get("a", float)])
            if not np.isnan(centre).all():
                x = np.nan_to_num(x - centre)
            folds = get("f", np.int32) if len(value["f"].as_buffer()) else np.empty((n, 0), np.int32)
            yield _Block(x, get("y", float)[:, 0], folds, get("counts", np.uint8), value["keys"].values, value["slice"].as_py() if "slice" in value else 0, value["first"].as_py(), get("labels", np.uint8))


def _gathered(x: np.ndarray, models: Models) -> np.ndarray:
    """(samples, models, size + 1): the columns of each model and the covariate."""
    last = np.full((len(models), 1), x.shape[1] - 1)
    return x[:, np.concatenate([models.columns, last], axis=1)]


def _eta(x: np.ndarray, models: Models, raw: np.ndarray) -> np.ndarray:
    if models.columns is None:
        return x @ raw[:, 1:].T + raw[:, 0]
    return np.einsum("nmk,mk->nm", _gathered(x, models), raw[:, 1:]) + raw[:, 0]


def _dot(w: np.ndarray, x: np.ndarray, models: Models) -> np.ndarray:
    """Sums over samples of weight times columns: (models, columns)."""
    return w.T @ x if models.columns is None else np.einsum("nm,nmk->mk", w, _gathered(x, models))


def _second(v: np.ndarray, x: np.ndarray, models: Models) -> np.ndarray:
    """Sums of weight times products of two of [1, columns, covariate], upper triangle."""
    i, j = _pairs(models.size(x.shape[1] - 1) + 2)
    if models.columns is None:
        d = np.column_stack([np.ones(len(x)), x])
        return v.T @ (d[:, i] * d[:, j])
    d = _gathered(x, models)
    d = np.concatenate([np.ones((*d.shape[:2], 1)), d], axis=2)
    return np.stack([(v * d[:, :, a] * d[:, :, b]).sum(axis=0) for a, b in zip(i.tolist(), j.tolist(), strict=True)], axis=1)


def _summed(blocks: Blocks, models: Models, work: Callable[[_Block, Models, np.ndarray], np.ndarray], finish: Callable[[int, np.ndarray, np.ndarray | None], dict], kept: DataFrame | None = None) -> DataFrame:
    """Sums of ``work`` (models of a chunk, numbers) over all blocks, handed to ``finish`` once for each chunk: (chunk, numbers, kept) rows."""

    centre = blocks.centre
    table, slices = spread(blocks, -(-len(models) // CHUNK))

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in _read(batches, centre):
            for at in range(b.slice * CHUNK, len(models), slices * CHUNK):
                own = np.arange(at, min(len(models), at + CHUNK))
                found = work(b, models.some(own), own)
                total[at // CHUNK] = total[at // CHUNK] + found if at // CHUNK in total else found
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([t.tobytes()], pa.binary())], ["chunk", "s"])

    parts = table.mapInArrow(run, "chunk bigint, s binary").groupBy("chunk")
    shape = "chunk bigint, numbers binary, kept binary"

    def total_of(frame: pd.DataFrame, old: bytes | None) -> pd.DataFrame:
        k = int(frame["chunk"].iloc[0])
        size = min(len(models), (k + 1) * CHUNK) - k * CHUNK
        numbers, keep = finish(k, sum(np.frombuffer(s).reshape(size, -1) for s in frame["s"]), None if old is None else np.frombuffer(old).reshape(size, -1))
        return pd.DataFrame({"chunk": [k], "numbers": [numbers.tobytes()], "kept": [None if keep is None else keep.tobytes()]})

    if kept is None:
        return parts.applyInPandas(lambda frame: total_of(frame, None), shape)
    return parts.cogroup(kept.select("chunk", "kept").groupBy("chunk")).applyInPandas(lambda a, b: total_of(a, b["kept"].iloc[0]), shape)


def spread(blocks: Blocks, chunks: int) -> tuple[DataFrame, int]:
    """The blocks, dealt over at least as many tasks as can run at once, and repeated for slices of the chunks of models where there are fewer blocks than that."""
    held, at_once = -(-blocks.n // blocks.rows), blocks.table.sparkSession.sparkContext.defaultParallelism
    slices = max(1, min(chunks, -(-TASKS * at_once // max(1, held))))
    if slices == 1:
        return blocks.table.repartition(max(1, min(held, TASKS * at_once)), "block"), 1
    table = blocks.table.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return table.repartition(min(held * slices, TASKS * at_once), "block", "slice"), slices


def _collected(table: DataFrame, models: int) -> np.ndarray:
    """Rows of numbers of all models, in order; bounded by the batch."""
    found = {r["chunk"]: np.frombuffer(r["numbers"]) for r in table.select("chunk", "numbers").collect()}
    return np.concatenate([found[k].reshape(min(models, (k + 1) * CHUNK) - k * CHUNK, -1) for k in sorted(found)])


def scaled(blocks: Blocks, models: Models, standardise: bool = True, slope: np.ndarray | None = None) -> Fits:
    """The scaling of every model from the weighted moments of its samples, and zero coefficients.

    ``slope`` (models, features) are slopes on the covariate to use instead of those of the models' own controls.
    """
    p, covariate = models.size(blocks.p), blocks.has_covariate

    def work(b: _Block, some: Models, _):
        w = b.weights(some)
        parts = [w.sum(axis=0)[:, None], (w * b.labels(some)).sum(axis=0)[:, None], _dot(w, b.x, some), _dot(w, b.x**2, some)]
        if covariate:
            crossed = b.x * b.x[:, -1:]
            parts.append(_dot(w, crossed, some))
            w = w * (b.labels(some) == 0)
            parts += [w.sum(axis=0)[:, None], _dot(w, b.x, some), _dot(w, crossed, some)]
        return np.concatenate(parts, axis=1)

    sums = _collected(_summed(blocks, models, work, lambda k, s, _: (s, None)), len(models))
    cuts = np.cumsum([1, 1, p + 1, p + 1, *([p + 1, 1, p + 1, p + 1] if covariate else [])])
    n, cases, one, two, *rest = np.split(sums, cuts[:-1], axis=1)
    safe = np.maximum(n, 1)
    mean, square = one / safe, two / safe
    given, slope, offset = slope, np.zeros((len(models), p)), np.zeros((len(models), p))
    variance = square[:, :p] - mean[:, :p] ** 2
    if covariate:
        cross, n0, one0, cross0 = rest
        n0 = np.maximum(n0, 1)
        m0 = one0 / n0
        down = cross0[:, -1:] / n0 - m0[:, -1:] ** 2
        slope = np.divide(cross0[:, :p] / n0 - m0[:, :p] * m0[:, -1:], down, out=slope, where=down > 0) if given is None else given
        offset = m0[:, :p] - slope * m0[:, -1:]
        cov = cross[:, :p] / safe - mean[:, :p] * mean[:, -1:]
        variance = variance - 2 * slope * cov + slope**2 * (square[:, -1:] - mean[:, -1:] ** 2)
    variance = np.where(variance > 1e-12 * np.maximum(square[:, :p], 1e-300), variance, 0.0)
    if standardise:
        shift = mean[:, :p] - slope * mean[:, -1:] if covariate else mean[:, :p]
    else:
        shift = offset if covariate else -(blocks.centre[:p] if models.columns is None else blocks.centre[models.columns]) + np.zeros_like(slope)
    scale = np.where(variance > 0, np.sqrt(variance), 1.0) if standardise else np.ones_like(variance)
    return Fits(np.zeros((len(models), p + 1)), shift, slope, scale, variance * n / np.maximum(n - 1, 1), n[:, 0], cases[:, 0])


def _pairs(q: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(q)


def _descend(g: np.ndarray, h: np.ndarray, beta: np.ndarray, lam: np.ndarray, sweeps: int = 500, tol: float = 1e-13) -> np.ndarray:
    """Coordinate descent for min g d + d h d / 2 + lam |beta + d|, all models of a chunk at once: the step d."""
    d, hd = np.zeros_like(beta), np.zeros_like(beta)
    diagonal = np.maximum(np.einsum("mii->mi", h), 1e-300)
    for _ in range(sweeps):
        largest = np.zeros(len(beta))
        for j in range(beta.shape[1]):
            at = beta[:, j] + d[:, j]
            target = at - (g[:, j] + hd[:, j]) / diagonal[:, j]
            new = np.sign(target) * np.maximum(np.abs(target) - lam[:, j] / diagonal[:, j], 0.0)
            step = np.where(diagonal[:, j] > 1e-200, new - at, 0.0)
            if step.any():
                d[:, j] += step
                hd += h[:, :, j] * step[:, None]
                largest = np.maximum(largest, np.abs(step))
        if largest.max() <= tol * max(1.0, float(np.abs(beta).max())):
            break
    return d


def fit(blocks: Blocks, models: Models, penalty: str = "l1", penalise_first: bool = True, standardise: bool = True, start: Fits | None = None, max_passes: int = MAX_PASSES) -> Fits:
    """Minimise, for every model, the weighted logistic loss plus |b| / c (``l1``) or |b|^2 / (2 c) (``l2``); c infinite: none.

    ``penalise_first`` counts the intercept as a coefficient like any other. Features with no spread, or not allowed, stay at zero.
    Batches above the byte limit are fitted one after the other.
    """
    q = models.size(blocks.p) + 1
    most = max(CHUNK, int(BATCH_BYTES // (8 * (q * (q + 1) // 2 + 4 * q))) // CHUNK * CHUNK)
    if len(models) > most:
        parts = [np.arange(i, min(len(models), i + most)) for i in range(0, len(models), most)]
        own = lambda at: None if start is None else Fits(**{f: getattr(start, f)[at] for f in ("beta", "shift", "slope", "scale", "variance", "n", "cases")})
        done = [fit(blocks, models.some(at), penalty, penalise_first, standardise, own(at), max_passes) for at in parts]
        whole = {f: np.concatenate([getattr(d, f) for d in done]) for f in ("beta", "shift", "slope", "scale", "variance", "n", "cases", "kkt")}
        return Fits(**whole, passes=max(d.passes for d in done))
    spark = blocks.table.sparkSession
    fits = scaled(blocks, models, standardise) if start is None else start
    m = len(models)
    if models.columns is None and models.label is None and not fits.beta.any():
        # replicates and folds of one penalty start from the fit of all samples: few second derivatives are needed from there
        penalties, which = np.unique(models.c, return_inverse=True)
        if m >= 4 * len(penalties):
            whole = fit(blocks, Models.of(len(penalties), c=penalties), penalty, penalise_first, standardise)
            fits.beta = np.where((fits.cases > 0) & (fits.cases < fits.n), 1.0, 0.0)[:, None] * whole.beta[which]
            fits.beta[:, 1:] *= (fits.variance > 0) & (models.allowed if models.allowed is not None else True)
    free = np.concatenate([np.ones((m, 1), bool), (fits.variance > 0) & (models.allowed if models.allowed is not None else True)], axis=1)
    lam = np.broadcast_to(np.where(np.isinf(models.c), 0.0, 1.0 / models.c)[:, None], (m, q)).copy()
    if not penalise_first:
        lam[:, 0] = 0.0
    upper = _pairs(q)
    state = {
        "beta": fits.beta.copy(), "before": fits.beta.copy(), "objective": np.full(m, np.inf), "kkt": np.full(m, np.inf), "done": (fits.cases == 0) | (fits.cases == fits.n),
        # a single class has no finite fit; its coefficients stay at zero
    }
    old, old_path, fresh, used = None, None, True, 0
    for passes in range(1, max_passes + 1):
        used = passes
        now = replace(fits, beta=state["beta"])
        sent = spark.sparkContext.broadcast({**state, "raw": now.raw(), "lam": lam, "free": free, "shift": fits.shift, "slope": fits.slope, "scale": fits.scale, "n": fits.n})

        def work(b: _Block, some: Models, at, sent=sent, fresh=fresh):
            s = sent.value
            live = ~s["done"][at]
            out = np.zeros((len(at), 2 + q + (q + 1) * (q + 2) // 2 if fresh else 2 + q))
            if not live.any():
                return out
            own = some.some(live)
            raw = s["raw"][at[live]]
            w = b.weights(own)
            eta = _eta(b.x, own, raw)
            tail = np.exp(-np.abs(eta))
            prob = np.where(eta >= 0, 1.0, tail) / (1.0 + tail)
            y = b.labels(own)
            r = w * (y - prob)
            loss = (w * (np.log1p(tail) + np.maximum(eta, 0.0) - y * eta)).sum(axis=0)
            parts = [loss[:, None], r.sum(axis=0)[:, None], _dot(r, b.x, own)]
            if fresh:
                parts.append(_second(w * prob * (1.0 - prob), b.x, own))
            out[live] = np.concatenate(parts, axis=1)
            return out

        def finish(k, sums, kept, sent=sent, fresh=fresh):
            s = sent.value
            at = np.arange(k * CHUNK, k * CHUNK + len(sums))
            own = {n: s[n][at] for n in ("beta", "before", "objective", "kkt", "done", "lam", "free", "shift", "slope", "scale", "n")}
            g = np.column_stack([sums[:, 1], (sums[:, 2 : 2 + q - 1] - own["shift"] * sums[:, 1:2] - own["slope"] * sums[:, 1 + q : 2 + q]) / own["scale"]])
            g = np.where(own["free"], -g, 0.0)
            if fresh:
                kept = _scaled_second(sums[:, 2 + q :], own["shift"], own["slope"], own["scale"], own["free"], q)[:, upper[0], upper[1]]
            return _moved(own, sums[:, 0], g, kept, penalty, q), kept if fresh else None

        table = _summed(blocks, models, work, finish, None if fresh else old)
        path = scratch_path(spark, "fits")
        table.write.parquet(path)
        table = spark.read.schema("chunk bigint, numbers binary, kept binary").parquet(path)
        if fresh:
            if old_path:
                discard(spark, old_path)
            old, old_path = table, path
        numbers = _collected(table, m)
        before = state["kkt"]
        state = {"beta": numbers[:, :q], "before": numbers[:, q : 2 * q], "objective": numbers[:, 2 * q], "kkt": numbers[:, 2 * q + 1], "done": numbers[:, 2 * q + 2] > 0}
        sent.unpersist()
        if path != old_path:
            discard(spark, path)
        if state["done"].all():
            break
        live = ~state["done"]
        fresh = bool((state["kkt"][live] > 0.2 * before[live]).any()) and passes > 1 if not fresh else False
    if old_path:
        discard(spark, old_path)
    fits.beta, fits.kkt, fits.passes = state["beta"], state["kkt"], used
    return fits


def _scaled_second(flat: np.ndarray, shift: np.ndarray, slope: np.ndarray, scale: np.ndarray, free: np.ndarray, q: int) -> np.ndarray:
    """Second derivatives by [1, scaled features] from those by [1, columns, covariate]."""
    i, j = _pairs(q + 1)
    full = np.zeros((len(flat), q + 1, q + 1))
    full[:, i, j] = flat
    full[:, j, i] = flat
    # columns of the scaled design are those of the raw one less shift times the constant and slope times the covariate
    a = full[:, :, 1:q] - full[:, :, :1] * shift[:, None, :] - full[:, :, q:] * slope[:, None, :]
    a = np.concatenate([full[:, :, :1], a / scale[:, None, :]], axis=2)
    b = a[:, 1:q, :] - a[:, :1, :] * shift[:, :, None] - a[:, q:, :] * slope[:, :, None]
    b = np.concatenate([a[:, :1, :], b / scale[:, :, None]], axis=1)
    return b * (free[:, :, None] & free[:, None, :])


def _moved(s: dict, loss: np.ndarray, g: np.ndarray, flat: np.ndarray, penalty: str, q: int) -> np.ndarray:
    """Next coefficients of a chunk: (beta, before, objective, kkt, done)."""
    beta, lam, n = s["beta"], s["lam"], np.maximum(s["n"], 1.0)
    if penalty == "l1":
        objective = loss + (lam * np.abs(beta)).sum(axis=1)
        residual = np.where(beta != 0, np.abs(g + lam * np.sign(beta)), np.maximum(np.abs(g) - lam, 0.0))
    else:
        objective = loss + 0.5 * (lam * beta**2).sum(axis=1)
        residual = np.abs(g + lam * beta)
    kkt = np.where(s["free"], residual, 0.0).max(axis=1) / n
    worse = objective > s["objective"] + 1e-12 * np.maximum(1.0, np.abs(s["objective"]))
    half = (beta + s["before"]) / 2
    stuck = worse & (np.abs(half - beta).max(axis=1) <= 1e-12)
    worse &= ~stuck
    done = s["done"] | (~worse & (kkt <= TOLERANCE)) | stuck
    h = np.zeros((len(beta), q, q))
    i, j = _pairs(q)
    h[:, i, j] = flat
    h[:, j, i] = flat
    go = ~done & ~worse
    step = np.zeros_like(beta)
    if go.any():
        if penalty == "l1":
            step[go] = _descend(g[go], h[go], beta[go], lam[go])
        else:
            full = h[go] + lam[go][:, None, :] * np.eye(q)
            idle = np.einsum("mii->mi", full) <= 0
            full[idle[:, :, None] & np.eye(q, dtype=bool)] = 1.0
            step[go] = -np.stack([np.linalg.lstsq(f, v, rcond=None)[0] for f, v in zip(full, g[go] + lam[go] * beta[go], strict=True)])
        step *= np.minimum(1.0, 5.0 / np.maximum(np.abs(step).max(axis=1), 1e-300))[:, None]
    new = np.where(worse[:, None], half, beta + step)
    before = np.where(worse[:, None], s["before"], beta)
    held = np.where(worse, s["objective"], objective)
    return np.column_stack([np.where(done[:, None], beta, new), before, held, np.where(s["done"], s["kkt"], kkt), done])


def scored(blocks: Blocks, models: Models, fits: Fits, which: str = "held", key: str = "sample_id") -> DataFrame:
    """(model, key, y, probability) for the samples of the fold a model leaves out (``held``), or for all (``all``)."""
    sent = blocks.table.sparkSession.sparkContext.broadcast(fits.raw())
    kind = blocks.table.schema["keys"].dataType.elementType.simpleString()
    centre = blocks.centre

    def run(batches):
        raw = sent.value
        for b in _read(batches, centre):
            for at in range(0, len(models), CHUNK):
                own = np.arange(at, min(len(models), at + CHUNK))
                some = models.some(own)
                eta = _eta(b.x, some, raw[own])
                mask = b.left_out(some) if which == "held" else np.ones(eta.shape, bool)
                i, j = np.nonzero(mask)
                prob = 1.0 / (1.0 + np.exp(-np.clip(eta[i, j], -700, 700)))
                label = np.broadcast_to(b.labels(some), eta.shape)[i, j]
                yield pa.RecordBatch.from_arrays([pa.array(own[j], pa.int64()), b.keys.take(pa.array(i)), pa.array(label.astype(np.int32)), pa.array(prob)], ["model", key, "y", "probability"])

    return blocks.table.mapInArrow(run, f"model bigint, {key} {kind}, y int, probability double")


LEFT_TOLERANCE = 1e-9
LEFT_ROWS = 64
#: From so many samples on, the orders of a step to which the gradient is written out, one after the other.
LEFT_ORDERS = ((20_000, (2, 3)), (2_000, (3, 4)), (0, (4,)))


def _powers(q: int) -> list[list[tuple[int, ...]]]:
    """Places of the factors of all products of 2, 3, 4 and 5 of ``q`` numbers."""
    return [list(combinations_with_replacement(range(q), k)) for k in (2, 3, 4, 5)]


def _products(d: np.ndarray, places: list[tuple[int, ...]]) -> dict[tuple[int, ...], np.ndarray]:
    """The products of columns at ``places``, which begin with all shorter ones."""
    made: dict[tuple[int, ...], np.ndarray] = {}
    for at in places:
        made[at] = d[..., at[0]] if len(at) == 1 else made[at[:-1]] * d[..., at[-1]]
    return made


def leave_one_out(blocks: Blocks, models: Models, penalty: str = "l1", penalise_first: bool = True) -> DataFrame:
    """(grp, n1, n0, auc, average_precision, accuracy) of each model over the scores of ``left_scores``.

    One pass scores all models; those without a sample to refit are judged by it, only the others are scored again with their refits.
    """
    left = _LeftOut(blocks, models, penalty, penalise_first)
    first = cut(left.scored(np.arange(len(models))).groupBy("grp").applyInPandas(_judged_or_again, f"{JUDGED}, again binary"))
    done = first.filter("again IS NULL").drop("again")
    todo = np.array(sorted(r["grp"] for r in first.filter("again IS NOT NULL").select("grp").collect()), np.int64)
    if not len(todo):
        return done

    def pairs(batches):
        for batch in batches:
            for of, again in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.frombuffer(again, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), of), pa.int64()), pa.array(at)], ["model", "position"])

    again = first.filter("again IS NOT NULL").select("grp", "again").mapInArrow(pairs, "model bigint, position bigint")
    return done.unionByName(left.completed(todo, again).groupBy("grp").applyInPandas(_judged, JUDGED))


def left_scores(blocks: Blocks, models: Models, penalty: str = "l1", penalise_first: bool = True) -> DataFrame:
    """Packed held-out scores and labels of each model, every sample left out once and scaled without it.

    The fit of all samples is moved by what one sample takes with it. With u the sample's scaled row, the gradient without it is that of all
    samples, written out to up to fifth order around the full fit (sums of products of the scaled columns, one pass), less the sample's own
    term and with the penalty in the scaling without it; the second derivatives are downdated by the one row. A step count brings this to zero for all samples of a block at
    once, so a model costs one pass, not one for each sample. With more samples a step is shorter and lower orders will do: rows whose bound is too large at one
    order are taken to the next (``LEFT_ORDERS``). A sample is refitted from scratch in blocks where that is not good enough: where the bound on
    the rest beyond, carried to the held-out score, exceeds ``LEFT_TOLERANCE``, or where one class is left. Where under L1 a coefficient changes sign, enters or
    leaves, the same expansion is brought to the L1 conditions by coordinate descent, for that sample alone. Models take few columns.
    """
    left, every = _LeftOut(blocks, models, penalty, penalise_first), np.arange(len(models))
    return left.completed(every, cut(left.scored(every, "pairs")))


class _LeftOut:
    """The expansions of all models of a batch around their fits, with what moves them."""

    def __init__(self, blocks: Blocks, models: Models, penalty: str, penalise_first: bool):
        self.blocks, self.models, self.penalty, self.penalise_first = blocks, models, penalty, penalise_first
        spark = blocks.table.sparkSession
        self.fits = fits = fit(blocks, models, penalty, penalise_first)
        q, m, shared = models.size(blocks.p) + 1, len(models), models.columns is None
        self.orders = orders = next(steps for least, steps in LEFT_ORDERS if blocks.n >= least)
        powers = _powers(q)[: orders[-1]]
        places = [at for some in powers for at in some]
        self.terms = terms = [*((i,) for i in range(q)), *(at for some in powers[:-1] for at in some)]
        wanted = np.arange(blocks.p) if shared else models.columns
        # with the same columns all models have the same scaling
        own = (lambda v: v[:1]) if shared else (lambda v: v)
        scaling = spark.sparkContext.broadcast((fits.beta, own(fits.shift), own(fits.scale), own(fits.variance > 0), wanted))

        def design(b: _Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Coefficients (models, q) and scaled rows (models or 1, q, samples)."""
            beta, shift, scale, spread_out, columns = scaling.value
            if not shared:
                shift, scale, spread_out, columns = shift[at], scale[at], spread_out[at], columns[at]
            x = b.x[:, columns].T[:, None].swapaxes(0, 1) if shared else np.ascontiguousarray(b.x[:, columns].transpose(1, 2, 0))
            z = np.where(spread_out[:, :, None], (x - shift[:, :, None]) / scale[:, :, None], 0.0)
            return beta[at], np.concatenate([np.ones((len(z), 1, z.shape[2])), z], axis=1)

        self.design = design

        def work(b, some, at):
            beta, d = design(b, at)
            labels = b.labels(some).T
            total = np.zeros((len(at), q + len(places) + 2))
            for low in range(0, d.shape[2], LEFT_ROWS):
                cols = np.ascontiguousarray(d[:, :, low : low + LEFT_ROWS])
                p = 1.0 / (1.0 + np.exp(-np.clip((beta[:, None] @ cols)[:, 0], -700, 700)))
                v = p * (1.0 - p)
                weights = {2: v, 3: v * (1 - 2 * p), 4: v * (1 - 6 * p + 6 * p * p), 5: v * (1 - 2 * p) * (1 - 12 * p + 12 * p * p)}
                miss = p - labels[:, low : low + LEFT_ROWS]
                made = _products(np.moveaxis(cols, 1, 2), [*((i,) for i in range(q)), *places])
                total[:, :q] += miss @ cols[0].T if shared else np.einsum("mr,mqr->mq", miss, cols)
                if shared:
                    begin = q
                    for some_places in powers:
                        total[:, begin : begin + len(some_places)] += weights[len(some_places[0])] @ np.stack([made[at][0] for at in some_places], axis=1)
                        begin += len(some_places)
                else:
                    for k, at_places in enumerate(places):
                        total[:, q + k] += np.einsum("mr,mr->m", weights[len(at_places)], made[at_places])
                square = np.einsum("mqr,mqr->mr", cols, cols)
                total[:, -2] += (square**2).sum(axis=1)
                total[:, -1] += (square**3).sum(axis=1)
            return total

        sums = _collected(_summed(blocks, models, work, lambda k, s, _: (s, None)), m)
        grad, *rest, fourth, sixth = np.split(sums, np.cumsum([q, *map(len, powers), 1]), axis=1)
        lam = np.where(np.isinf(models.c), 0.0, 1.0 / models.c)
        first = lam * (1.0 if penalise_first else 0.0)
        active = fits.beta != 0 if penalty == "l1" else np.concatenate([np.ones((m, 1), bool), fits.variance > 0], axis=1)
        second = np.zeros((m, q, q))
        for k, (i, j) in enumerate(powers[0]):
            second[:, i, j] = second[:, j, i] = rest[0][:, k]
        if penalty == "l2":
            second[:, np.arange(q), np.arange(q)] += np.column_stack([first, np.repeat(lam[:, None], q - 1, axis=1)])
        kept = second * (active[:, :, None] & active[:, None, :]) + np.eye(q) * ~active[:, :, None]
        inverse = np.linalg.pinv(kept) * (active[:, :, None] & active[:, None, :])
        norm = np.linalg.norm(inverse, 2, axis=(1, 2))
        # the same with every coefficient that can move, for samples whose L1 pattern is another
        free = np.concatenate([np.ones((m, 1), bool), fits.variance > 0], axis=1)
        both = free[:, :, None] & free[:, None, :]
        whole = np.linalg.pinv(second * both + np.eye(q) * ~free[:, :, None]) * both
        # coefficients of the gradient's expansion by the products of a step: (models, q, products)
        expansion = np.ascontiguousarray(_expansion(rest, q).transpose(0, 2, 1))
        # what the terms beyond an order can be for a step of length one: derivatives of the logistic are at most 1 / 8, 0.131 and 1 / 4
        beyond = np.stack([fourth[:, 0] / 48, np.sqrt(fourth * sixth)[:, 0] * 0.131 / 24, sixth[:, 0] / 480], axis=1)
        self.sent = spark.sparkContext.broadcast((grad, expansion, inverse, norm, beyond, lam, first, active, fits.n, fits.cases))
        self.other = spark.sparkContext.broadcast((second, whole, np.linalg.norm(whole, 2, axis=(1, 2))))

    def __getstate__(self) -> dict:
        """What tasks need; the tables and the fits of all models stay in the driver."""
        return {name: v for name, v in self.__dict__.items() if name not in ("blocks", "fits")}

    def moved(self, b: _Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Held-out scores (models, samples), whether they are good enough, and labels."""
        beta, d = self.design(b, at)
        y = np.broadcast_to(b.labels(self.models.some(at)).T, (len(at), d.shape[2]))
        eta, good = np.empty(y.shape), np.zeros(y.shape, bool)
        rows = np.arange(y.shape[1])
        for order in self.orders:
            found = [self._moved_rows(beta, d[:, :, some], y[:, some], at, order) for some in (rows[i : i + LEFT_ROWS] for i in range(0, len(rows), LEFT_ROWS))]
            if not found:
                break
            eta[:, rows], good[:, rows], close = (np.concatenate(p, axis=1) for p in zip(*found, strict=True))
            rows = rows[~close.all(axis=0)]
        return eta, good, y

    def _moved_rows(self, beta: np.ndarray, d: np.ndarray, y: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for some rows with the expansion to an order, and whether the bound on the terms beyond is met."""
        grad, expansion, inverse, norm, beyond, lam, first, active, n, cases = (v[at] for v in self.sent.value)
        l1 = self.penalty == "l1"
        m, q = beta.shape
        terms = [t for t in self.terms if len(t) <= order]
        number = {t: k for k, t in enumerate(terms)}
        expansion = expansion[:, :, : len(terms)]
        made = np.empty((m, len(terms), d.shape[2]))
        z = d[:, 1:]
        count = n[:, None, None]
        less = -z / (count - 1.0)  # the mean without the sample, in units of the scaling with it
        ratio = np.sqrt(np.maximum((count - z * z) / (count - 1.0) - less * less, 1e-12))
        sign = np.sign(beta)[:, :, None]
        penal, start, on = lam[:, None, None], first[:, None], active[:, :, None]
        step = np.zeros((m, q, d.shape[2]))
        p = 1.0 / (1.0 + np.exp(-np.clip((beta[:, None] @ d)[:, 0], -700, 700)))
        v = p * (1.0 - p)
        down = inverse @ (d * on)
        left = 1.0 - v * (d * down).sum(axis=1)
        # an intercept held at zero by L1 is zero in the scaling without the sample
        pinned = l1 & (beta[:, 0] == 0) & (first > 0)
        for turn in range(12):
            now = beta[:, :, None] + step
            if np.any(pinned):
                now[pinned, 0] = -(less * now[:, 1:]).sum(axis=1)[pinned]
                step = now - beta[:, :, None]
            if turn or np.any(pinned):
                made[:, :q] = step
                for k, t in enumerate(terms[q:], q):
                    np.multiply(made[:, number[t[:-1]]], step[:, t[-1]], out=made[:, k])
                smooth = expansion @ made + grad[:, :, None]
            else:
                smooth = np.broadcast_to(grad[:, :, None], step.shape)
            own = 1.0 / (1.0 + np.exp(-np.clip((d * now).sum(axis=1), -700, 700))) - y
            smooth = smooth - own[:, None] * d
            if l1:
                level = np.where(pinned[:, None], -smooth[:, 0], start * sign[:, 0])[:, None]
                extra = np.concatenate([level, level * less + penal * sign[:, 1:] * ratio], axis=1)
            else:
                level = (start * (now[:, 0] + (less * now[:, 1:]).sum(axis=1)))[:, None]
                extra = np.concatenate([level, level * less + penal * ratio**2 * now[:, 1:]], axis=1)
            f = (smooth + extra) * on
            if not f.size or np.abs(f).max() <= 1e-13 * n.max():
                break
            back = inverse @ f
            step = step - back - down * (v * (d * back).sum(axis=1) / np.maximum(left, 1e-6))[:, None]
        now = beta[:, :, None] + step
        rest = beyond[:, order - 2, None] * np.linalg.norm(step, axis=1) ** (order + 1) + np.abs(f).max(axis=1)
        close = rest * norm[:, None] / np.maximum(left, 1e-6) * np.linalg.norm(d, axis=1) <= LEFT_TOLERANCE
        good = close & (left > 0.05)
        rest_cases = cases[:, None] - y
        good &= (rest_cases > 0) & (rest_cases < n[:, None] - 1)
        if l1:
            level = now[:, 0] + (less * now[:, 1:]).sum(axis=1)
            same = np.where(pinned[:, None], np.abs(smooth[:, 0]) <= start * (1 - 1e-9), np.sign(level) == sign[:, 0])
            same = same | (start == 0)
            same &= np.where(on[:, 1:], np.sign(now[:, 1:]) == sign[:, 1:], True).all(axis=1)
            outside = np.abs(smooth[:, 1:] - less * smooth[:, :1]) / ratio
            same &= np.where(on[:, 1:] | (z == 0), True, outside <= penal * (1 - 1e-9)).all(axis=1)
            eta = (d * now).sum(axis=1)
            j, i = np.nonzero(~same & (rest_cases > 0) & (rest_cases < n[:, None] - 1))
            good &= same
            if len(j):
                u = d[j if len(d) == m else np.zeros_like(j), :, i]
                eta[j, i], good[j, i], close[j, i] = self._other_pattern(beta[j], u, y[j, i], at[j], order)
            return eta, good, close
        return (d * now).sum(axis=1), good, close

    def _other_pattern(self, beta: np.ndarray, d: np.ndarray, y: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for (model, sample) pairs under L1 where a coefficient changes sign, enters or leaves: coefficients and scaled rows are (pairs, q).

        Coordinate descent, in the scaling without the sample, brings the expansion to the L1 conditions in any pattern. All coefficients that can move
        count in the bound, so it holds for every pattern: the loss is as convex as its second derivatives without the row.
        """
        grad, expansion, _, _, beyond, lam, first, _, n, _ = (v[at] for v in self.sent.value)
        second, inverse, norm = (v[at] for v in self.other.value)
        pairs, q = beta.shape
        terms = [t for t in self.terms if len(t) <= order]
        number = {t: k for k, t in enumerate(terms)}
        expansion = expansion[:, :, : len(terms)]
        made = np.empty((pairs, len(terms)))
        z, count = d[:, 1:], n[:, None]
        less = -z / (count - 1.0)
        ratio = np.sqrt(np.maximum((count - z * z) / (count - 1.0) - less * less, 1e-12))
        # coefficients in the scaling with the sample by those without it
        back = np.zeros((pairs, q, q))
        back[:, 0, 0], back[:, 0, 1:] = 1.0, -less / ratio
        back[:, np.arange(1, q), np.arange(1, q)] = 1.0 / ratio
        p = 1.0 / (1.0 + np.exp(-np.clip((beta * d).sum(axis=1), -700, 700)))
        v = p * (1.0 - p)
        left = 1.0 - v * np.einsum("pi,pij,pj->p", d, inverse, d)
        h = back.swapaxes(1, 2) @ (second - v[:, None, None] * d[:, :, None] * d[:, None, :]) @ back
        levels = np.column_stack([first, np.repeat(lam[:, None], q - 1, axis=1)])
        own = np.column_stack([np.where((beta[:, 0] == 0) & (first > 0), 0.0, beta[:, 0] + (less * beta[:, 1:]).sum(axis=1)), beta[:, 1:] * ratio])
        for _ in range(12):
            now = np.einsum("pij,pj->pi", back, own)
            made[:, :q] = now - beta
            for k, t in enumerate(terms[q:], q):
                np.multiply(made[:, number[t[:-1]]], made[:, t[-1]], out=made[:, k])
            miss = 1.0 / (1.0 + np.exp(-np.clip((d * now).sum(axis=1), -700, 700))) - y
            smooth = np.einsum("pij,pj->pi", expansion, made) + grad - miss[:, None] * d
            g = np.einsum("pij,pi->pj", back, smooth)
            f = np.where(own != 0, g + levels * np.sign(own), np.sign(g) * np.maximum(np.abs(g) - levels, 0.0))
            # rows that carry nearly all of a coefficient's curvature stay where they are: they are refitted
            live = (left > 0.05) & (np.abs(f).max(axis=1) > 1e-13 * n)
            if not live.any():
                break
            own[live] += _descend(g[live], h[live], own[live], levels[live])
        step = now - beta
        f = np.column_stack([f[:, 0], ratio * f[:, 1:] + less * f[:, :1]])
        rest = beyond[:, order - 2] * np.linalg.norm(step, axis=1) ** (order + 1) + np.linalg.norm(f, axis=1)
        close = rest * norm / np.maximum(left, 1e-6) * np.linalg.norm(d, axis=1) <= LEFT_TOLERANCE
        return (d * now).sum(axis=1), close & (left > 0.05), close

    def scored(self, chosen: np.ndarray, which: str = "both") -> DataFrame:
        """Packed scores of the chosen models where they are good enough (``scores``), the (model, position) ``pairs`` to refit, or ``both`` packed by model."""
        table, slices = spread(self.blocks, -(-len(chosen) // CHUNK))
        centre = self.blocks.centre

        def run(batches):
            for b in _read(batches, centre):
                for at in range(b.slice * CHUNK, len(chosen), slices * CHUNK):
                    own = chosen[at : at + CHUNK]
                    eta, good, y = self.moved(b, own)
                    j, i = np.nonzero(good)
                    again, place = np.nonzero(~good)
                    if which == "pairs":
                        yield pa.RecordBatch.from_arrays([pa.array(own[again], pa.int64()), pa.array(place + b.first, pa.int64())], ["model", "position"])
                        continue
                    if len(i):
                        packed = _packed_scores(own[j], eta[j, i], y[j, i])
                        yield packed if which == "scores" else packed.append_column("again", pa.nulls(packed.num_rows, pa.binary()))
                    if which == "both" and len(again):
                        used, begin = np.unique(again, return_index=True)
                        places = [(p + b.first).astype(np.int64).tobytes() for p in np.split(place, begin[1:])]
                        empty = pa.array([b""] * len(used), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(own[used], pa.int64()), empty, empty, pa.array(places, pa.binary())], ["grp", "s", "l", "again"])

        shape = {"scores": PACKED_SCORES, "pairs": "model bigint, position bigint", "both": f"{PACKED_SCORES}, again binary"}[which]
        return table.mapInArrow(run, shape)

    def completed(self, chosen: np.ndarray, again: DataFrame) -> DataFrame:
        """Packed scores of the chosen models with those of the (model, position) pairs to refit."""
        blocks, models, fits = self.blocks, self.models, self.fits
        spark = blocks.table.sparkSession
        parts = self.scored(chosen, "scores")
        left = again.count()
        # refits in bounded rounds, so the driver holds the coefficients of one round at a time
        at_once = max(1, int(BATCH_BYTES // (8 * (12 * (models.size(blocks.p) + 1)))))
        rounds = -(-left // at_once)
        for k in range(rounds):
            rows = again.filter(F.pmod(F.xxhash64("model", "position"), F.lit(rounds)) == k).orderBy("model", "position").toPandas()
            of = rows["model"].to_numpy()
            one = models.some(of)
            refits = Models(one.c, one.boot, np.full(len(of), ALONE), rows["position"].to_numpy(), one.allowed, one.columns, one.label)
            start = scaled(blocks, refits)
            start.beta = fits.beta[of].copy()
            done = fit(blocks, refits, self.penalty, self.penalise_first, start=start)
            path = scratch_path(spark, "left")
            _held_scores(blocks, refits, done, of).write.parquet(path)
            parts = parts.unionByName(spark.read.schema(PACKED_SCORES).parquet(path))
        return parts


def _expansion(sums: list[np.ndarray], q: int) -> np.ndarray:
    """(models, products of 1 to 4 of a step, q): the Taylor series of the gradient from the sums of products of 2 to 5 columns, or fewer of both."""
    powers = _powers(q)[: len(sums)]
    number = [{at: k for k, at in enumerate(places)} for places in powers]
    terms = [(i,) for i in range(q)] + [at for some in powers[:-1] for at in some]
    out = np.zeros((len(sums[0]), len(terms), q))
    for k, at in enumerate(terms):
        order = len(at) - 1
        ways = 1.0 / np.prod([math.factorial(at.count(i)) for i in set(at)])  # of the 1 / order! orderings of the factors
        for j in range(q):
            out[:, k, j] = ways * sums[order][:, number[order][tuple(sorted((*at, j)))]]
    return out


PACKED_SCORES = "grp bigint, s binary, l binary"
JUDGED = "grp bigint, n1 bigint, n0 bigint, auc double, average_precision double, accuracy double"


def _packed_scores(of: np.ndarray, score: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """One row for each group: its scores and labels as bytes."""
    order = np.argsort(of, kind="stable")
    used, begin = np.unique(of[order], return_index=True)
    cuts = [order[a:z] for a, z in zip(begin, [*begin[1:], len(order)], strict=True)]
    label = label.astype(np.uint8)
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([score[c].tobytes() for c in cuts], pa.binary()), pa.array([label[c].tobytes() for c in cuts], pa.binary())], ["grp", "s", "l"])


def _judged_or_again(frame: pd.DataFrame) -> pd.DataFrame:
    """Metrics of a group, or the positions of its samples that are to be refitted."""
    again = b"".join(a for a in frame["again"] if a is not None)
    if not again:
        return _judged(frame).assign(again=None)
    return pd.DataFrame({"grp": [frame["grp"].iloc[0]], "n1": [None], "n0": [None], "auc": [None], "average_precision": [None], "accuracy": [None], "again": [again]})


def _judged(frame: pd.DataFrame) -> pd.DataFrame:
    """Metrics of the packed scores of one group."""
    score, label = np.frombuffer(b"".join(frame["s"])), np.frombuffer(b"".join(frame["l"]), np.uint8).astype(bool)
    # as probabilities, so that scores that saturate tie
    prob = 1.0 / (1.0 + np.exp(-np.clip(score, -700, 700)))
    order = np.argsort(-prob, kind="stable")
    prob, label = prob[order], label[order]
    last = np.flatnonzero(np.append(prob[1:] != prob[:-1], True))
    tp, fp = np.cumsum(label)[last].astype(float), np.cumsum(~label)[last].astype(float)
    n1, n0 = tp[-1], fp[-1]
    p, f = np.append(0, tp[:-1]), np.append(0, fp[:-1])
    area = float(((fp - f) * (tp + p)).sum() / (2 * n1 * n0)) if n1 * n0 else None
    precision = float(((tp - p) * tp / (tp + fp)).sum() / n1) if n1 else None
    return pd.DataFrame({"grp": [frame["grp"].iloc[0]], "n1": [int(n1)], "n0": [int(n0)], "auc": [area], "average_precision": [precision], "accuracy": [float(((prob >= 0.5) == label).mean())]})


def areas(blocks: Blocks, models: Models, fits: Fits, group: np.ndarray | None = None, which: str = "held", key: str = "sample_id") -> DataFrame:
    """(grp, n1, n0, auc, average_precision, accuracy) over the scores of ``scored``, pooled over the models of a group (by default each its own).

    Scores travel packed, an array for each block and group, and a group's are sorted in one task; beyond ``PACKED`` samples they are rows, ranked in ranges.
    """
    group = np.arange(len(models)) if group is None else group
    spark = blocks.table.sparkSession
    if blocks.n > PACKED:
        tags = tagged(spark, len(models), grp=("bigint", group)).withColumnRenamed("model", "_m")
        rows = cut(scored(blocks, models, fits, which, key).join(small(tags), F.col("model") == F.col("_m")).select("grp", "y", "probability"))
        hit = rows.groupBy("grp").agg(F.avg(((F.col("probability") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"))
        out = auc(rows, ["grp"], "probability", "y").join(average_precision(rows, ["grp"], "probability", "y"), "grp").join(hit, "grp")
        return out.select("grp", "n1", "n0", "auc", "average_precision", "accuracy")
    return _held_scores(blocks, models, fits, group, which).groupBy("grp").applyInPandas(_judged, JUDGED)


def _held_scores(blocks: Blocks, models: Models, fits: Fits, group: np.ndarray, which: str = "held") -> DataFrame:
    """Packed scores and labels by block and group."""
    sent = blocks.table.sparkSession.sparkContext.broadcast(fits.raw())
    centre = blocks.centre
    table, slices = spread(blocks, -(-len(models) // CHUNK))

    def run(batches):
        raw = sent.value
        for b in _read(batches, centre):
            for at in range(b.slice * CHUNK, len(models), slices * CHUNK):
                own = np.arange(at, min(len(models), at + CHUNK))
                some = models.some(own)
                eta = _eta(b.x, some, raw[own])
                mask = b.left_out(some) if which == "held" else np.ones(eta.shape, bool)
                j, i = np.nonzero(mask.T)
                if len(i):
                    label = np.broadcast_to(b.labels(some), eta.shape)[i, j]
                    yield _packed_scores(group[own[j]], eta[i, j], label)

    return table.mapInArrow(run, PACKED_SCORES)


def tagged(spark: SparkSession, models: int, **tags: tuple[str, Sequence]) -> DataFrame:
    """(model, tags): what the models of a batch stand for; ``tags`` are (type, values)."""
    rows = [(i, *(v[i].item() if isinstance(v[i], np.generic) else v[i] for _, v in tags.values())) for i in range(models)]
    return spark.createDataFrame(rows, "model bigint" + "".join(f", {c} {kind}" for c, (kind, _) in tags.items()))


def coefficients(spark: SparkSession, fits: Fits, names: Sequence[str]) -> DataFrame:
    """(model, feature, coefficient): scaled coefficients without the intercept, exploded on Spark from one row a model."""
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(fits.beta[:, 1:].tolist())], "model bigint, b array<double>")
    return rows.select("model", F.posexplode("b").alias("_i", "coefficient")).select("model", F.element_at(F.lit(list(names)), F.col("_i") + 1).alias("feature"), "coefficient")
