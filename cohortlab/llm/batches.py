"""Helpers for Arrow tasks: bounded slices of a batch, added columns, vectorised word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, types as T

SLICE_BYTES = 4 << 20
BATCH_ROWS = 2000

# fixed values: the additive and multiplicative constants of the splitmix64 generator
GOLDEN = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose ``column`` holds at most ``limit`` bytes (one longer value stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def bounded(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to SLICE_BYTES and BATCH_ROWS, so that a task never has many long texts in memory at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def extended(df: DataFrame, column: str, added: str, work: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """``df`` with the columns of the DDL ``added``.

    ``work()`` runs once in a task and returns a function from a slice to the new
    values by name. Input columns of the same names are replaced.
    """
    bounded(df.sparkSession)
    new = T.StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name.lower() not in {x.name.lower() for x in new.fields}]
    names, fields = [f.name for f in kept], [f.name for f in new.fields]
    types = [_arrow_type(f.dataType) for f in new.fields]
    source = df if column in names else df.withColumn("__text", df[column])
    read = column if column in names else "__text"

    def run(batches):
        step = work()
        for batch in sliced(batches, read):
            made = step(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [x if isinstance(x := made[n], pa.Array) else pa.array(x, t) for n, t in zip(fields, types, strict=True)],
                names + fields,
            )

    return source.select(*names, *([] if read in names else [read])).mapInArrow(run, T.StructType(kept + new.fields))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
    }[kind.simpleString()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value for each 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def odd_steps(n: int, seed: int) -> np.ndarray:
    """``n`` odd multipliers, the same on every machine."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(GOLDEN)) | np.uint64(1)


class WordHasher:
    """64-bit hashes of the words of a text column, without a Python object for any word.

    Words are runs of bytes outside space and 0x09-0x0D; UTF-8 keeps those bytes
    out of every other character. A byte's value times a power of an odd base is summed
    up, so the hash of a word is a difference of two sums over the power at its start.
    """

    def __init__(self, lower: bool = False, size: int = 1 << 20):
        code = np.arange(256, dtype=np.uint64)
        if lower:
            code[65:91] += np.uint64(32)
        self.value = mixed((code + np.uint64(1)) * np.uint64(GOLDEN))
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True
        self.base = int(odd_steps(1, 7)[0])
        self.size = size
        self.up, self.down = self.powers(size)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = pow(self.base, -1, 1 << 64)
        grown = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (self.base, inverse)]
        return grown[0], grown[1]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each row's words begin (one more entry than rows)."""
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        rows = np.concatenate([[0], ends])
        if rows[-1] == 0:
            return np.empty(0, np.uint64), np.zeros(len(rows), np.int64)
        first = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
        data = np.frombuffer(column.buffers()[2], np.uint8)[first : first + rows[-1]]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[rows] = True
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = ~self.blank[data]
        starts = np.flatnonzero(word[1:-1] & (~word[:-2] | fresh[:-1]))
        stops = np.flatnonzero(word[1:-1] & (~word[2:] | fresh[1:])) + 1
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(stops, base + self.size, "right")))
            part = data[base : stops[j - 1]]
            up, down = (self.up, self.down) if len(part) <= self.size else self.powers(len(part))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.value[part] * up[: len(part)], out=total[1:])
            a, b = starts[i:j] - base, stops[i:j] - base
            out[i:j] = (total[b] - total[a]) * down[a]
            i = j
        return mixed(out), np.searchsorted(starts, rows)


def windows(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words of the array (row limits are the caller's business)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, step in enumerate(odd_steps(size, seed)):
        total += words[k : k + n] * step
    return mixed(total)
