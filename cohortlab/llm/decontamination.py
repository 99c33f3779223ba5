"""Benchmark decontamination by Wu-Manber search over words.

Words are runs of 0-9, a-z and non-ASCII characters after A-Z are lower-cased. The test strings
are the windows of ``window`` consecutive words of the benchmark items; an item of fewer words is
one window. Strings of one length m share a shift table from a block of two words (one if m = 1) to
the distance that the search may jump: m - 1 where no string has the block. A jump of zero leads to the
bucket of strings that end in that block, parted by their first block, and direct comparison decides.

The benchmark's distinct rows are split by hash into blocks of about ``block_bytes``; each block is one broadcast and one pass over the
documents. Words are numbers and tables flat arrays, so a process needs some 40 bytes for each byte of a block. One
block, the usual case, needs no shuffle.

Null texts have no words. Items without words have no windows; a null item id counts as the
empty string. Every input row gives one row, repeated rows repeated ones.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlab.llm.batches import extended

WINDOW = 13
SHARE = 20
BLOCK_BYTES = 4 << 20
#: Maps A-Z to a-z and every other ASCII character but 0-9 and a-z to a space.
TABLE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Strings:
    """The distinct windows of some items, as runs of word numbers in one array, and the items that have each.

    ``numbers`` gives the number of a word; ``flat`` holds the items' words end to end; a window is the place of its first word.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        self.flat, limits = array("i"), [0]
        for _, text in items:
            self.flat.extend([self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)])
            limits.append(len(self.flat))
        places: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for k, (begin, stop) in enumerate(zip(limits[:-1], limits[1:], strict=True)):
            size = min(window, stop - begin)
            if size:
                places.setdefault(size, []).append(np.arange(begin, stop - size + 1))
                owners.setdefault(size, []).append(np.full(stop - size + 1 - begin, k))
        flat = np.frombuffer(self.flat, np.int32) if self.flat else np.empty(0, np.int32)
        self.tables = [Tables(flat, m, np.concatenate(places[m]), np.concatenate(owners[m])) for m in sorted(places)]

    def packed(self) -> tuple[dict, list[dict]]:
        """Plain values, to be sent to tasks."""
        own = dict(vars(self))
        return own, [vars(t) for t in own.pop("tables")]

    @classmethod
    def unpacked(cls, packed: tuple[dict, list[dict]]) -> Strings:
        out = cls.__new__(cls)
        vars(out).update(packed[0])
        out.tables = [Tables.__new__(Tables) for _ in packed[1]]
        for table, values in zip(out.tables, packed[1], strict=True):
            vars(table).update(values)
        return out

    def numbered(self, words: list[bytes]) -> array:
        return array("i", map(self.numbers.get, words, repeat(-1)))


class Tables:
    """Shift table and buckets of the strings of one length, in flat arrays.

    A block of two words (one if m = 1) has a number by ``blocks``; ``shift`` is its jump. Strings are sorted by their last and then
    their first block: those that end in block k are ``begin[k]`` to ``begin[k + 1]``, with their first blocks in ``front``.
    """

    def __init__(self, flat: np.ndarray, m: int, places: np.ndarray, owners: np.ndarray):
        self.m, self.b = m, min(2, m)
        grid = flat[places[:, None] + np.arange(m)]
        order = np.lexsort((owners, *grid.T[::-1]))
        grid, places, owners = grid[order], places[order], owners[order]
        fresh = np.concatenate([[True], (grid[1:] != grid[:-1]).any(axis=1)])
        place, first = places[fresh], np.flatnonzero(fresh)
        keep = fresh | np.concatenate([[True], owners[1:] != owners[:-1]])  # an item that has a string twice is one owner
        grid = grid[fresh]
        ends = [grid[:, e - 1].astype(np.int64) if self.b == 1 else grid[:, e - 2].astype(np.int64) << 32 | grid[:, e - 1] for e in range(self.b, m + 1)]
        keys, inverse = np.unique(np.concatenate(ends), return_inverse=True)
        jumps = np.repeat(m - np.arange(self.b, m + 1), len(grid))
        shift = np.full(len(keys), m, np.int64)
        np.minimum.at(shift, inverse, jumps)
        self.blocks = {k: i for i, k in enumerate(keys.tolist())}
        self.shift = bytes(np.minimum(shift, 255).tolist())
        last, front = inverse[-len(grid) :], inverse[: len(grid)]
        order = np.lexsort((front, last))
        self.begin = array("i", np.searchsorted(last[order], np.arange(len(keys) + 1)).tolist())
        self.front, self.place = array("i", front[order].tolist()), array("i", place[order].tolist())
        which = (np.cumsum(fresh) - 1)[keep]
        starts = np.searchsorted(which, np.arange(len(first) + 1))
        self.of = array("i", order.tolist())
        self.owner_begin, self.owner = array("i", starts.tolist()), array("i", owners[keep].tolist())

    def occurrences(self, words: array, flat: array):
        """(start, string) of every occurrence, overlapping ones included."""
        m, b, blocks, shift, far, n = self.m, self.b, self.blocks, self.shift, self.m - self.b + 1, len(words)
        find, end, two = blocks.get, m, b == 2
        while end <= n:
            k = find(words[end - 2] << 32 | words[end - 1] if two else words[end - 1])
            if k is None:
                end += far
                continue
            if shift[k]:
                end += shift[k]
                continue
            start = end - m
            front = find(words[start] << 32 | words[start + 1] if two else words[start])
            if front is not None:
                low = bisect_left(self.front, front, self.begin[k], self.begin[k + 1])
                high = bisect_right(self.front, front, low, self.begin[k + 1])
                if low < high:
                    text = words[start:end]
                    for s in range(low, high):
                        at = self.place[s]
                        if flat[at : at + m] == text:
                            yield start, s
            end += 1

    def owners(self, string: int) -> array:
        k = self.of[string]
        return self.owner[self.owner_begin[k] : self.owner_begin[k + 1]]


def _searched(docs: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    """``docs`` with n_words, spans (merged word limits, flat) and items (ids with an occurring window)."""
    sent = docs.sparkSession.sparkContext.broadcast(Strings(items, window).packed())

    def work():
        strings = Strings.unpacked(sent.value)

        def step(batch):
            out = {"n_words": [], "spans": [], "items": []}
            for text in batch.column("text").cast(pa.large_binary()):
                words = strings.numbered(words_of(text.as_buffer().to_pybytes()) if text.is_valid else [])
                hits, found = [], set()
                for table in strings.tables:
                    for start, string in table.occurrences(words, strings.flat):
                        hits.append((start, start + table.m))
                        found.update(table.owners(string))
                out["n_words"].append(len(words))
                out["spans"].append(_merged(hits))
                out["items"].append(sorted({strings.names[k] for k in found}))
            return out

        return step

    return extended(docs, "text", "n_words bigint, spans array<bigint>, items array<string>", work)


def _merged(spans) -> list[int]:
    flat: list[int] = []
    for start, stop in sorted(spans):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], stop)
        else:
            flat += [start, stop]
    return flat


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, others) with n_words, n_hit, n_items, items_sha256 and contaminated.

    ``benchmark`` has item_id and text. A document is contaminated when at least one
    word in ``share`` lies inside an occurring window.
    """
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL").distinct()
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    parts = []
    for k in range(blocks):  # each block is bounded; the documents never are
        rows = named.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        parts.append(_searched(docs, [(r["item"], bytes(r["text"])) for r in rows], window))
    found = parts[0] if blocks == 1 else _united(docs, parts)
    spans = F.col("spans")
    hit = F.when(F.size(spans) > 0, F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))
    out = found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("bigint"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).withColumn("contaminated", F.expr(f"n_hit > 0 AND {share} * n_hit >= n_words"))
    return out.drop("spans", "items")


def _united(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """The rows of ``docs`` with what the passes over the benchmark's blocks found together."""
    narrow = [p.select("doc_id", F.xxhash64("text").alias("_key"), "n_words", "spans", "items").filter("size(items) > 0").dropDuplicates(["doc_id", "_key"]) for p in parts]
    every = narrow[0]
    for p in narrow[1:]:
        every = every.unionByName(p)
    flat = every.groupBy("doc_id", "_key").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def work():
        return lambda batch: {"spans": [_merged(zip(s[::2], s[1::2], strict=True)) for s in batch.column("s").to_pylist()]}

    merged = extended(flat.withColumn("name", F.lit("")), "name", "spans array<bigint>", work).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_text"), "spans", "items")
    counted = _searched(docs, [], 1).drop("spans", "items").withColumn("_key", F.xxhash64("text"))
    joined = counted.join(merged, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_key").eqNullSafe(F.col("_text")), "left")
    none = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    return joined.withColumn("spans", F.coalesce("spans", none[0])).withColumn("items", F.coalesce("items", none[1])).drop("_key", "_id", "_text")
