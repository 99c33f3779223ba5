"""Removal of passages that an earlier document already has, with a count-min prefilter.

Words are runs of characters outside space and 0x09-0x0D, unchanged. A window is
``window`` consecutive words of one document, known by a 64-bit hash. A word goes when a
window that covers it also starts in a document with a smaller id.

1. Every task counts its windows in a partition sketch: two counter rows per cell block.
   Sketches are merged block by block; a merged counter is never below the true count.
2. Windows whose merged counters are both at least two go on, grouped exactly: each task
   slice sends a hash once with its smallest document id, packed per hash range, so a
   window held by a third of all documents is one entry per slice, not one per document.
3. The smallest id of each repeated window goes back to the slices that sent it, and
   only documents that lose some but not all words are read once more.

The sketch has ``cells_per_window`` cells for every window of the corpus, up to ``max_cells``
(the broadcast is ``max_cells`` / 4 bytes). Beyond that bound it lets more windows through to the
exact grouping; it never hides a repeated one.

Null or wordless texts have no words. Rows with a null id neither lose words nor make others lose any.
Rows with equal ids do not count against each other. Every input row gives one row.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlab.llm.batches import WordHasher, mixed, sliced, windows
from cohortlab.llm.store import measured, removed, written

WINDOW = 13
CELLS_PER_WINDOW = 2.0
MAX_CELLS = 1 << 30
BLOCK = 1 << 16
RANGE_WINDOWS = 1 << 20
SLICE_BYTES = 4 << 20
SEED = 3


def _cells(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block of each hash, and its cell in either row of that block."""
    high = (hashes >> np.uint64(32)).astype(np.float64) * (blocks / 4294967296.0)
    low = hashes & np.uint64(0xFFFFFF)
    return high.astype(np.int64), (low & np.uint64(0xFFFF)).astype(np.int64), ((low ^ (low >> np.uint64(8))) * np.uint64(0x9E37) >> np.uint64(5) & np.uint64(0xFFFF)).astype(np.int64)


def sketch_parts(docs: DataFrame, blocks: int, window: int) -> DataFrame:
    """(block, part) rows: what one task has counted, three bytes for each window."""

    def run(batches):
        hasher, held, size = WordHasher(), [], 0

        def flush():
            everything = np.concatenate(held)
            key = _cells(everything, blocks)[0] << 24 | (everything & np.uint64(0xFFFFFF)).astype(np.int64)
            key.sort()
            key = key[np.concatenate([np.ones(min(2, len(key)), bool), key[2:] != key[:-2]])]  # twice is as good as more often
            block, low = key >> 24, (key & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            parts = [x.tobytes() for x in np.split(low, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(block[cuts], pa.int64()), pa.array(parts, pa.binary())], ["block", "part"])

        for batch in sliced(batches, "text", SLICE_BYTES):
            words, rows = hasher(batch.column("text"))
            found = windows(words, window, SEED)
            ends = np.repeat(rows[1:], np.diff(rows))[: len(found)]
            found = found[np.arange(len(found)) + window <= ends]
            if len(found):
                held.append(found)
                size += len(found)
            if size >= 2_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(run, "block bigint, part binary")


def merged_sketch(parts: DataFrame) -> DataFrame:
    """(block, repeated): for either row, a bit for each cell that the merged counts put at two or more."""

    def merge(table: pa.Table) -> pa.Table:
        counts = [np.zeros(BLOCK, np.int64) for _ in range(2)]
        for part in table.column("part"):
            three = np.frombuffer(part.as_buffer(), np.uint8).reshape(-1, 3).astype(np.uint64)
            low = three[:, 0] | three[:, 1] << np.uint64(8) | three[:, 2] << np.uint64(16)
            for count, cell in zip(counts, _cells(low, 1)[1:], strict=True):
                count += np.bincount(cell, minlength=BLOCK)
        bits = b"".join(np.packbits(c >= 2).tobytes() for c in counts)
        return pa.table({"block": table.column("block")[:1], "repeated": pa.array([bits], pa.binary())})

    return parts.groupBy("block").applyInArrow(merge, "block bigint, repeated binary")


def candidates(docs: DataFrame, sketch, blocks: int, window: int, ranges: int) -> DataFrame:
    """A row for each slice of a task: its documents and their candidate windows, packed, by hash range."""

    def run(batches):
        hasher = WordHasher()
        bits = np.frombuffer(sketch.value, np.uint8)
        width = BLOCK // 8
        for batch in sliced(batches, "text", SLICE_BYTES):
            words, rows = hasher(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            ids = np.where(known, ids, 0).astype(np.int64)
            found = windows(words, window, SEED)
            doc = np.repeat(np.arange(len(ids)), np.diff(rows))[: len(found)]
            good = (np.arange(len(found)) + window <= rows[1:][doc]) & known[doc] if len(found) else np.zeros(0, bool)
            at = np.flatnonzero(good)
            found = found[at]
            block, one, two = _cells(found, blocks)
            base = block * (2 * width)
            seen = (bits[base + (one >> 3)] >> (7 - (one & 7)).astype(np.uint8)) & (bits[base + width + (two >> 3)] >> (7 - (two & 7)).astype(np.uint8)) & 1
            at, found = at[seen == 1], found[seen == 1]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            fresh = np.concatenate([np.ones(min(1, len(found)), bool), found[1:] != found[:-1]])
            unique, begin, owner = found[fresh], np.flatnonzero(fresh), ids[doc[at]] if len(at) else np.empty(0, np.int64)
            low, high = (f.reduceat(owner, begin) if len(begin) else owner for f in (np.minimum, np.maximum))
            base = int(low.min()) if len(low) else 0
            narrow = np.uint32 if len(low) and int(low.max()) - base < 1 << 32 else np.uint64
            off, several = (low - base).astype(narrow), high > low
            part = ((unique >> np.uint64(32)).astype(np.float64) * (ranges / 4294967296.0)).astype(np.int64)
            used, begins = np.unique(part, return_index=True)
            cuts = np.concatenate([begins, [len(part)]])
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text").cast(pa.large_binary())]
            plain = b"".join(hashlib.sha256(b" ".join(t.split())).digest() for t in texts)
            name = uuid.uuid4().hex
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name]), pa.array([len(ids)], pa.int64()),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (ids, known, batch.column("_key").to_numpy(zero_copy_only=False), np.diff(rows).astype(np.int32))),
                    pa.array([plain], pa.binary()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([np.packbits(fresh).tobytes()], pa.binary()),
                    pa.array([used.tolist()], pa.list_(pa.int32())),
                    pa.array([[unique[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]], pa.list_(pa.binary())),
                    pa.array([[np.int64(base).tobytes() + off[a:b].tobytes() + np.packbits(several[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]], pa.list_(pa.binary())),
                ],
                ["slice", "n", "ids", "known", "keys", "n_words", "plain", "word_at", "fresh", "parts", "hashes", "edges"],
            )

    shape = "slice string, n bigint, ids binary, known binary, keys binary, n_words binary, plain binary, word_at binary, fresh binary, parts array<int>, hashes array<binary>, edges array<binary>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_key")).mapInArrow(run, shape)


def _edges(buffer: pa.Buffer, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id for each of ``n`` hashes of a slice, and whether the slice has a larger one too."""
    data = buffer.to_pybytes()
    bits = -(-n // 8)
    kind = np.uint32 if len(data) == 8 + 4 * n + bits else np.uint64
    low = np.frombuffer(data[8 : len(data) - bits], kind).astype(np.int64) + np.frombuffer(data[:8], np.int64)[0]
    return low, np.unpackbits(np.frombuffer(data[len(data) - bits :], np.uint8), count=n).astype(bool)


def first_holders(sent: DataFrame) -> DataFrame:
    """Exact grouping in each hash range: for each slice, the smallest id of its repeated windows, aligned with what it sent."""

    def group(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        lows, several = zip(*(_edges(x.as_buffer(), len(h)) for x, h in zip(table.column("edges"), hashes, strict=True)), strict=True)
        unique, place = np.unique(np.concatenate(hashes), return_inverse=True)
        low, more = np.concatenate(lows), np.concatenate(several)
        first = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(first, place, low)
        shared = np.zeros(len(unique), bool)
        shared[place[more | (low > first[place])]] = True
        found = np.where(shared, first, np.iinfo(np.int64).max)[place]
        back = [x.tobytes() for x in np.split(found, np.cumsum([len(h) for h in hashes])[:-1])]
        return pa.table({"slice": table.column("slice"), "part": table.column("part").cast(pa.int32()), "first": pa.array(back, pa.binary())})

    return sent.groupBy("part").applyInArrow(group, "slice string, part int, first binary")


def _judged(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    row = left.iloc[0]
    first = np.frombuffer(b"".join(right.sort_values("part")["first"]), np.int64)
    ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
    keys, counts = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["n_words"], np.int32).astype(np.int64)
    at = np.frombuffer(row["word_at"], np.int32).astype(np.int64)
    place = np.cumsum(np.unpackbits(np.frombuffer(row["fresh"], np.uint8), count=len(at))) - 1
    ends = np.cumsum(counts)
    doc = np.searchsorted(ends, at, "right")
    at = at[first[place] < ids[doc]]
    step = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
    size = int(row["window"])
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    gone = np.cumsum(step[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    lost = total[ends] - total[ends - counts]
    kept = []
    for i in range(len(ids)):
        if lost[i] == 0:
            kept.append((row["plain"][32 * i : 32 * i + 32].hex(), None))
        elif lost[i] == counts[i]:
            kept.append((hashlib.sha256(b"").hexdigest(), None))
        else:
            flips = np.flatnonzero(np.diff(np.concatenate([[False], gone[ends[i] - counts[i] : ends[i]], [False]])))
            kept.append((None, flips.astype(np.int64).tobytes()))
    return pd.DataFrame({
        "doc_id": pd.Series([int(x) if k else None for x, k in zip(ids, known, strict=True)], dtype="Int64"), "_key": keys, "n_words": counts, "n_removed": lost.astype(np.int64),
        "kept_sha256": [x for x, _ in kept], "gone": [x for _, x in kept],
    })


def repeated_spans(docs: DataFrame, window: int = WINDOW, cells_per_window: float = CELLS_PER_WINDOW, max_cells: int = MAX_CELLS, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, _key (xxhash64 of the text), n_words, n_removed,
    kept_sha256 where no word or every word goes, else ``gone``: word limits [from, to) as packed 64-bit integers."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(max_cells, max(BLOCK, int(cells_per_window * total / 6)))  # about six bytes a word
    blocks = -(-cells // BLOCK)
    marks, at = written(merged_sketch(sketch_parts(docs, blocks, window)), "sketch")
    bits = np.zeros(blocks * (BLOCK // 4), np.uint8)
    for row in marks.toLocalIterator():
        bits[row["block"] * (BLOCK // 4) : (row["block"] + 1) * (BLOCK // 4)] = np.frombuffer(row["repeated"], np.uint8)
    removed(spark, at)
    ranges = max(1, -(-total // (6 * range_windows)))
    sent = spark.sparkContext.broadcast(bits.tobytes())
    slices, _ = written(candidates(docs, sent, blocks, window, ranges), "slices")
    sent.unpersist()
    packed = slices.select("slice", F.explode(F.arrays_zip("parts", "hashes", "edges")).alias("x")).select("slice", F.col("x.parts").alias("part"), "x.hashes", "x.edges")
    back = first_holders(packed)
    own = slices.select("slice", "ids", "known", "keys", "n_words", "plain", "word_at", "fresh", F.lit(window).alias("window"))
    out = own.groupBy("slice").cogroup(back.groupBy("slice")).applyInPandas(_judged, "doc_id bigint, _key bigint, n_words bigint, n_removed bigint, kept_sha256 string, gone binary")
    return written(out, "spans")[0]


def _without(text: bytes | None, gone: bytes) -> bytes:
    words, limits = (text or b"").split(), np.frombuffer(gone, np.int64)
    keep, at = [], 0
    for a, b in limits.reshape(-1, 2):
        keep += words[at:a]
        at = b
    return b" ".join(keep + words[at:])


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``; kept words joined by one space."""
    spans = repeated_spans(docs, **options)
    partly = measured(spans.filter("gone IS NOT NULL").select("doc_id", "_key", "n_words", "n_removed", "gone").dropDuplicates(["doc_id", "_key"]), "gone")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_key")).join(partly, ["doc_id", "_key"])

    def run(batches):
        for batch in sliced(batches, "text", SLICE_BYTES):
            texts = [x.as_buffer().to_pybytes() for x in batch.column("text").cast(pa.large_binary())]
            kept = [hashlib.sha256(_without(t, g.as_py())).hexdigest() for t, g in zip(texts, batch.column("gone"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", "n_words", "n_removed")] + [pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    cut = texts.select("doc_id", "n_words", "n_removed", "text", "gone").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return spans.filter("gone IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256").union(cut)
