"""Near-duplicate documents by one-permutation hashing, banded buckets and star-shaped candidates.

A document's set holds its distinct shingles of ``shingle`` words (A-Z lower-cased; words are runs
outside space and 0x09-0x0D; with fewer words the whole sequence is one shingle).

1. One hash per shingle; the smallest in each of ``bands`` * ``rows`` bins is the signature. An empty
   bin borrows from the occupied bin that comes first in the bin's own fixed random order, which
   keeps the chance of agreement at the Jaccard similarity (optimal densification).
2. Documents with equal sets form one class, known by its smallest id. Only classes go on.
3. Each band of each class is a bucket key. In a bucket the smallest id is the centre of a star, so a
   bucket of n classes gives n - 1 pairs. Pairs are confirmed on full shingle sets.
4. Components of confirmed links are formed. A bucket whose members are then in one component has
   nothing left to find. The others are gathered into clusters of documents tied by shared open buckets, and
   there every document outside the cluster's largest component is compared with all of the cluster, on full sets and
   inside tasks: a cluster is cut into blocks of bounded size, such a document goes to every block, and a block returns at most
   one link for each of them and each other component. Many such documents are parted into bounded portions, each
   with its own copy of the blocks. A cluster for which that would be too many copies is
   looked at bucket by bucket instead. So every candidate pair is decided and no bucket is cut, yet pairs are never listed.

A pair is missed only if no band agrees: below 1e-5 at similarity 0.8 with 40 bands of 6 rows.

Null, empty and blank texts have empty sets and link with nothing. Rows with a null id are returned
with a null component and kept. Texts of any length are read whole. Every row is a document of its own, also where several share an id:
then rows are numbered and linked by number, and a component is named by the smallest id in it. Repeated rows give repeated
results; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cohortlab.llm.batches import GOLDEN, WordHasher, extended, mixed, odd_steps, windows
from cohortlab.llm.components import components
from cohortlab.llm.store import measured, salted_join, written

SHINGLE = 2
PERCENT = 80
BANDS = 40
ROWS = 6
BLOCK_SHINGLES = 200_000
GUEST_SHINGLES = 3_200_000
MOST_COPIES = 64
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sets(hasher: WordHasher, column: pa.Array, shingle: int):
    """The sorted distinct shingle hashes of each row."""
    words, rows = hasher(column)
    pairs = windows(words, shingle, 5)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= shingle:
            yield np.unique(pairs[a : b - shingle + 1])
        elif b > a:
            yield mixed(np.sum(words[a:b] * odd_steps(int(b - a), 6), dtype=np.uint64, keepdims=True))
        else:
            yield words[:0]


class _Sketcher:
    """One-permutation signatures with densification."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        draw = mixed(np.arange(1, self.bins * self.bins + 1, dtype=np.uint64) * np.uint64(GOLDEN)).reshape(self.bins, self.bins)
        self.order = np.argsort(draw, axis=1)  # row i: the bins that bin i asks, in turn
        self.rank = np.argsort(self.order, axis=1)
        self.steps = odd_steps(rows, 9)
        self.band = mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLDEN))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        bin_of = (hashes >> np.uint64(40)).astype(np.int64) % self.bins
        least = np.full(self.bins, EMPTY)
        np.minimum.at(least, bin_of, hashes & np.uint64(0xFFFFFFFFFF))
        full = np.flatnonzero(least != EMPTY)
        if len(full) < self.bins:
            void = np.flatnonzero(least == EMPTY)
            donor = full[np.argmin(self.rank[np.ix_(void, full)], axis=1)]
            least[void] = mixed(least[donor] + np.uint64(1))
        grid = least.reshape(self.bands, self.rows)
        return mixed((grid * self.steps).sum(axis=1, dtype=np.uint64) + self.band)


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` without its text, with n_shingles, set_a, set_b (together the identity of the set) and bands."""

    def work():
        hasher, sketch = WordHasher(lower=True), _Sketcher(bands, rows)

        def step(batch):
            out = {"n_shingles": [], "set_a": [], "set_b": [], "bands": []}
            for hashes in _sets(hasher, batch.column("text"), shingle):
                out["n_shingles"].append(len(hashes))
                out["set_a"].append(int(hashes.sum(dtype=np.uint64).view(np.int64)))
                out["set_b"].append(int(mixed(hashes + np.uint64(GOLDEN)).sum(dtype=np.uint64).view(np.int64)))
                out["bands"].append(sketch(hashes).view(np.int64) if len(hashes) else None)
            return out

        return step

    return extended(docs, "text", "n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>", work).drop("text")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and its full set, as an array of 64-bit shingle hashes."""

    def work():
        hasher = WordHasher(lower=True)
        return lambda batch: {"shingles": [x.view(np.int64) for x in _sets(hasher, batch.column("text"), shingle)]}

    return extended(docs.select("doc_id", "text"), "text", "shingles array<bigint>", work).drop("text")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    two = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    both = F.size(F.array_intersect("left", "right"))
    return pairs.join(one, "b").join(two, "a").filter(100 * both >= percent * (F.size("left") + F.size("right") - both)).select("a", "b")


def _close_sizes(percent: int):
    return F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept, group for each row of ``docs`` (doc_id, text).

    text_key is xxhash64 of the text; ``group`` tells components apart also where two of them have the same smallest id.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    if not _repeated(docs):
        found = _grouped(docs.select("doc_id", "text", "text_key"), shingle, percent, bands, rows)
        return found.select("doc_id", "text_key", "n_shingles", F.col("group").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("group")).alias("kept"), "group")
    numbered, _ = written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    own = numbered.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text", "text_key", F.col("doc_id").alias("named"))
    found, _ = written(_grouped(own, shingle, percent, bands, rows), "rows")
    least = found.filter("group IS NOT NULL").groupBy("group").agg(F.min("named").alias("component_id"))
    found = salted_join(found, least, ["group"], how="left")
    return found.select(F.col("named").alias("doc_id"), "text_key", "n_shingles", "component_id", F.col("named").eqNullSafe(F.col("component_id")).alias("kept"), "group")


def _grouped(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``docs`` (doc_id, text, others), whose ids are unique or null, without the text, with n_shingles and group: the smallest id of the component."""
    carried = [c for c in docs.columns if c != "text"]
    signs, _ = written(signatures(docs, shingle, bands, rows), "signs")
    classes, _ = written(
        signs.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("bands").alias("bands")), "classes"
    )
    keys = classes.select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min(F.struct("doc", "n")).alias("c"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("bucket", F.col("c.doc").alias("a"), F.col("c.n").alias("na"))
    members, _ = written(keys.join(shared, "bucket").select("bucket", "doc", "n", "a", "na"), "members")
    tried, _ = written(members.filter("doc <> a").select("a", F.col("doc").alias("b"), "na", F.col("n").alias("nb")).filter(_close_sizes(percent)).select("a", "b").distinct(), "pairs")
    wanted = measured(members.select(F.col("doc").alias("doc_id")).distinct())
    texts = docs.join(wanted, "doc_id", "left_semi")
    sets, _ = written(shingle_sets(texts, shingle), "sets")
    links, _ = written(_confirmed(tried, sets, percent), "links")
    found = components(links)
    more = _second_look(members, found, sets, percent)
    if more is not None:
        found = components(links.union(more))
    found, _ = written(found, "components")
    named = classes.select("set_a", "set_b", "n_shingles", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("class_component"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return signs.join(named, ["set_a", "set_b", "n_shingles"], "left").select(*carried, "n_shingles", own.alias("group"))


def _repeated(docs: DataFrame) -> bool:
    """True when an id occurs on several rows."""
    return bool(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").take(1))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (group, doc, n, component) with each group's number of blocks and of portions, and ``outside`` for documents that are not in its largest component."""
    parts = rows.groupBy("group", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    stats = parts.groupBy("group").agg(F.max(F.struct("m", "component", "n")).alias("top"), F.sum("m").alias("docs"), F.sum("n").alias("n"))
    portions = F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("top.n")) / GUEST_SHINGLES)).cast("int").alias("portions")
    stats = stats.select("group", F.col("top.component").alias("largest"), F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int").alias("blocks"), portions, "docs", (F.col("docs") - F.col("top.m")).alias("n_outside"))
    return rows.join(stats, "group").withColumn("outside", F.col("component") != F.col("largest"))


def _second_look(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between different components of ``found`` whose documents share a bucket; None if no bucket is open."""
    rows = members.select("bucket", "a", "doc", "n").join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    split = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    rows, _ = written(rows.join(split.select("bucket"), "bucket"), "open")
    if not rows.take(1):
        return None
    tied = components(rows.select("a", F.col("doc").alias("b"))).select(F.col("node").alias("doc"), F.col("component").alias("group"))
    clusters, _ = written(_placed(rows.select("doc", "n", "component").distinct().join(tied, "doc")), "clusters")
    heavy = F.col("n_outside") * F.col("blocks") > MOST_COPIES * F.col("docs")
    by_bucket = _placed(rows.join(clusters.filter(heavy).select("doc"), "doc", "left_semi").select(F.col("bucket").alias("group"), "doc", "n", "component"))
    columns = ["group", "doc", "component", "blocks", "portions", "outside"]
    groups = clusters.filter(~heavy).select(F.lit(0).alias("kind"), *columns).unionByName(by_bucket.select(F.lit(1).alias("kind"), *columns))
    block, portion = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("doc", F.lit(1)), F.col("portions")).cast("int")
    home = F.transform(F.sequence(F.lit(0), F.col("portions") - 1), lambda p: F.struct(block.alias("block"), p.alias("portion"), F.lit(False).alias("guest")))
    guests = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), portion.alias("portion"), F.lit(True).alias("guest")))
    filed = groups.join(sets.withColumnRenamed("doc_id", "doc"), "doc").withColumn("at", F.explode(F.when(F.col("outside"), F.concat(home, guests)).otherwise(home)))

    def compare(table: pa.Table) -> pa.Table:
        guest = table.column("guest").to_numpy()
        docs, parts = table.column("doc").to_numpy(), table.column("component").to_numpy()
        lists = table.column("shingles").combine_chunks()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        values = pc.list_flatten(lists).to_numpy()
        shingles = np.split(values, ends[:-1])
        own = np.flatnonzero(~guest)
        pairs: list[tuple[int, int]] = []
        if len(own):
            sizes = np.array([len(shingles[i]) for i in own])
            every, owner = np.concatenate([shingles[i] for i in own]), np.repeat(np.arange(len(own)), sizes)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            for g in np.flatnonzero(guest):
                mine = shingles[g]
                low, high = np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")
                count = high - low
                hits = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                both = np.bincount(owner[hits], minlength=len(own))
                close = (100 * both >= percent * (len(mine) + sizes - both)) & (parts[own] != parts[g])
                first = {int(parts[own[i]]): int(docs[own[i]]) for i in np.flatnonzero(close)[::-1]}
                pairs += [(int(docs[g]), other) for other in first.values()]
        return pa.table({"a": pa.array([min(p) for p in pairs], pa.int64()), "b": pa.array([max(p) for p in pairs], pa.int64())})

    blocks = filed.select("kind", "group", F.col("at.block").alias("block"), F.col("at.portion").alias("portion"), "doc", "component", F.col("at.guest").alias("guest"), "shingles")
    return written(blocks.groupBy("kind", "group", "block", "portion").applyInArrow(compare, "a bigint, b bigint").distinct(), "links")[0]
