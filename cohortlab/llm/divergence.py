"""Source divergence: how far the term shares of a source are from those of other sources of its language.

Terms are runs of letters and non-ASCII characters (``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``), A-Z lower-cased. A language keeps the terms that at
least ``min_docs`` of its documents hold. A group (language, source) and each language give every kept term a smoothed share in
parts per 10^9, in whole numbers. The divergence of two groups is the sum of the absolute share differences over all kept terms.

The matrix of groups (rows) by kept terms (columns) is mostly zero and is held as a quadtree, one for each language:

* Rows are ordered by size, columns by frequency class, so that zeros gather. A leaf is ``ROWS`` rows by about ``COLUMNS`` columns and
  exists only if it holds a count. A node above it covers two by two nodes.
* Two row blocks are walked through the tree together, from the root. Where neither has a count, the quadrant ends the walk and is priced
  by the number of its columns: each adds the difference of the two groups' shares of an absent term. Where at least one has a
  count, the walk goes down; at the leaves both blocks are compared as arrays.

The walk is a join a level over tables of nodes; leaves are shuffled by (row block, column block), bounded by their size. The result
has a row for each ordered pair of sources of a language, so its size is the square of their number by contract; no other step
lists pairs. A language's sources are ranked in one window, which is far smaller than their pairs.

Null texts, languages and sources are read as ''. A group without terms, and a language without kept terms, still has its pairs (the
latter with value 0). A document is a row: repeated rows count again. An empty table gives no rows. Ranks break ties by item
in byte order. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortlab.llm.batches import bounded, sliced
from cohortlab.llm.store import measured, written

MIN_DOCS = 30
BEST_TERMS = 50
ROWS = 32
COLUMNS = 2048
HELD_TERMS = 300_000
SHARE = "CAST(1 + (CAST(1000000000 AS DECIMAL(10,0)) * (CAST({c} AS DECIMAL(18,0)) + 5)) div (CAST({n} AS DECIMAL(18,0)) + 5 * CAST({v} AS DECIMAL(18,0))) AS BIGINT)"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the documents of the group that hold it."""
    bounded(docs.sparkSession)
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    term = re.compile(rb"[a-z\x80-\xff]+")

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush():
            for (lang, source), (n, d) in held.items():
                words = [w.decode() for w in n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(words, pa.string()),
                        pa.array(list(n.values()), pa.int64()), pa.array([d[w] for w in n], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

        for batch in sliced(batches, "text"):
            texts = batch.column("text").cast(pa.large_binary())
            for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                words = term.findall(text.as_buffer().to_pybytes().translate(lower))
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(words)
                d.update(set(words))
                size += len(n) - before
            if size > HELD_TERMS:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    rows = docs.select("text", "lang", "source").filter("octet_length(text) > 0")
    parts = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def placed_terms(cells: DataFrame, min_docs: int, columns: int) -> DataFrame:
    """(lang, term, total, cb, pos): kept terms, the column block each falls in and its place there.

    Terms of one frequency class (power of two of their documents) share blocks, frequent classes first; a block of a class takes terms by hash.
    """
    kept = cells.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept, _ = written(kept.withColumn("class", F.floor(F.log2("docs")).cast("int")), "terms")
    classes = kept.groupBy("lang", "class").count().withColumn("blocks", F.ceil(F.col("count") / columns))
    before = Window.partitionBy("lang").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0))).drop("count")
    placed = kept.join(measured(classes, "lang"), ["lang", "class"])
    placed = placed.withColumn("cb", F.col("first") + F.pmod(F.xxhash64("term"), F.col("blocks")))
    place = F.row_number().over(Window.partitionBy("lang", "cb").orderBy("term")) - 1
    return written(placed.select("lang", "term", "total", "cb", place.alias("pos")), "placed")[0]


def _leaf(batches):
    """Sums of share differences between the rows of two leaves, and of zero quadrants, as (lang, a, b, value)."""
    for batch in batches:
        for row in range(batch.num_rows):
            x = {n: batch.column(n)[row] for n in batch.schema.names}
            first, second = (_dense(x[f"z_{s}"], x[f"leaf_{s}"], x["columns"].as_py()) for s in "ab")
            zero = x["zero"].as_py()
            za, zb = (np.array(x[f"z_{s}"].as_py(), np.int64) for s in "ab")
            value = np.abs(za[:, None] - zb[None, :]) * zero
            if first is not None:
                for i, line in enumerate(first):
                    value[i] += np.abs(second - line).sum(axis=1)
            a, b = (x[n].as_py() for n in ("ra", "rb"))
            i, j = np.triu_indices(len(za), 1) if a == b else (g.ravel() for g in np.indices(value.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["lang"].as_py()] * len(i), pa.string()), pa.array(a * ROWS + i), pa.array(b * ROWS + j), pa.array(value[i, j])], ["lang", "a", "b", "value"]
            )


def _dense(z: pa.Scalar, leaf: pa.Scalar, columns: int) -> np.ndarray | None:
    if not columns:
        return None
    z = np.array(z.as_py(), np.int64)
    out = np.repeat(z[:, None], columns, axis=1)
    if leaf.is_valid:
        i, pos, p = (leaf.values.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("i", "pos", "p"))
        out[i, pos] = p
    return out


def pair_divergence(leaves: DataFrame, blocks: DataFrame, columns: DataFrame) -> DataFrame:
    """(lang, a, b, value) with a < b: the joint walk over the trees of all languages.

    ``leaves``: lang, rb, cb, leaf (array of i, pos, p). ``blocks``: lang, rb, z (array, share of an absent term by row). ``columns``: lang, cb, terms.
    """
    extent = blocks.groupBy("lang").agg(F.max("rb").alias("last_row")).join(columns.groupBy("lang").agg(F.max("cb").alias("last_column")), "lang")
    extent, _ = written(extent, "extent")
    deepest = extent.agg(F.max(F.greatest("last_row", "last_column"))).first()[0]
    pairs = blocks.join(measured(blocks.groupBy("lang").agg(F.max("rb").alias("last")), "lang"), "lang")
    pairs = pairs.select("lang", F.col("rb").alias("ra"), F.explode(F.sequence("rb", "last")).alias("rb"), F.lit(0).cast("bigint").alias("zero"))
    prices = [pairs]  # every pair of row blocks has its pairs of groups, whatever is in the matrix
    walk = None
    if deepest is not None:
        held = leaves.select("lang", "rb", "cb")
        walk = extent.select("lang", F.lit(0).cast("bigint").alias("ra"), F.lit(0).cast("bigint").alias("rb"), F.lit(0).cast("bigint").alias("cb"))
        for level in range(int(deepest).bit_length(), -1, -1):
            scale = F.lit(1 << level)

            def at(c):
                return F.floor(F.col(c) / scale).cast("bigint")  # noqa: B023

            nodes = held.select("lang", at("rb").alias("r"), at("cb").alias("cb"), F.lit(True).alias("held")).distinct()
            widths = columns.groupBy("lang", at("cb").alias("cb")).agg(F.sum("terms").alias("terms"))
            if level < int(deepest).bit_length():
                for side in ("ra", "rb", "cb"):
                    walk = walk.withColumn(side, F.explode(F.array(F.col(side) * 2, F.col(side) * 2 + 1)))
            walk = walk.filter("ra <= rb").join(measured(extent, "lang"), "lang").filter((F.col("rb") <= at("last_row")) & (F.col("cb") <= at("last_column"))).drop("last_row", "last_column")
            for side, flag in (("ra", "has_a"), ("rb", "has_b")):
                walk = walk.join(measured(nodes.select("lang", F.col("r").alias(side), "cb", F.col("held").alias(flag)), "lang"), ["lang", side, "cb"], "left")
            walk = walk.join(measured(widths, "lang"), ["lang", "cb"])
            walk, _ = written(walk, f"level{level}")
            ended = walk.filter("has_a IS NULL AND has_b IS NULL").groupBy("lang", "ra", "rb").agg(F.sum("terms").alias("zero")).join(measured(extent, "lang"), "lang")
            for side in ("ra", "rb"):
                ended = ended.withColumn(side, F.explode(F.sequence(F.col(side) * scale, F.least((F.col(side) + 1) * scale - 1, F.col("last_row")))))
            prices.append(ended.filter("ra <= rb").select("lang", "ra", "rb", "zero"))
            walk = walk.filter("has_a OR has_b").select("lang", "ra", "rb", "cb")
    zero = prices[0]
    for p in prices[1:]:
        zero = zero.unionByName(p)
    kind = leaves.schema["leaf"].dataType
    work = zero.groupBy("lang", "ra", "rb").agg(F.sum("zero").alias("zero"))
    work = work.select("*", F.lit(0).cast("bigint").alias("columns"), F.lit(None).cast(kind).alias("leaf_a"), F.lit(None).cast(kind).alias("leaf_b"))
    if walk is not None:
        met = walk
        for side, name in (("ra", "leaf_a"), ("rb", "leaf_b")):
            met = met.join(leaves.select("lang", F.col("rb").alias(side), "cb", F.col("leaf").alias(name)), ["lang", side, "cb"], "left")
        met = met.join(measured(columns.select("lang", "cb", F.col("terms").alias("columns")), "lang"), ["lang", "cb"])
        work = work.unionByName(met.select("lang", "ra", "rb", F.lit(0).cast("bigint").alias("zero"), "columns", "leaf_a", "leaf_b"))
    for side, name in (("ra", "z_a"), ("rb", "z_b")):
        work = work.join(measured(blocks.select("lang", F.col("rb").alias(side), F.col("z").alias(name)), "lang", limit=8 << 20), ["lang", side])
    found = work.mapInArrow(_leaf, "lang string, a bigint, b bigint, value bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, best_terms: int = BEST_TERMS, columns: int = COLUMNS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank for the groups of ``docs`` (text, lang, source).

    ``pair``: every other source of the language and the divergence from it. ``term``: the ``best_terms`` terms of the group whose
    share lies furthest above the language's share. Ranks are by value, descending, then by item.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    cells, _ = written(term_counts(docs), "cells")
    placed = placed_terms(cells, min_docs, columns)
    langs = placed.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    kept, _ = written(cells.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "kept")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").fillna(0, ["n_group"])
    groups = groups.join(measured(langs, "lang"), "lang", "left")
    row = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_group"), "source")) - 1
    absent = F.when(F.col("v").isNull(), 0).otherwise(F.expr(SHARE.format(c="0", n="n_group", v="v")))
    groups, _ = written(groups.select("*", row.cast("bigint").alias("r"), absent.alias("z")), "groups")
    sides = measured(groups, "lang", "source")

    cell = kept.join(sides, ["lang", "source"])
    cell = cell.withColumn("p", F.expr(SHARE.format(c="n", n="n_group", v="v")))
    leaves = cell.groupBy("lang", F.floor(F.col("r") / ROWS).cast("bigint").alias("rb"), "cb").agg(
        F.collect_list(F.struct((F.col("r") % ROWS).cast("int").alias("i"), F.col("pos").cast("int").alias("pos"), "p")).alias("leaf")
    )
    blocks = groups.groupBy("lang", F.floor(F.col("r") / ROWS).cast("bigint").alias("rb")).agg(F.sort_array(F.collect_list(F.struct("r", "z"))).alias("x")).select("lang", "rb", F.col("x.z").alias("z"))
    pairs = pair_divergence(written(leaves, "leaves")[0], written(blocks, "blocks")[0], placed.groupBy("lang", "cb").agg(F.count("*").alias("terms")))
    both = pairs.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value").select("lang", "x.a", "x.b", "value")
    names = groups.select("lang", "r", "source")
    both = both.join(measured(names.withColumnRenamed("r", "a"), "lang", "source"), ["lang", "a"])
    both = both.join(measured(names.withColumnsRenamed({"r": "b", "source": "item"}), "lang", "item"), ["lang", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))

    above = cell.withColumn("value", F.col("p") - F.expr(SHARE.format(c="total", n="n_lang", v="v"))).filter("value > 0")
    term = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best_terms)
    return pair.unionByName(term)
