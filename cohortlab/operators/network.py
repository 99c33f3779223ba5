"""Rollups over scored edges, annotation terms and text corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.functions import tails
from cohortlab.functions.scalars import keyword_category
from cohortlab.operators.tables import top_per_group
from cohortlab.operators.twogroup import adjust_fdr
from cohortlab.session import small


def symmetric(edges: DataFrame, a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """Both directions of every edge from one scan, so either endpoint is an equi-join key."""
    both = F.explode(F.array(
        F.struct(F.col(a).alias("source"), F.col(b).alias("target")), F.struct(F.col(b).alias("source"), F.col(a).alias("target"))
    ))
    return edges.select(both.alias("_e"), F.col(score).alias("score")).select("_e.source", "_e.target", "score")


def seed_edges(edges: DataFrame, seeds: DataFrame, min_score: float = 0.0, seed: str = "seed") -> DataFrame:
    """(seed, neighbour, score) for edges touching a seed."""
    directed = symmetric(edges.filter(F.col("score") >= min_score))
    return directed.join(small(seeds), F.col("source") == F.col(seed)).select(seed, F.col("target").alias("neighbour"), "score")


def edges_among(edges: DataFrame, seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """Edges with both ends in the seed set."""
    s = small(seeds)
    return edges.join(s, F.col("a") == F.col(seed), "left_semi").join(s, F.col("b") == F.col(seed), "left_semi")


def neighbour_summary(touching: DataFrame, seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """Per neighbour outside the seed set: how many seeds, mean and max score."""
    outside = touching.join(small(seeds.select(F.col(seed).alias("neighbour"))), "neighbour", "left_anti")
    return outside.groupBy("neighbour").agg(
        F.count_distinct(seed).alias("n_seeds"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score")
    )


def seed_degree(touching: DataFrame, seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """Neighbours per seed, zero when absent."""
    d = touching.groupBy(seed).agg(F.count_distinct("neighbour").alias("degree"))
    return seeds.join(d, seed, "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))


def common_neighbours(touching: DataFrame, n_seeds: int, seed: str = "seed") -> DataFrame:
    """Neighbours linked to every seed."""
    return touching.groupBy("neighbour").agg(F.count_distinct(seed).alias("k")).filter(F.col("k") == n_seeds).select("neighbour")


def significant_terms(terms: DataFrame, seed: str, fdr: str = "fdr", term: str = "term", limit: float = 0.05, top: int | None = None) -> DataFrame:
    """Terms below the FDR limit; with ``top``, the best ones per seed."""
    kept = terms.filter(F.col(fdr) < limit)
    return top_per_group(kept, [seed], [F.col(fdr), F.col(term)], top) if top else kept


def module_evidence(terms: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], seed: str, text: str, fdr: str) -> DataFrame:
    """Per (seed, module): best FDR, number of terms, and the term with the best FDR."""
    tagged = terms.withColumn("module", keyword_category(text, rules)).filter(F.col("module").isNotNull())
    return tagged.groupBy(seed, "module").agg(
        F.min(fdr).alias("best_fdr"), F.count(F.lit(1)).alias("evidence_count"), F.min(F.struct(fdr, text)).alias("_b")
    ).select(seed, "module", "best_fdr", "evidence_count", F.col(f"_b.{text}").alias("representative_term"))


def over_representation(wanted: DataFrame, membership: DataFrame, term: str = "term", member: str = "member") -> DataFrame:
    """Overlap of a wanted member set with each term: k, set sizes, odds ratio, hypergeometric upper tail."""
    pairs = membership.select(term, member).distinct()
    pool = pairs.select(member).distinct()
    hits = small(pool.join(small(wanted), member, "left_semi"))
    per = pairs.join(hits.withColumn("_hit", F.lit(1)), member, "left").groupBy(term).agg(
        F.count(F.lit(1)).alias("term_size"), F.count("_hit").alias("overlap")
    )
    per = per.withColumn("pool_size", pool.agg(F.count(F.lit(1))).scalar()).withColumn("set_size", hits.agg(F.count(F.lit(1))).scalar())
    a, b = F.col("overlap"), F.col("set_size") - F.col("overlap")
    c, d = F.col("term_size") - F.col("overlap"), F.col("pool_size") - F.col("set_size") - F.col("term_size") + F.col("overlap")
    per = per.withColumn("odds_ratio", F.try_divide(a * d, b * c))
    return per.withColumn("p", tails.hypergeom_p("overlap", "pool_size", "term_size", "set_size"))


def neighbourhood_terms(touching: DataFrame, membership: DataFrame, seed: str = "seed", term: str = "term", member: str = "member", limit: float = 0.05) -> DataFrame:
    """The term tables of all seeds united: over-representation of each seed's neighbourhood (the seed and its neighbours), FDR within the seed.

    One row for each (seed, term) with an overlap: neighbourhood_size (members asked for), set_size (those the terms know), term_size, pool_size,
    overlap, p, fdr and ``significant``. A seed without neighbours is its own neighbourhood; unknown members count in neighbourhood_size only.
    """
    asked = touching.select(seed, F.col("neighbour").alias(member)).unionByName(touching.select(seed, F.col(seed).alias(member))).distinct()
    pairs = membership.select(term, member).distinct()
    pool = pairs.select(member).distinct()
    known = asked.join(pool.withColumn("_in", F.lit(1)), member, "left")
    sizes = known.groupBy(seed).agg(F.count(F.lit(1)).alias("neighbourhood_size"), F.count("_in").alias("set_size"))
    terms = pairs.groupBy(term).agg(F.count(F.lit(1)).alias("term_size"))
    hits = asked.join(pairs, member).groupBy(seed, term).agg(F.count(F.lit(1)).alias("overlap"))
    rows = hits.join(small(sizes), seed).join(small(terms), term).withColumn("pool_size", pool.agg(F.count(F.lit(1))).scalar())
    rows = rows.withColumn("p", tails.hypergeom_p("overlap", "pool_size", "term_size", "set_size"))
    return adjust_fdr(rows, family=[seed]).withColumn("significant", F.col("fdr") < limit)


def pattern_lines(docs: DataFrame, patterns: dict[str, str], key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line, pattern) for every line matching a named regular expression; lines count from 1."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("_p", "line"))
    hits = F.filter(F.array(*[F.when(F.col("line").rlike(rx), F.lit(name)) for name, rx in patterns.items()]), lambda n: n.isNotNull())
    return lines.select(key, (F.col("_p") + 1).alias("line_no"), "line", F.explode(hits).alias("pattern"))


def replace_in_order(docs: DataFrame, steps: Sequence[tuple[str, str]], text: str = "text", out: str = "new_text") -> DataFrame:
    """Apply regex replacements one after the other; flag rows that changed."""
    c: Column = F.col(text)
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return docs.withColumn(out, c).withColumn("changed", F.col(out) != F.col(text))


def changed_lines(docs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Lines that differ between two versions of a text, by line number."""
    old, new = F.split(before, "\n"), F.split(after, "\n")
    zipped = docs.select(key, F.posexplode(F.arrays_zip(old.alias("old_line"), new.alias("new_line"))).alias("_p", "_z"))
    return zipped.filter(~F.col("_z.old_line").eqNullSafe(F.col("_z.new_line"))).select(
        key, (F.col("_p") + 1).alias("line_no"), F.col("_z.old_line").alias("old_line"), F.col("_z.new_line").alias("new_line")
    )


def claim_table(metrics: DataFrame, rules: Sequence[tuple[str, str]], default: str = "NOT SUPPORTED") -> DataFrame:
    """Verdict per claim: the first rule whose SQL condition holds over the metric columns."""
    chain = F.when(F.expr(rules[0][0]), rules[0][1])
    for condition, name in rules[1:]:
        chain = chain.when(F.expr(condition), name)
    return metrics.withColumn("verdict", chain.otherwise(default))
