"""Secret scan with corpus-wide ownership frequency.

Base spans, leftmost and not overlapping for each kind: ``assign`` (a key word, a separator and a value of six
or more characters), ``access`` (an access key id of 20 or more), ``hex`` (24 or more hex digits). Besides,
a run of 20 or more token characters with letters and digits and at least ``entropy`` bits a
character is a candidate when no base span touches it.

Every candidate value and every base value is hashed, and the hashes are counted over the corpus: in how many distinct
repositories, of how many distinct owners. A candidate of a single owner, in however many repositories, looks
live and becomes an ``owned`` span; one that several owners have is a copied example and does not.
Base spans always stay; ``n_live`` and ``n_copied`` tell how many of all values look live and how many are copied, ``most_repos`` in how many
repositories the most spread value of a document is.

Counts are three grouped aggregations with map-side combine, so a value pasted into a third of all
documents is one row per task, not one group; they go back to the occurrences by a measured broadcast, else with every value spread over
several tasks. Null texts are empty. A null repository or owner is one of its own. Texts of any length are scanned whole. Spans that start at
one place are ordered by kind as listed above. Every input row gives one row, repeated rows equal ones; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.llm.batches import extended
from cohortlab.llm.store import measured, salted_join, written

# fixed values: the patterns of the base kinds, and the words of which "assign" needs one
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
ENTROPY = 3.5


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in re.finditer(ACCESS, text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m[0]) for m in re.finditer(HEX, text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def bits(value: str) -> float:
    """Shannon entropy of the characters."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def candidate_spans(text: str, base: list, entropy: float) -> list[tuple[str, int, int, str]]:
    """High-entropy runs that no base span touches. ``base`` is in order of its starts."""
    out, starts, furthest = [], [s[1] for s in base], list(accumulate((s[2] for s in base), max))
    for m in re.finditer(CANDIDATE, text):
        value = m[0]
        if re.search("[0-9]", value) and re.search("[A-Za-z]", value) and bits(value) >= entropy:
            before = bisect_left(starts, m.end())  # spans that begin before the run ends
            if not before or furthest[before - 1] <= m.start():
                out.append(("owned", m.start(), m.end(), value))
    return out


def _scanned(docs: DataFrame, entropy: float) -> DataFrame:
    def work():
        def step(batch):
            out = {"n_assign": [], "n_access": [], "n_hex": [], "base": [], "found": [], "hashes": []}
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                every = base + candidate_spans(text, base, entropy)
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                out["base"].append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in base))
                out["found"].append([f"{k}:{a}:{b}" for k, a, b, _ in every])
                out["hashes"].append([hashlib.sha256(v.encode()).hexdigest()[:32] for *_, v in every])
            return out

        return step

    return extended(docs, "text", "n_assign bigint, n_access bigint, n_hex bigint, base string, found array<string>, hashes array<string>", work)


def ownership(values: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners over rows (hash, repo, owner): distinct repositories and owners of each hash."""
    each = values.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def secrets(docs: DataFrame, repo: Column, owner: Column, entropy: float = ENTROPY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, _key (xxhash64 of the text), n_assign, n_access, n_hex, base_sha256, spans,
    and the numbers n_live, n_copied and most_repos. ``repo`` and ``owner`` are columns of ``docs``."""
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"))
    scanned = _scanned(narrow.withColumn("_key", F.xxhash64("text")), entropy).drop("text")
    rows, _ = written(scanned.withColumn("_row", F.monotonically_increasing_id()), "scanned")
    values = rows.filter("size(hashes) > 0").select("_row", "repo", "owner", F.explode(F.arrays_zip("found", "hashes")).alias("x")).select("_row", "repo", "owner", F.col("x.found").alias("span"), F.col("x.hashes").alias("hash"))
    counts, _ = written(ownership(values.select("hash", "repo", "owner")), "ownership")
    held = salted_join(values, counts, ["hash"], "hash")
    live = F.expr("n_owners = 1")
    judged = held.groupBy("_row").agg(
        F.max("n_repos").alias("most_repos"), F.sum(live.cast("bigint")).alias("n_live"), F.sum(F.expr("n_owners > 1").cast("bigint")).alias("n_copied"),
        F.collect_list(F.when(live & F.col("span").startswith("owned:"), F.col("span"))).alias("more"),
    )
    at, kind = (lambda s: F.split(s, ":")[1].cast("int")), (lambda s: F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]))
    every = F.concat(F.when(F.col("base") != "", F.split("base", ",")).otherwise(F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(at(s).alias("at"), kind(s).alias("kind"), s.alias("span"))))
    zero = F.lit(0).cast("bigint")
    return rows.join(judged, "_row", "left").select(
        "doc_id", "_key", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), F.array_join(F.transform(ordered, lambda s: s.getField("span")), ",").alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"), F.coalesce("most_repos", zero).alias("most_repos"),
    )


def redacted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with every span of ``found`` (doc_id, _key, spans) replaced by ``[kind]``; overlapping spans give one mark.

    Rows are matched by id and text, so repeated rows are all redacted. A null text stays null; n_chars, where it exists, follows.
    """
    hits = found.filter("spans <> ''").select(F.col("doc_id").alias("__id"), F.col("_key").alias("__of"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__of"])
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__of"))
    joined = docs.join(measured(hits, "__spans"), match, "left").drop("__id", "__of")

    def work():
        def step(batch):
            return {"text": [t if not s else _marked(t, s) for t, s in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist(), strict=True)]}

        return step

    changed = extended(joined.withColumnRenamed("text", "__text"), "__text", "text string", work).drop("__text", "__spans")
    changed = changed.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))) if "n_chars" in docs.columns else changed
    return changed.select(*docs.columns)


def _marked(text: str, spans: str) -> str:
    out, at = [], 0
    for kind, start, end in (s.split(":") for s in spans.split(",")):
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])
