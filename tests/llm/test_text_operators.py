"""The text operators on small fixtures: brute-force versions, edge cases and round trips."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("cohortlab.llm")
import public_tokenizers

from cohortlab.llm import bpe, components, decontamination, fingerprints, langid, minhash, quotes, secretscan, substring, urlfilter, warc
from cohortlab.llm.queries import PIECES, RULES, WORD_BPE

DOCS = "doc_id bigint, text string"


def corpus(seed=1, n=60):
    """Random documents over few words, with copies, shared passages, repeats, blanks and nulls."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Straße", "été", "日本", "X" * 50]
    passage = [draw.choice(vocabulary) for _ in range(30)]
    texts = []
    for i in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([0, 1, 2, 5, 12, 13, 14, 40, 120]))]
        if i % 4 == 0:
            at = draw.randint(0, len(words))
            words[at:at] = passage
        if i % 5 == 0 and texts:
            words = (texts[draw.randrange(len(texts))] or "").split()
            if words and i % 10 == 0:
                words[draw.randrange(len(words))] = "changed"
        texts.append(draw.choice([" ", "\n", "  \t"]).join(words))
    texts[3], texts[7], texts[8] = None, "", " \n "
    texts[9] = " ".join(draw.choice(vocabulary) for _ in range(20_000))
    return [(i * 3, t) for i, t in enumerate(texts)]


def rows(df):
    return [r.asDict() for r in df.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# substring removal


def removed_by_force(docs, size=13):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, words in split:
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, words in split:
        gone = {i + k for i in range(len(words) - size + 1) if first[tuple(words[i : i + size])] < d for k in range(size)}
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[d] = (len(words), len(gone), sha(" ".join(kept)))
    return out


@pytest.mark.parametrize("options", [{}, {"max_cells": 1}, {"range_windows": 50}])
def test_repeated_passages_equal_brute_force(spark, options):
    docs = corpus()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substring.deduplicate(spark.createDataFrame(docs, DOCS).repartition(3), **options))}
    assert got == removed_by_force(docs)


def test_repeated_passages_edge_rows(spark):
    long = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(None, long), (5, long), (5, long), (7, long), (8, None)], DOCS).withColumn("gone", F.lit(1))
    got = sorted(((r["doc_id"] is None, r["doc_id"]), r["n_words"], r["n_removed"]) for r in rows(substring.deduplicate(docs)))
    assert got == [((False, 5), 40, 0), ((False, 5), 40, 0), ((False, 7), 40, 40), ((False, 8), 0, 0), ((True, None), 40, 0)]
    assert substring.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


# near duplicates


def components_by_force(docs, percent=80):
    sets = {}
    for d, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(words[i : i + 2]) for i in range(len(words) - 1)} or ({tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def near_rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows(df)}


def test_near_duplicates_equal_brute_force(spark):
    docs = corpus(2, 90)
    assert near_rows(minhash.near_duplicates(spark.createDataFrame(docs, DOCS))) == components_by_force(docs)


def test_near_duplicates_chains_and_mixed_buckets(spark):
    """Chains of edits, where the star's centre is not similar to all; few bands make mixed buckets."""
    draw = random.Random(5)
    words = [f"t{i}" for i in range(60)]
    docs, k = [], 0
    for _ in range(6):
        for _ in range(12):
            docs.append((k, " ".join(words)))
            words = list(words)
            for _ in range(2):
                words[draw.randrange(len(words))] = f"n{draw.randrange(10**6)}"
            k += 1
        words = words[:30] + [f"u{draw.randrange(10**6)}" for _ in range(30)]
    df = spark.createDataFrame(docs, DOCS)
    want = components_by_force(docs)
    assert near_rows(minhash.near_duplicates(df)) == want
    assert near_rows(minhash.near_duplicates(df, bands=120, rows=1)) == want


@pytest.mark.parametrize("copies", [0, 10**6])
def test_near_duplicates_many_blocks_and_portions(spark, monkeypatch, copies):
    """Clusters cut into several blocks and portions, as wholes and bucket by bucket."""
    for name, value in (("BLOCK_SHINGLES", 150), ("GUEST_SHINGLES", 200), ("MOST_COPIES", copies)):
        monkeypatch.setattr(minhash, name, value)
    docs = corpus(8, 50)
    words = [f"t{i}" for i in range(60)]
    for k in range(30):
        docs.append((1000 + k, " ".join(words)))
        words = [*words[2:], f"n{k}", f"m{k}"]
    found = minhash.near_duplicates(spark.createDataFrame(docs, DOCS), bands=120, rows=1)
    assert near_rows(found) == components_by_force(docs)


def test_near_duplicates_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "A B"), (3, None), (4, ""), (None, "a b"), (None, None)], DOCS).withColumn("rep", F.lit("x"))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in rows(minhash.near_duplicates(docs)))
    assert got == [("1", 1, "1", True), ("1", 1, "1", True), ("2", 1, "1", False), ("3", 0, "3", True), ("4", 0, "4", True), ("None", 0, "None", True), ("None", 1, "None", True)]
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_different_texts_under_one_id(spark):
    """Rows are documents: no text is dropped because another has its id."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    data = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (5, "one two three"), (5, "four five six"), (6, "four five six"), (None, a), (None, a), (7, None), (7, "")]
    found = rows(minhash.near_duplicates(spark.createDataFrame(data, DOCS)))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found)
    assert got == Counter([(1, 39, 1, True)] * 2 + [(2, 40, 1, False), (3, 40, 1, False), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (None, 39, None, True), (None, 39, None, True), (7, 0, 7, True), (7, 0, 7, True)])
    groups = {}
    for r in found:
        groups.setdefault((r["doc_id"], r["text_key"]), set()).add(r["group"])
    by_text = {t: next(iter(groups[d, spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0]])) for d, t in data if d in (1, 2, 3)}
    assert by_text[a] == by_text[a + " x"] != by_text[b] == by_text[b + " y"]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3), (8, None)]
    got = {r["node"]: r["component"] for r in rows(components.components(spark.createDataFrame(edges, "a bigint, b bigint")))}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 500 for k in range(500, 540)}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# decontamination


def contaminated_by_force(docs, items):
    split = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    strings = {}
    for item, text in items:
        words = split(text)
        size = min(13, len(words))
        for i in range(len(words) - size + 1) if size else ():
            strings.setdefault(tuple(words[i : i + size]), set()).add("" if item is None else str(item))
    out = {}
    for d, text in docs:
        words, hit, names = split(text), set(), set()
        for size in {len(s) for s in strings}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in strings:
                    hit |= set(range(i, i + size))
                    names |= strings[tuple(words[i : i + size])]
        out[d] = (len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(words))
    return out


ITEMS = [(1, " ".join(f"w{i}" for i in range(20))), (2, "w1-W2"), (10, "W5"), (3, None), (4, ""), (None, "w7 w8 w7 w8"), (11, "!!"), (12, " ".join(f"w{i}" for i in range(5, 22))), (13, "w9 w9")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination_equals_brute_force(spark, block_bytes):
    docs = [*corpus(3), (1000, "x " + " ".join(f"W{i}," for i in range(30)) + " y"), (1001, "w7 w8 w7 w8 w7 w8"), (1002, "w1 w2w1 w2")]
    df = spark.createDataFrame(docs, DOCS).withColumn("n_hit", F.lit("own"))
    found = decontamination.contamination(df, spark.createDataFrame(ITEMS, "item_id bigint, text string"), block_bytes=block_bytes)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(found)}
    assert got == contaminated_by_force(docs, ITEMS)


def test_large_benchmark_in_little_memory():
    """Tables of one block: some 40 bytes for each byte of benchmark text, measured as what is sent to a process."""
    import pickle
    import tracemalloc

    draw = random.Random(4)
    vocabulary = [f"word{i}".encode() for i in range(20_000)]
    items = [(str(k), b" ".join(draw.choices(vocabulary, k=2000))) for k in range(40)]
    size = sum(len(t) for _, t in items)
    sent = pickle.dumps(decontamination.Strings(items, 13).packed())
    tracemalloc.start()
    strings = decontamination.Strings.unpacked(pickle.loads(sent))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 60 * size
    words = strings.numbered(decontamination.words_of(b"x " + items[7][1] + b" y"))
    hits = [(a, {strings.names[k] for k in strings.tables[0].owners(s)}) for a, s in strings.tables[0].occurrences(words, strings.flat)]
    assert [a for a, _ in hits] == list(range(1, 1989)) and all(n == {"7"} for _, n in hits)


def test_repeated_benchmark_rows_and_blocks(spark):
    """A benchmark of many equal rows is one item; of many items, several blocks give the same rows as one."""
    docs = corpus(6, n=40)
    items = [(5, docs[4][1])] * 300 + [(k, t) for k, t in corpus(7, n=30) if t]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    want = contaminated_by_force(docs, items)
    for block_bytes in (1 << 20, 20_000):
        found = decontamination.contamination(df, bench, block_bytes=block_bytes)
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(found)} == want


def test_contamination_empty_sides(spark):
    docs, none = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], DOCS), spark.createDataFrame([], "item_id bigint, text string")
    assert [(r["n_words"], r["contaminated"]) for r in rows(decontamination.contamination(docs, none).orderBy(F.col("doc_id").desc()))] == [(1, False), (1, False), (0, False)]
    assert decontamination.contamination(docs.limit(0), none).count() == 0


# archives


def test_archives_round_trip(spark):
    big = "é" * 50_000
    pages = [(1, "http://a/x", "<p>1</p>"), (2, "http://a/y\r\nX: 1", "<p>1</p>"), (3, None, None), (4, "u", ""), (5, "v", big), (None, "w", "<p>1</p>"), (6, "z", "\r\n\r\nodd\r\n\r\n"), (2, "http://a/y", "<p>1</p>"), (None, "n", "alone")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload", F.lit(0)).repartition(3)
    got = rows(warc.archived(df))
    kinds = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in got)
    assert kinds == sorted([
        ("1", 8, "revisit", "2"), ("2", 8, "response", "None"), ("2", 8, "response", "None"), ("3", 0, "revisit", "4"), ("4", 0, "response", "None"), ("5", 100_000, "response", "None"),
        ("None", 8, "revisit", "2"), ("6", 11, "response", "None"), ("None", 5, "response", "None"),
    ])
    assert all(r["payload_digest"] == warc.base32_sha1(r["payload"]) for r in got if r["record_type"] == "response")
    assert {r["payload"].decode() for r in got if r["payload"]} == {"<p>1</p>", big, "\r\n\r\nodd\r\n\r\n", "alone"}
    assert warc.archived(df.limit(0)).count() == 0
    assert {r["record_type"] for r in rows(warc.archived(df, min_bytes=1 << 20))} == {"response"}


def test_selected_records_are_read_by_few_ranges(spark):
    places = [("a", 0, 10), ("a", 10, 10), ("a", 500, 10), ("a", 515, 10), ("b", 0, 10), ("b", 10, 95)]
    assert list(warc.ranges(places, gap=5, read_bytes=100)) == [("a", 0, 20, 0, 2), ("a", 500, 525, 2, 4), ("b", 0, 10, 4, 5), ("b", 10, 105, 5, 6)]
    folder = str(spark.sparkContext.getCheckpointDir() or "/tmp") + "/warc-selected"
    index = warc.write_archives(spark.range(50).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(cast(id AS string), 20) AS html"), folder)
    got = rows(warc.read_records(index.filter("page_id % 7 = 3"), folder))
    assert {r["page_id"]: r["payload"].decode() for r in got} == {i: str(i) * 20 for i in range(3, 50, 7)}


# language identification


def brute_forward(word, pieces, p, single):
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(word[start:i])
                start = i
        value = 1.0
        for part in parts:
            value *= p[pieces.index(part)] if part in pieces else single if len(part) == 1 else 0
        total += value
    return total


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "é"]
    p = np.random.default_rng(0).random((9, 2))
    lattice = langid.Lattice(pieces, p)
    for word in ("▁abab", "▁a", "▁xab", "▁abaébé"):
        want = [np.log(brute_forward(word, pieces, p[:8, k], p[8, k])) for k in range(2)]
        assert np.allclose(lattice.scores([word])[0], want) and np.allclose(lattice.long(word), want)


def test_long_words_count_whole():
    """A word of 40 characters whose tail decides: expected counts equal those of the short form, and the tail is learned."""
    pieces = [langid.MARK, "a", "b", "c", "ab", "bc", "abc"]
    draw = random.Random(2)
    p = np.array([[draw.random() for _ in range(2)] for _ in range(len(pieces) + 1)])
    lattice = langid.Lattice(pieces, p / p.sum(axis=0))
    for word in ("abcab", "abx" * 3, "c"):
        whole, other = lattice.expected([langid.MARK + word], np.array([2.0]), 1), np.zeros(len(pieces) + 1)
        lattice.long_expected(langid.MARK + word, 2.0, lattice.p[:, 1], other)
        assert np.allclose(whole, other)
    long = langid.MARK + "a" * 40 + "bc"
    counts = lattice.expected([long], np.array([1.0]), 0)
    assert counts[pieces.index("a")] > 0 and counts[pieces.index("c")] + counts[pieces.index("bc")] + counts[pieces.index("abc")] == pytest.approx(1.0)
    assert np.allclose(lattice.scores([long, langid.MARK + "ab"])[0], lattice.long(long))


def test_letters_are_of_category_l_with_their_marks():
    runs = re.compile(langid.run_pattern())
    assert langid.letter_runs("½ ② Ⅷ 12 _ क्षि Été日本 don't x́y", runs) == ["क्षि", "été日本", "don", "t", "x́y"]
    runs = re.compile(langid.run_pattern())
    assert langid.letter_runs("½ ² ①", runs) == []


def test_words_in_use_stay_remembered(monkeypatch):
    """Texts are judged alike whatever a worker still remembers."""
    pieces = [langid.MARK, *"abcdefgh"]
    p = np.array([[random.Random(k).random(), random.Random(k + 99).random()] for k in range(len(pieces) + 1)])
    model = {"languages": ["u", "v"], "pieces": pieces, "p": p / p.sum(axis=0)}
    draw = random.Random(8)
    batches = [[" ".join("".join(draw.choices("abcdefgh", k=3)) for _ in range(30)) for _ in range(5)] for _ in range(12)]

    def judged(size):
        monkeypatch.setattr(langid, "REMEMBERED", size)
        held = dict(model, lattice=langid.Lattice(pieces, model["p"]), compiled=re.compile(langid.run_pattern()), younger=langid.Places(2), older=langid.Places(2))
        return [langid._judged(b, held) for b in batches]

    names = [n for n, _ in judged(10**6)]
    assert names == [n for n, _ in judged(40)]
    coder = bpe.Coder(bpe.read_vocabulary(WORD_BPE))
    want = [coder.encode(t) for b in batches for t in b]
    coder.known = bpe.Remembered(coder.merged, 20)
    assert [coder.encode(t) for b in batches for t in b] == want and len(coder.known) <= 20


def test_expected_counts_add_up():
    pieces = ["▁", "a", "b", "ab"]
    lattice = langid.Lattice(pieces, np.full((5, 1), 0.2))
    found = lattice.expected(["▁ab", "▁xb"], np.array([3.0, 1.0]), 0)
    assert found[0] == pytest.approx(4) and found[4] == pytest.approx(1)  # each word starts with the mark; one unknown character
    assert found[2] + found[3] == pytest.approx(4)  # both words end in b, alone or in ab
    assert found[1] + found[3] == pytest.approx(3)


def test_language_of_held_out_and_edge_rows(spark):
    draw = random.Random(4)
    words = {"en": ["the", "house", "with", "water", "thing", "there"], "de": ["das", "haus", "mit", "wasser", "über", "nicht"]}
    docs = [(i, " ".join(draw.choice(words[lang]) for _ in range(draw.randint(3, 30))), lang) for i in range(80) for lang in [draw.choice(["en", "de"])]]
    odd = [(200, None, "en"), (201, "12 34!", "en"), (202, "", None), (None, "das wasser", "xx"), (203, "das haus " * 5000, None), (204, "w" * 3000, None)]
    df = spark.createDataFrame(docs + odd, DOCS + ", lang string").withColumn("score", F.lit("own"))
    model = langid.learned(df, langid.read_pieces(PIECES), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows(langid.predicted(df, model))}
    assert model["languages"] == ["de", "en"]
    assert all(got[i][0] == lang for i, _, lang in docs if zlib.crc32(str(i).encode()) % 4 == 2)
    assert [got[i] for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert got[None][0] == got[203][0] == "de" and got[204][0] in ("de", "en")
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = langid.learned(df.limit(0), langid.read_pieces(PIECES), F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in rows(langid.predicted(df, empty))} == {("und", 0.0)}


# fingerprints


@pytest.mark.parametrize("most", [3, 5000])
def test_fingerprints_against_the_next_document(spark, monkeypatch, most):
    monkeypatch.setattr(fingerprints, "MOST_RANGES", most)
    docs = [(d, t) for d, t in corpus(6, 50) if d != 27] + [(10**12, "last one " * 9)]
    draw = list(docs)
    random.Random(0).shuffle(draw)
    df = spark.createDataFrame(draw, DOCS).withColumn("n_chars", F.lit(-1)).repartition(4)
    got = {r["doc_id"]: r for r in rows(fingerprints.fingerprints(df, range_rows=7))}
    order = sorted(docs)
    assert len(got) == len(docs)
    for (d, text), (e, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following, r = text or "", following or "", got[d]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited)), d
        a, b, c = (set(re.findall(".{16}", x)) for x in (r["fingerprint"], r["edited_fingerprint"], got[e]["fingerprint"]))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
        assert r["near_next"] == pytest.approx(len(a & c) / len(a | c) if a | c else 1)
        assert r["contained_next"] == pytest.approx(len(a & c) / len(a) if a else 1)
        assert bool(r["fingerprint"]) == bool(text.split())


def test_fingerprint_estimates_containment(spark):
    words = [f"x{i}" for i in range(4000)]
    one, two = " ".join(words), " ".join(words[1000:1400])
    df = spark.createDataFrame([(one, two)], "one string, two string").select(fingerprints.sketch(F.col("one")).alias("a"), fingerprints.sketch(F.col("two")).alias("b"))
    r = df.select(fingerprints.containment(F.col("b"), F.col("a")).alias("c"), fingerprints.likeness(F.col("a"), F.col("b")).alias("j"), F.size("a").alias("n")).first()
    assert r["c"] == 1.0 and r["j"] == pytest.approx(0.1, abs=0.05) and 400 < r["n"] < 600


def test_fingerprint_edge_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, None), (4, None), (5, "z")], DOCS)
    got = rows(fingerprints.fingerprints(df))
    assert sorted(str(r["doc_id"]) for r in got) == ["4", "4", "5", "None"]
    single = rows(fingerprints.fingerprints(df.filter("doc_id = 5")))[0]
    assert single["near_next"] == 1.0 and single["n_chars"] == 1
    assert fingerprints.fingerprints(df.limit(0)).count() == 0
    assert len(rows(fingerprints.fingerprints(df.filter("doc_id IS NULL")))) == 1


# secrets


SECRETS = [
    (1, 'x PASSWORD = "hunter2abc" y', "a"), (2, "api_key:abc token=", "a"), (3, None, "a"), (4, "", None), (5, "AKIA" + "A" * 16 + " AKIASHORT", "b"), (6, "0123456789abcdef01234567 0123456789abcdef0123456", "b"),
    (7, "new Zx9-Qm4_Tr7+Lp2/Vb8Kd key", "c"), (8, "copied Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8", "a"), (9, "copied Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8 é", "b"), (10, "日本 secret=0123456789abcdef01234567 end", "c"),
    (11, "passſwd=abcdefgh toKen=abcdefgh", "c"), (12, "token==abcdef token=abc token='abcdefg'", "c"), (1, 'x PASSWORD = "hunter2abc" y', "a"),
]


def base_by_force(text):
    out = []
    pattern = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [s for *_, s in sorted(out)]


def test_secrets_base_spans_and_ownership(spark):
    df = spark.createDataFrame(SECRETS, DOCS + ", source string").withColumn("repo", F.lit("clash"))
    got = rows(secretscan.secrets(df, repo=F.col("doc_id"), owner=F.col("source")))
    assert len(got) == len(SECRETS)
    by_id = {r["doc_id"]: r for r in got}
    for d, text, _ in SECRETS:
        base = base_by_force(text or "")
        r = by_id[d]
        assert r["base_sha256"] == sha(",".join(base)), (d, r)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r["spans"].split(",")) or not base
    assert by_id[7]["spans"] == "owned:4:25" and by_id[7]["n_live"] == 1
    assert by_id[8]["spans"] == by_id[9]["spans"] == "" and by_id[8]["n_copied"] == 1
    assert by_id[1]["n_live"] == 1 and by_id[3]["spans"] == ""
    assert secretscan.secrets(df.limit(0), repo=F.col("doc_id"), owner=F.col("source")).count() == 0


def test_secret_of_one_owner_in_many_documents(spark):
    token = "Zx9-Qm4_Tr7+Lp2/Vb8Kd"
    data = [(d, f"new {token} key", "c") for d in range(1501)] + [(d, "copied Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8", "ab"[d % 2]) for d in range(2000, 3200)]
    df = spark.createDataFrame(data, DOCS + ", source string")
    found = secretscan.secrets(df, repo=F.col("doc_id"), owner=F.col("source"))
    assert Counter((r["spans"], r["n_live"], r["n_copied"]) for r in rows(found)) == {("owned:4:25", 1, 0): 1501, ("", 0, 1): 1200}
    assert {r["text"] for r in rows(secretscan.redacted(df, found)) if r["doc_id"] < 2000} == {"new [owned] key"}


def test_many_spans_in_one_text():
    """A text of very many base spans and candidates takes time in proportion, and only runs that no span touches are candidates."""
    import time

    piece = "password=abcdefgh12 Zx81kQ92mWp03LsT47vB " + "0123456789abcdef" * 2 + " "
    start = time.time()
    text = piece * 20_000
    base = secretscan.base_spans(text)
    found = secretscan.candidate_spans(text, base, secretscan.ENTROPY)
    assert time.time() - start < 20 and len(base) == 40_000 and len(found) == 20_000
    small = piece * 5
    base = secretscan.base_spans(small)
    runs = [(m.start(), m.end()) for m in re.finditer(secretscan.CANDIDATE, small)]
    want = [r for r in runs if secretscan.bits(small[slice(*r)]) >= secretscan.ENTROPY and not any(s < r[1] and r[0] < e for _, s, e, _ in base)]
    assert [(a, b) for _, a, b, _ in secretscan.candidate_spans(small, base, secretscan.ENTROPY)] == want


def test_values_are_counted_by_repository_and_owner(spark):
    """most_repos: in how many distinct repositories the most spread value of a document is; equal either way of joining."""
    value = "Zx81kQ92mWp03LsT47vB"
    data = [(i, f"see {value}", "a" if i < 4 else "b") for i in range(6)] + [(3, f"see {value}", "a"), (9, "nothing", "a"), (10, None, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    found = rows(secretscan.secrets(df, repo=F.col("doc_id"), owner=F.col("source")))
    assert {(r["doc_id"], r["most_repos"], r["n_copied"]) for r in found} == {(i, 6, 1) for i in range(6)} | {(9, 0, 0), (10, 0, 0)}


def test_secrets_are_redacted(spark):
    df = spark.createDataFrame(SECRETS, DOCS + ", source string").withColumn("n_chars", F.length("text").cast("bigint"))
    got = rows(secretscan.redacted(df, secretscan.secrets(df, repo=F.col("doc_id"), owner=F.col("source"))))
    assert len(got) == len(SECRETS)
    texts = {r["doc_id"]: r for r in got}
    assert texts[1]["text"] == "x [assign] y" or texts[1]["text"] == 'x [assign]" y'
    assert texts[10]["text"] == "日本 [assign] end" and texts[10]["n_chars"] == len("日本 [assign] end")
    assert texts[3]["text"] is None and texts[8]["text"] == SECRETS[7][1]


# token ids


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    draw = random.Random(3)
    pool = "aAbB zZ'sS  \t\n.,!?0123éÉüßΣσςİıÅ̧̌日本語한국어🙂👍🏽\x1c\x85\xa0 ½²Ⅷ٣_-+<|endoftext|>"
    texts = ["".join(draw.choice(pool) for _ in range(draw.randint(0, 40))) for _ in range(400)] + [None, "", "<|endoftext|> Hi <|startoftext|>", "word " * 5000, "x" * 3000, "don't we'll IT'S"]
    texts += ["".join(chr(draw.choice([draw.randint(1, 0x2FF), draw.randint(0x300, 0xD7FF), draw.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(300)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("ids", F.lit("clash"))
    plain = bpe.encoded(df, WORD_BPE)
    got = {r["doc_id"]: r for r in rows(bpe.decoded(plain, WORD_BPE))}
    digests = {r["doc_id"]: r for r in rows(bpe.encoded(df, WORD_BPE, digests=True))}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False)
        back = library.decode(want.ids, skip_special_tokens=False)
        assert (got[i]["ids"], got[i]["n_tokens"], got[i]["decoded"]) == (want.ids, len(want.ids), back), text
        assert (digests[i]["ids_sha256"], digests[i]["decoded_sha256"]) == (sha(" ".join(map(str, want.ids))), sha(back))
    assert bpe.encoded(df.limit(0), WORD_BPE).count() == 0


# quotes


MESSAGES = [
    (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> Hello there.\n> How are you?\nFine,   thanks."), (1, 2, "user", "Ann wrote:\n>> hello there.\n>> How are you?\n> fine, thanks.\nGood to hear."),
    (1, 3, "user", "Unrelated."), (2, 0, "user", "> Good to hear.\nMe too."), (2, 1, "user", ">nothing known\nOnly this."), (3, 0, None, None), (3, 1, "user", ""), (None, 0, "user", "> Unrelated.\nLost."), (1, 3, "user", "Unrelated."),
    (4, 0, "user", "Para one.\n\nPara two."), (4, 5, "user", "> Para two.\nyes"), (4, 6, "user", "> yes\n> Self.\nSelf."),
]


def test_quotes_are_linked_and_ordered(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id bigint, turn bigint, role string, text string").withColumn("mid", F.lit(0))
    got = rows(quotes.reply_ordered(df))
    assert len(got) == len(MESSAGES)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    link = lambda c, t: (by[c, t]["parent_conv"], by[c, t]["parent_turn"], by[c, t]["thread_conv"], by[c, t]["thread_turn"], by[c, t]["depth"])
    assert link(1, 1) == (1, 0, 1, 0, 1)
    assert link(1, 2) == (1, 1, 1, 0, 2) and by[1, 2]["own_text"] == "Good to hear." and by[1, 2]["n_quotes"] == 2
    assert link(2, 0) == (1, 2, 1, 0, 3)
    assert link(2, 1) == (None, None, 2, 1, 0) and by[2, 1]["own_text"] == "Only this."
    assert link(4, 5) == (4, 0, 4, 0, 1)
    assert by[1, 1]["formatted"] == "<|assistant|>\nFine,   thanks.\n" and by[3, 0]["own_text"] == ""
    assert link(None, 0)[0] is None and by[None, 0]["own_text"] == "Lost."
    assert quotes.reply_ordered(df.limit(0)).count() == 0


PARTIAL = [
    (1, 0, "Intro of three.\n\nMiddle part.\n\nClosing words."), (1, 1, "> Intro of three.\n>\n> Closing words.\nTwo of three paragraphs."),
    (2, 0, "the question"), (2, 1, "first answer\nand more of it\n> the question\nsecond answer"), (2, 2, "> first answer\n> and more of it\nfine\n>> the question\n> second answer\nagreed"),
    (3, 0, "Hi,\nline two of it\nline three of it"), (3, 1, "Hi,\nalpha beta gamma\ndelta epsilon zeta\nnot quoted"), (3, 2, "> Hi,\n> alpha beta gamma\n> delta epsilon zeta\nThree of four lines."), (3, 3, "> line two of it\nA line."),
    (4, 0, "One sentence here. A second, rather long sentence! And a third?"), (4, 1, "> A second, rather\n> long sentence!\nA sentence, wrapped anew."), (4, 2, "> nowhere written\n> at all\nNo original."),
    (5, 0, "> a second, rather long sentence!  And a third?\nFrom another conversation."),
    (6, 0, "Both lines of\nthe whole"), (6, 1, "the whole"), (6, 2, "> the whole\n\n> both lines of\n> the whole\nCoarse and first."), (6, 2, "> the whole\n\n> both lines of\n> the whole\nCoarse and first."),
    (6, 3, "> the whole\n> and what nobody wrote\n\n> Both lines of\n> the whole\nA whole passage before a line."),
    (7, 0, "Top.\r\n\r\nMid one.\r\nMid two.\r\n\r\nEnd."), (7, 1, "Ann wrote:\r\n> Mid two.\r\n> \r\n> End.\r\nok"),
]


def test_trimmed_and_inline_quotes_are_linked(spark):
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in PARTIAL], "conv_id bigint, turn bigint, role string, text string")
    got = rows(quotes.reply_ordered(df))
    assert len(got) == len(PARTIAL)
    parent = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in got if r["parent_conv"] is not None}
    assert parent == {(1, 1): (1, 0), (2, 1): (2, 0), (2, 2): (2, 1), (3, 2): (3, 1), (3, 3): (3, 0), (4, 1): (4, 0), (5, 0): (4, 0), (6, 2): (6, 1), (6, 3): (6, 0), (7, 1): (7, 0)}
    assert {r["n_quotes"] for r in got if (r["conv_id"], r["turn"]) == (2, 2)} == {3}


def test_reply_order_puts_replies_after_parents(spark):
    chain = [(1, t, "user", (f"> line {t - 1} of it\n" if t else "") + f"line {t} of it") for t in range(40)]
    got = rows(quotes.reply_ordered(spark.createDataFrame(chain, "conv_id bigint, turn bigint, role string, text string")).orderBy("thread_conv", "thread_turn", "conv_id", "turn"))
    assert [r["depth"] for r in got] == list(range(40)) and {r["thread_turn"] for r in got} == {0}


# URL rules


def page(i, url, html=""):
    return (i, url, html)


PAGES = [
    page(1, "http://a.NET/x"), page(2, "https://www.example.net/en/1?q#f"), page(3, "http://example.net/fr/"), page(4, "http://x.example.com/de/1"), page(5, "http://example.com/en/"), page(6, "http://notnet/"), page(7, None), page(8, "no scheme"), page(9, "http://net"),
    page(10, "http://clean.example.com/a", '<link href="http://bad.net/x" rel="canonical">'), page(11, "http://clean.example.com/b", "<meta http-equiv=refresh content='0; url=/a'>"),
    page(12, "http://other.example.com/c", '<link rel="canonical" href="http://bad.net/y">'), page(13, "http://alias.example.com/d", "<link rel=canonical href=http://fr.org/fr/z>"),
    page(14, "http://alias.example.com/e", '<link rel="canonical" href="/d"> <meta http-equiv="refresh" content="1;URL=http://bad.net/q">'), page(15, "https://clean.example.com/a#top"), page(1, "http://a.NET/x"), page(None, "http://b.org/fr/", None),
]


def test_url_rules_and_aliases(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("verdict", F.lit("own"))
    got = rows(urlfilter.judged(df, RULES))
    assert len(got) == len(PAGES)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[1] == ("a.net", "/x", "net/", "block") and by[2] == ("www.example.net", "/en/1", "example.net/en/", "allow") and by[3][2:] == ("net/", "block")
    assert by[4][2:] == ("example.com/de/", "block") and by[5][2:] == (None, "allow") and by[6][2:] == (None, "allow") and by[7] == by[8] == ("", "", None, "allow")
    assert by[9] == ("net", "", None, "allow") and by[None][2:] == ("org/fr/", "allow")
    assert [by[i][3] for i in (10, 11, 12, 15)] == ["block"] * 4  # aliases of blocked URLs, directly and over another page
    assert [by[i][3] for i in (13, 14)] == ["allow"] * 2  # the component has an explicitly allowed URL
    assert urlfilter.judged(df.limit(0), RULES).count() == 0
    redirects = spark.createDataFrame([("http://example.com/en/", "http://bad.net/x"), (None, "http://q.net/")], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in rows(urlfilter.judged(df, RULES, redirects))}[5] == "block"


def test_digests_by_word_equal_digests_by_id():
    """Words remembered with their ids as text give the digests of the whole list of ids, added tokens and other scripts included."""
    coder = bpe.Coder(bpe.read_vocabulary(WORD_BPE))
    added = next(iter(coder.added), "")
    for text in ("", " ", "It's 2024, isn't it?  Étude ΣΑΣ 漢字\x1c x", f"a{added}b {added}", "a b a b" * 50):
        ids = coder.encode(text)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert coder.digests(text) == (len(ids), sha(" ".join(map(str, ids))), sha(coder.decode(ids)))
