"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. The likelihood of a word is the
sum over all its segmentations into pieces of the product of their probabilities, by the forward
algorithm; pieces do not cross words, so a text's likelihood is the product over its words. Words are
letter runs, lower-cased, with the vocabulary's word mark in front: a letter (Unicode category L) and the letters and combining marks after it. A single character
outside the vocabulary is a piece of its own with the smoothing probability.

Training takes expected piece counts over all segmentations (forward and backward sums) of the counted
words of a sample of the labelled documents, ``sample_docs`` per language in expectation, chosen by a hash of the id,
and starts from equal probabilities. Gathered: at most pieces times languages numbers a round, whatever the corpus.

The score is the posterior of the predicted language under equal priors. A text without a letter, or null, is ``und`` with
score 0, as is every text if nothing could be learned. Rows with a null id are predicted but never learned from.
Every input row gives one row, repeated rows equal ones. Words and texts of any length count whole. Of languages with equal likelihood the
first by name wins. An empty table gives no rows. Columns of the input named as an added one are replaced.

A worker remembers the likelihoods of words in two generations of at most ``REMEMBERED`` words, of which the older is dropped when the younger is full.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.llm.batches import GOLDEN, extended, mixed, odd_steps
from cohortlab.llm.store import written

MARK = "▁"
SAMPLE_DOCS = 4000
ROUNDS = 3
SMOOTHING = 0.1
MAX_LANGUAGES = 400
REMEMBERED = 120_000
LONG = 32
ASCII_RUNS = re.compile("[a-z]+")


def category(kind: str) -> str:
    """Ranges of all characters whose Unicode category begins with ``kind``, for use inside brackets."""
    inside = [unicodedata.category(chr(c))[0] == kind for c in range(sys.maxunicode + 1)] + [False]
    limits = [c for c in range(sys.maxunicode + 2) if inside[c] != (c > 0 and inside[c - 1])] if not inside[0] else []
    return "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in zip(limits[::2], limits[1::2], strict=True))


@functools.cache
def run_pattern() -> str:
    """The pattern of a lower-cased letter run. Made on the driver and sent to tasks as text."""
    letters = category("L")
    return f"[{letters}][{letters}{category('M')}]*"


def letter_runs(text: str, runs: re.Pattern) -> list[str]:
    """The letter runs of a text, lower-cased; ``runs`` is the compiled ``run_pattern``."""
    return (ASCII_RUNS if text.isascii() else runs).findall(text.lower())


def read_pieces(path: str) -> list[str]:
    """The word pieces of a public sentencepiece file: those with letters, and the word mark only in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and piece.lower() == piece and piece.lstrip(MARK).isalpha() and piece.count(MARK) <= 1:
            out.append(piece)
    return [MARK, *out]


class Lattice:
    """Forward (and backward) sums over the segmentations of words, for all languages at once."""

    def __init__(self, pieces: list[str], probability: np.ndarray):
        # the row after the pieces is a single character outside the vocabulary
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.single = len(pieces)
        self.longest = max(map(len, pieces))
        self.p = probability
        self.base = int(odd_steps(1, 11)[0])
        keys = np.concatenate([self._spans([p for p in pieces if len(p) == n], n, [(0, n)])[0] for n in range(1, self.longest + 1)])
        held = [i for n in range(1, self.longest + 1) for i, p in enumerate(pieces) if len(p) == n]
        order = np.argsort(keys)
        self.keys, self.piece = keys[order], np.array(held)[order]

    def _spans(self, words: list[str], n: int, spans: list[tuple[int, int]]) -> list[np.ndarray]:
        """For each span, a 64-bit hash of these characters of each word (all words have ``n``)."""
        code = np.array(words, f"<U{n}").view(np.uint32).reshape(len(words), n).T.astype(np.uint64)
        up = np.array([pow(self.base, i, 1 << 64) for i in range(n)], np.uint64)
        down = np.array([pow(self.base, -i, 1 << 64) for i in range(n)], np.uint64)
        total = np.zeros((n + 1, len(words)), np.uint64)
        np.cumsum(mixed((code + np.uint64(1)) * np.uint64(GOLDEN)) * up[:, None], axis=0, out=total[1:])
        return [(total[j] - total[i]) * down[i] for i, j in spans]

    def found(self, words: list[str], n: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, pieces): which of the words have which piece there. By ``to``."""
        spans = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - self.longest), j)]
        out = []
        for (i, j), key in zip(spans, self._spans(words, n, spans), strict=True):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            if j - i == 1:
                out.append((i, j, np.arange(len(words)), np.where(known, self.piece[at], self.single)))
            elif known.any():
                out.append((i, j, np.flatnonzero(known), self.piece[at[known]]))
        return out

    def forward(self, found, p: np.ndarray, words: int, n: int) -> np.ndarray:
        alpha = np.zeros((n + 1, words, *p.shape[1:]))
        alpha[0] = 1
        for i, j, at, ids in found:
            alpha[j, at] += alpha[i, at] * p[ids]
        return alpha

    def groups(self, words: list[str]):
        """Places of the words of one length, a bounded number at a time."""
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, group in by_length.items():
            for at in range(0, len(group), 4096):
                yield n, group[at : at + 4096]

    def scores(self, words: list[str]) -> np.ndarray:
        """log likelihood of each word (with its mark) in each language."""
        out = np.zeros((len(words), self.p.shape[1]))
        for n, part in self.groups(words):
            if n > LONG:
                for k in part:
                    out[k] = self.long(words[k])
            else:
                some = [words[k] for k in part]
                out[part] = np.log(self.forward(self.found(some, n), self.p, len(some), n)[n])
        return out

    def long(self, word: str) -> np.ndarray:
        """The same for a word of any length, rescaled as it goes."""
        alpha, log = [np.ones(self.p.shape[1])], np.zeros(self.p.shape[1])
        for j in range(1, len(word) + 1):
            total = np.zeros(self.p.shape[1])
            for back in range(1, min(len(alpha), self.longest) + 1):
                i = self.ids.get(word[j - back : j], self.single if back == 1 else None)
                if i is not None:
                    total = total + alpha[-back] * self.p[i]
            log += np.log(total)
            alpha = [a / total for a in [*alpha, total][-self.longest :]]
        return log

    def long_expected(self, word: str, count: float, p: np.ndarray, out: np.ndarray) -> None:
        """Add to ``out`` what ``expected`` counts in one word of any length.

        Only ratios of neighbouring forward sums are kept, and going back the probability that a segmentation is cut at a place.
        """
        n, longest, ids = len(word), self.longest, self.ids
        ratio = np.ones(n + 1)
        spans: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            back, total = 1.0, 0.0
            for i in range(j - 1, max(-1, j - longest - 1), -1):
                if i < j - 1:
                    back /= ratio[i + 1]
                piece = ids.get(word[i:j], self.single if i == j - 1 else None)
                if piece is not None:
                    spans[j].append((i, piece, p[piece] * back))
                    total += p[piece] * back
            ratio[j] = total
        cut = np.zeros(n + 1)
        cut[n] = count
        for j in range(n, 0, -1):
            for i, piece, share in spans[j]:
                flow = share / ratio[j] * cut[j]
                out[piece] += flow
                cut[i] += flow

    def expected(self, words: list[str], counts: np.ndarray, language: int) -> np.ndarray:
        """Expected number of each piece in the counted words of one language."""
        out = np.zeros(len(self.p))
        p = self.p[:, language]
        for n, part in self.groups(words):
            if n > LONG:
                for k in part:
                    self.long_expected(words[k], float(counts[k]), p, out)
                continue
            some = [words[k] for k in part]
            found = self.found(some, n)
            alpha = self.forward(found, p, len(some), n)
            beta = np.zeros_like(alpha)
            beta[n] = counts[part] / alpha[n]
            for i, j, at, ids in reversed(found):
                flow = p[ids] * beta[j, at]
                beta[i, at] += flow
                out += np.bincount(ids, alpha[i, at] * flow, len(out))
        return out


def _equal(pieces: int, languages: int) -> np.ndarray:
    return np.full((pieces + 1, languages), 1.0 / (pieces + 1))


def learned(docs: DataFrame, pieces: list[str], usable: Column, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> dict:
    """Languages and piece probabilities from the rows of ``docs`` (doc_id, text, lang) where ``usable`` holds.

    ``sample_docs`` bounds the fit: of n labelled documents of a language a fraction sample_docs / n is taken,
    by a hash of the id. Piece counts come from every word of every document taken.
    """
    spark = docs.sparkSession
    labelled = docs.select("doc_id", "text", "lang").filter(usable).filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    pattern = run_pattern()
    content = {"languages": languages, "pieces": pieces, "p": _equal(len(pieces), len(languages)), "runs": pattern}
    if not languages:
        return content
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(frames):
        runs = re.compile(pattern)
        for frame in frames:
            found: dict[str, Counter] = {}
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                found.setdefault(lang, Counter()).update(letter_runs(text, runs))
            rows = [(lang, MARK + w, n) for lang, words in found.items() for w, n in words.items()]
            yield pd.DataFrame(rows, columns=["lang", "word", "n"])

    counted = drawn.select("text", "lang").mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words, _ = written(counted, "words")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(content)

        def expect(frames, sent=sent):
            content = sent.value
            lattice = Lattice(content["pieces"], content["p"])
            total: dict[int, np.ndarray] = {}
            for frame in frames:
                for lang, part in frame.groupby("lang"):
                    k = content["languages"].index(lang)
                    total[k] = total.get(k, 0) + lattice.expected(part["word"].tolist(), part["n"].to_numpy(float), k)
            for k, found in total.items():
                at = np.flatnonzero(found)
                yield pd.DataFrame({"k": k, "piece": at, "c": found[at]})

        rows = words.mapInPandas(expect, "k int, piece int, c double").groupBy("k", "piece").agg(F.sum("c").alias("c")).toPandas()
        p = np.full(content["p"].shape, smoothing)
        p[rows["piece"], rows["k"]] += rows["c"]
        content = content | {"p": p / p.sum(axis=0)}
    return content


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        held = sent.value
        if "lattice" not in held:  # a worker keeps it, with the words it remembers, for its later tasks
            held |= {"lattice": Lattice(held["pieces"], held["p"]), "compiled": re.compile(held["runs"]), "younger": Places(len(held["languages"])), "older": Places(len(held["languages"]))}
        return lambda batch: dict(zip(("lang_pred", "score"), _judged(batch.column("text").to_pylist(), held), strict=True))

    return extended(docs, "text", "lang_pred string, score double", work)


class Places(dict):
    """The matrix row of each word; a word not seen yet gets the next one and is noted in ``fresh``."""

    def __init__(self, languages: int):
        super().__init__()
        self.fresh: list[str] = []
        self.matrix = np.zeros((0, languages))

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.fresh.append(word)
        return place


def _judged(texts: list[str | None], held: dict) -> tuple[list[str], list[float]]:
    languages = held["languages"]
    if len(held["younger"]) > REMEMBERED:
        held["older"], held["younger"] = held["younger"], Places(len(languages))
    row: Places = held["younger"]
    words = [np.array(list(map(row.__getitem__, letter_runs(t or "", held["compiled"]))), np.int64) for t in texts]
    if row.fresh:
        _remember(row, held["older"], held["lattice"])
    matrix, names, scores = row.matrix, [], []
    for places in words:
        if not len(places) or not languages:
            names.append("und")
            scores.append(0.0)
            continue
        logs = matrix[places].sum(axis=0)
        k = int(np.argmax(logs))
        names.append(languages[k])
        scores.append(min(1.0, 1.0 / float(np.exp(np.maximum(logs - logs[k], -700)).sum())))
    return names, scores


def _remember(row: Places, older: Places, lattice: Lattice) -> None:
    """Likelihoods of the fresh words: those of the older generation, or new ones."""
    fresh, used = row.fresh, len(row) - len(row.fresh)
    row.fresh = []
    values = np.zeros((len(fresh), row.matrix.shape[1]))
    at = np.array([older.get(w, -1) for w in fresh])
    values[at >= 0] = older.matrix[at[at >= 0]]
    new = np.flatnonzero(at < 0)
    values[new] = lattice.scores([MARK + fresh[k] for k in new.tolist()])
    if len(row) > len(row.matrix):
        grown = np.zeros((max(2 * len(row.matrix), len(row), 1 << 16), values.shape[1]))
        grown[:used] = row.matrix[:used]
        row.matrix = grown
    row.matrix[used : used + len(fresh)] = values
