"""BPE encoding and decoding with a public vocabulary file.

Text is cut at the file's added tokens, then at white space. In each part, after canonical
composition and lower-casing, the words are contractions, letter runs, single digits and runs of other
characters. A word's bytes are symbols in a doubly linked list, the last one marked as a
word's end. A priority queue holds (rank, place) of adjacent pairs that can merge; the best is taken, entries
whose symbols have changed since are skipped, and the two new pairs around the merged symbol are pushed.
Decoding joins the vocabulary strings of the ids, with a space between them as the file names no decoder.

A worker remembers the ids of a word (for digests also as text and decoded) in two generations of at most ``REMEMBERED`` words: a word found in the older one moves to the
younger, and when that is full it becomes the older one, so words in use stay.

Null texts are empty. Every input row gives one row, repeated rows equal ones. Texts and words of any length are read whole: a word of n
bytes takes n steps of the queue. Equal ranks are merged from left to right. An empty table gives no rows. Columns of the input
named as an added one are replaced, others are kept.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame, functions as F

from cohortlab.llm.batches import extended

REMEMBERED = 150_000
SHIFT = 32
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
#: White space as Unicode defines it, which leaves out 0x1C-0x1F.
BLANK = "\t\n\v\f\r \x85\xa0  -     　"

# fixed values: letters and numbers that Unicode 16 has beyond Python's tables, and lower-case forms beyond them as (first, last, step)
NEWER = {
    "L": [
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
        (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
        (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}
LOWER = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
]


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next free one from U+0100."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printed else chr(next(spare)) for b in range(256)]


def character_class(kind: str) -> str:
    """Ranges of all code points whose category begins with ``kind``, for use inside brackets."""
    ranges, start = list(NEWER[kind]), None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            ranges.append((start, c - 1))
            start = None
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


def read_vocabulary(path: str) -> dict:
    """Plain values from a vocabulary file, to be sent to tasks: ids by string, merge pairs in rank order, added tokens."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    return {
        "vocab": model["vocab"], "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
        "end": model["end_of_word_suffix"] or "", "added": {t["content"]: t["id"] for t in content["added_tokens"]},
    }


class Remembered(dict):
    """What is found for a word, its ids for one, when it is first asked for."""

    def __init__(self, find, size: int = REMEMBERED):
        super().__init__()
        self.find, self.size, self.older = find, size, {}

    def __missing__(self, word: str) -> tuple:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self.find(word)
        self[word] = ids
        return ids


class Coder:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, content: dict):
        vocab, self.end = content["vocab"], content["end"]
        self.made = [vocab[a + b] for a, b in content["merges"]]
        # ranks by pair, the first id shifted by SHIFT bits
        self.ranks = {vocab[a] << SHIFT | vocab[b]: rank for rank, (a, b) in enumerate(content["merges"])}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.end] for s in symbols]
        self.added = content["added"]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.strings = {i: s for s, i in [*vocab.items(), *self.added.items()]}
        self.digits = {i: str(i) for i in self.strings}
        letters, numbers = character_class("L"), character_class("N")
        self.words = re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{BLANK}{letters}{numbers}]+")
        self.plain_words = re.compile(f"{CONTRACTIONS}|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+")  # the same for lower-case ASCII
        self.lower = {c: c + step for first, last, step in LOWER for c in range(first, last + 1)}
        self.rare = re.compile("[" + "".join(map(chr, self.lower)) + "]")
        self.known, self.said = Remembered(self.merged), Remembered(self.written)

    def merged(self, word: str) -> tuple[int, ...]:
        """Ids of one word, by the queue of merge ranks over linked symbols."""
        data = word.encode()
        n = len(data)
        inner, rank_of, made = self.inner, self.ranks.get, self.made
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        # the rank of the pair that starts at each place, -1 where none does; an entry of the queue is rank and place in one number
        ranks = [rank_of(a << SHIFT | b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        ranks.append(-1)
        bits = n.bit_length()
        place = (1 << bits) - 1
        queue = [r << bits | i for i, r in enumerate(ranks) if r >= 0]
        heapify(queue)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heappop(queue)
            i = entry & place
            rank = entry >> bits
            if ranks[i] != rank:
                continue  # stale: one of the two symbols has been merged since
            j = right[i]
            ids[i] = whole = made[rank]
            ids[j] = ranks[j] = -1
            right[i] = k = right[j]
            ranks[i] = -1
            if k < n:
                left[k] = i
                if (rank := rank_of(whole << SHIFT | ids[k])) is not None:
                    ranks[i] = rank
                    heappush(queue, rank << bits | i)
            h = left[i]
            if h >= 0:
                if (rank := rank_of(ids[h] << SHIFT | whole)) is not None:
                    ranks[h] = rank
                    heappush(queue, rank << bits | h)
                else:
                    ranks[h] = -1
        return tuple([i for i in ids if i >= 0])

    def split(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        if text.isascii():
            return self.plain_words.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if self.rare.search(text):
            text = text.translate(self.lower)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # no final form of sigma
        return self.words.findall(text)

    def plain(self, text: str) -> Iterable[int]:
        """Ids of a text without added tokens."""
        return chain.from_iterable(map(self.known.__getitem__, self.split(text)))

    def written(self, word: str) -> tuple[int, str, str]:
        """How many ids a word has, the ids as text and the word decoded from them."""
        ids = self.merged(word)
        return len(ids), " ".join(map(self.digits.__getitem__, ids)), self.decode(ids)

    def digests(self, text: str) -> tuple[int, str, str]:
        """How many ids a text has, and digests of its ids and of the text decoded from them: joined by words, as both are joined by spaces."""
        if self.cut is None or not any(t in text for t in self.added):
            said = list(map(self.said.__getitem__, self.split(text)))
        else:
            said = []
            for part in self.cut.split(text):
                if part in self.added:
                    i = self.added[part]
                    said.append((1, self.digits[i], self.strings[i]))
                else:
                    said += map(self.said.__getitem__, self.split(part))
        return (
            sum([w[0] for w in said]), hashlib.sha256(" ".join([w[1] for w in said]).encode()).hexdigest(),
            hashlib.sha256(" ".join([w[2] for w in said]).encode()).hexdigest(),
        )

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(t in text for t in self.added):
            return list(self.plain(text))
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(self.added[part])
            else:
                out += self.plain(part)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


def _coder(content: dict) -> Coder:
    """The coder of a broadcast vocabulary: a Python worker keeps it, with what it remembers, for its later tasks."""
    if "coder" not in content:
        content["coder"] = Coder(content)
    return content["coder"]


def encoded(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """``docs`` with n_tokens and ids, or with n_tokens, ids_sha256 and decoded_sha256 if ``digests``.

    ``vocabulary`` is a path that the driver reads; its content, of the fixed size of a public file, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def work():
        coder = _coder(sent.value)

        def step(batch):
            out: dict[str, list] = {"n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch.column("text").to_pylist():
                if digests:
                    n, of_ids, of_text = coder.digests(text or "")
                    out["n_tokens"].append(n)
                    out["ids_sha256"].append(of_ids)
                    out["decoded_sha256"].append(of_text)
                else:
                    ids = coder.encode(text or "")
                    out["n_tokens"].append(len(ids))
                    out["ids"].append(ids)
            return out

        return step

    return extended(docs, "text", "n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"), work)


def decoded(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``tokens`` (ids) with the text that its ids stand for, as ``decoded``. Null ids decode to the empty string."""
    sent = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def work():
        coder = _coder(sent.value)
        return lambda batch: {"decoded": [coder.decode(ids or ()) for ids in batch.column("ids").to_pylist()]}

    sized = tokens.withColumn("__size", F.lit(""))
    return extended(sized, "__size", "decoded string", work).drop("__size")
