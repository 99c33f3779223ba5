"""Quotation linking against a linker written out message by message, on generated conversations."""

import hashlib
import random

import pytest

pytest.importorskip("cohortlab.llm")
import regex

from cohortlab.llm import quotes, store

SHAPE = "conv_id bigint, turn bigint, role string, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def written_text(draw):
    """One to three paragraphs of one to three lines of one or two short sentences, few enough words that pieces recur."""
    sentence = lambda: " ".join(draw.choices(WORDS, k=draw.randint(1, 3))).capitalize() + draw.choice([".", "!", "?"])
    line = lambda: " ".join(sentence() for _ in range(draw.randint(1, 2)))
    return "\n\n".join("\n".join(line() for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(1, 3)))


def quoted(draw, text):
    """A quote of a whole message or of some of its paragraphs, lines or sentences, perhaps in other case."""
    parts = draw.choice([[text], text.split("\n\n"), text.split("\n"), regex.split(r"(?<=[.!?])\s+", text)])
    kept = [p for p in parts if draw.random() < 0.7] or parts[:1]
    body = draw.choice(["\n", "\n\n", " "]).join(kept)
    return "\n".join("> " + x if not x.startswith(">") else ">" + x for x in (body.upper() if draw.random() < 0.2 else body).split("\n"))


def conversations(seed, number, length):
    draw = random.Random(seed)
    rows, every = [], []
    for c in range(number):
        own = []
        for t in range(draw.randint(1, length)):
            pieces = []
            for _ in range(draw.choice([0, 1, 1, 2])):
                source = draw.choice(own or every or ["nothing said yet"]) if draw.random() < 0.9 or not every else draw.choice(every)
                head = draw.choice(["", "", "Ann wrote:\n"])
                pieces += [head + quoted(draw, source), written_text(draw)] if draw.random() < 0.7 else [written_text(draw), quoted(draw, source)]
            text = "\n".join(pieces) if pieces else written_text(draw)
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice([text] * 20 + [None, ""])))
            own.append(text)
            every.append(text)
    return rows


QUOTED_LINES = regex.compile(r"(?m)^(?:[^\n>]*\bwrote:[ \t]*\r?\n(?=[ \t]*>))|^[ \t]*>[^\n]*(?:\n|\Z)")
SENTENCES = r"(?<=[.!?][\"')\]]{0,2})\s+"


def plain(text):
    return regex.sub(r"\s+", " ", text.lower()).strip(" ")


def parts_of(text):
    paragraphs = regex.split(r"\n\s*\n", text)
    return paragraphs, text.split("\n"), [s for p in paragraphs for s in regex.split(SENTENCES, regex.sub(r"\s+", " ", p).strip(" "))]


def linked(rows):
    """(conv, turn) -> parent, by the rules of the module's docstring."""
    large, small = {}, {}
    for c, t, _, text in rows:
        if text is None:
            continue
        has = regex.search(r"(?m)^[ \t]*>", text)
        own = QUOTED_LINES.sub("", text).strip(" ") if has else text
        runs = QUOTED_LINES.split(text) if has else [text]
        big = {plain(x) for x in [own, *regex.split(r"\n\s*\n", own), *runs, *(p for r in runs for p in parts_of(r)[0])]} - {""}
        few = {plain(x) for r in runs for k in (1, 2) for x in parts_of(r)[k]} - {""} - big
        for x in big:
            large.setdefault(x, []).append((c, t))
        for x in few:
            small.setdefault(x, []).append((c, t))

    def original(x, c, t):
        sure, every = sorted(large.get(x, [])), sorted(large.get(x, []) + small.get(x, []))
        for found in (sure, every):  # the earliest of the conversation, if before the turn
            here = [m for m in found if m[0] == c]
            if here and here[0][1] < t:
                return here[0]
        for found in (sure, every):
            if found and found[0][0] < c:
                return found[0]
        return None

    parents = {}
    for c, t, _, text in rows:
        if text is None or not regex.search(r"(?m)^[ \t]*>", text):
            continue
        passages, before = [], 0
        for at, line in enumerate(text.split("\n")):
            m = regex.match(r"[ \t]*((?:>[ \t]?)+)", line)
            level = m[1].count(">") if m else 0
            if level and level == before:
                passages[-1][2].append(line[m.end() :])
            elif level:
                passages.append((level, at, [line[m.end() :]]))
            before = level
        chars, first = {}, {}
        for level, at, lines in passages:
            body = "\n".join(lines)
            if not plain(body):
                continue
            for grain, some in enumerate([[body], *(p if len(p) > 1 else [] for p in parts_of(body))]):
                for pos, x in enumerate(some):
                    found = original(plain(x), c, t) if plain(x) else None
                    if found and found != (c, t):
                        k = (level, grain, at, found)
                        chars[k] = chars.get(k, 0) + len(plain(x))
                        first.setdefault(k, pos)
        if chars:
            shallow = min(k[0] for k in chars)
            coarse = min(k[1] for k in chars if k[0] == shallow)
            early = min(k[2] for k in chars if k[:2] == (shallow, coarse))
            parents[c, t] = min((k for k in chars if k[:3] == (shallow, coarse, early)), key=lambda k: (-chars[k], first[k], hashlib.md5(str(k).encode()).hexdigest()))[3]
    return parents


@pytest.mark.parametrize("seed, broadcast", [(1, True), (2, False), (3, True)])
def test_links_by_force(spark, monkeypatch, seed, broadcast):
    if not broadcast:
        monkeypatch.setattr(store, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(store, "measured", lambda df, *wide, **options: df)
    rows = conversations(seed, 60, 9)
    assert sum("> " in (r[3] or "") for r in rows) > 100
    want = linked(rows)
    assert len(want) > 80
    got = {(r["conv_id"], r["turn"]): r for r in quotes.reply_ordered(spark.createDataFrame(rows, SHAPE)).collect()}
    assert len(got) == len(rows)
    assert {k: (r["parent_conv"], r["parent_turn"]) for k, r in got.items() if r["parent_conv"] is not None} == want
    for key, r in got.items():
        depth, at = 0, key
        while at in want:
            at, depth = want[at], depth + 1
        assert (r["thread_conv"], r["thread_turn"], r["depth"]) == (*at, depth)
        text = next(x[3] for x in rows if x[:2] == key)
        own = "" if text is None else QUOTED_LINES.sub("", text).strip(" ") if regex.search(r"(?m)^[ \t]*>", text) else text
        assert r["own_text"] == own and ">" not in r["own_text"]
