"""Repetition coverage against a plain count, and on odd rows."""

import random
import re

import numpy as np
import pytest

from backuplake.llm import repetition as rep

SCHEMA = "doc_id long, text string, n_words string, kept array<int>, _n int"


def plain(text):
    """The same measures, window by window."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    chars = sum(map(len, words))

    def windows(n):
        where = {}
        for i in range(len(words) - n + 1):
            where.setdefault(tuple(words[i : i + n]), []).append(i)
        return where

    both = {j for at in windows(3).values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    seen, lines, line_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own and line in seen:
            lines, line_chars = lines + 1, line_chars + sum(map(len, own))
        seen.add(line)
    failed = len(words) < 50 or 100 * len(both) > 50 * len(words)
    kept = not failed and 100 * line_chars <= 20 * chars
    for n, limit in rep.GRAM_LIMITS.items():
        again = {j for at in windows(n).values() for i in at[1:] for j in range(i, i + n)}
        kept = kept and 100 * sum(len(words[j]) for j in again) <= limit * chars
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), chars, symbols, lines, len(both), failed, kept


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t\x0b", "a", "a a a", " x y \x1fz", "# $ | <>&*%", "x\n" * 100, "é ü 中文 " * 30, "w " * 20_000]
    for size in (2, 5, 40, 400):
        for _ in range(12):
            words = [rng.choice("abcdefghij") + str(rng.randrange(size)) for _ in range(rng.randrange(1, 400))]
            out.append("".join(w + rng.choice([" ", " ", "\n", "\r\n", " | "]) for w in words))
    block = " ".join(f"w{i}" for i in range(40))
    return out + [block + "\n" + " ".join(f"v{i}" for i in range(n)) + "\n" + block for n in (10, 100, 300, 1000)]


def as_row(found, i):
    return tuple(found[c][i].item() for c in [*rep.COUNTS, "base_failed", "kept"])


@pytest.mark.parametrize("batch", [1, 300, 500_000])
def test_measures_equal_a_plain_count(batch, monkeypatch):
    monkeypatch.setattr(rep, "BATCH_WORDS", batch)
    data = [(t or "").encode() for t in texts()]
    got = [row for part in rep._cut(data) for f in [rep.measures(data[part])] for row in [as_row(f, i) for i in range(len(f["kept"]))]]
    want = [plain(t) for t in texts()]
    assert got == want
    assert {w[-1] for w in want} == {True, False}
    assert any(not w[-2] and not w[-1] for w in want)


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(rep, "mixed", lambda x: x * np.uint64(0) + np.uint64(7))
    data = [(t or "").encode() for t in texts()]
    found = rep.measures(data)
    assert [as_row(found, i) for i in range(len(data))] == [plain(t) for t in texts()]


def test_rows_of_any_kind(spark):
    rows = [(i, t, "n", [1], 1) for i, t in enumerate(texts())] + [(None, "one two", "n", None, 1), (3, "a", "n", [1], 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, rep.measure(docs).select("doc_id", *rep.COUNTS, "base_failed", "kept").collect()), key=str)
    assert got == sorted(((r[0], *plain(r[1])) for r in rows), key=str)
    assert rep.measure(docs.limit(0)).count() == 0
