"""The tables of known units, and the encoding of whole columns."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from backuplake.llm import bpe, token_files
from backuplake.llm.tokens import Encoder

PATHS = [public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")]
EDGES = [
    None, "", " ", "\n", "a", " a", "\na", "a ", "a\n", "a b\nc", "\n a", "a  b", "a\n\nb", "a\tb", "a\t\tb", "a\xa0\xa0b", "\xa0 b",
    "　　", "<|endoftext|> x", "a\x1cb", "\0", "\0a b", "it's, 'll.", "wörd, é. 中文 🙂!", "é, x", "x" * 5000 + " y",
]


def texts(seed: int, rows: int) -> list[str | None]:
    rng = random.Random(seed)
    words = ["ab", "Cd,", "ä.", "ß", "中", "7", "don't", "x" * 300, "🙂", "..", "é"]
    some = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n"]) for _ in range(rng.randrange(20))) for _ in range(rows)]
    return [*EDGES, *some, *EDGES]


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("known", [2000, 10_000_000])
def test_column_gives_the_ids_of_the_library(path, known, monkeypatch):
    monkeypatch.setattr("backuplake.llm.tokens.KNOWN_BYTES", known)
    coder = Encoder(path, bpe.Tree)
    for rows in (texts(1, 200), texts(2, 200), EDGES[9:10], ["a  b", "\0"], []):
        ids, sizes = coder.column(pa.array(["cut off", *rows], pa.string()).slice(1))
        want = [coder.whole.encode(t or "", add_special_tokens=False).ids for t in rows]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("path", PATHS)
def test_units_in_use_stay_known_when_the_table_is_full(path, monkeypatch):
    """Words that every text holds are encoded once, however many others come by."""
    monkeypatch.setattr("backuplake.llm.tokens.KNOWN_BYTES", 100_000)
    coder, asked = Encoder(path, bpe.Tree), []
    fresh = coder._fresh
    monkeypatch.setattr(coder, "_fresh", lambda letters: asked.append(letters) or fresh(letters))
    rng = random.Random(4)
    often = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(50)]
    for _ in range(100):
        coder.encode([" ".join([*often, *("".join(rng.choices("ijklmnop", k=9)) for _ in range(50))])])
    assert len(asked) < 50 * 100 + 100
    assert (len(coder.units) + len(coder.older)) * 200 < 150_000


def test_parts_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(token_files, "PART", 100)
    rows = ["x" * 250, None, "", "a" * 30, "b" * 80, "é" * 40, None, "y" * 1000, "z"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(rows))), "text": rows})
    parts = list(token_files._parts(batch))
    assert [t for p in parts for t in p.column("text").to_pylist()] == rows
    assert [t for p in parts for t in p.column("doc_id").to_pylist()] == list(range(len(rows)))
    assert 3 < len(parts) < len(rows) and all(p.num_rows for p in parts)
    assert list(token_files._parts(batch.slice(0, 0))) == []


def test_files_of_parts_are_read_back(tmp_path):
    """What a task writes: rows that follow each other over parts, each with its end id."""
    coder, rows = Encoder(PATHS[1]), texts(3, 50)
    out, at = token_files.Writer(str(tmp_path), coder.dtype, 16), 0
    places = []
    for k in range(0, len(rows), 7):
        ids, sizes = coder.column(pa.array(rows[k : k + 7], pa.string()))
        ends = np.cumsum(sizes)
        start = out.add(np.insert(ids, ends, 0))
        places += list(zip((start + ends - sizes + np.arange(len(sizes))).tolist(), (sizes + 1).tolist()))
    out.close()
    reader = token_files.Reader(str(tmp_path), out.name)
    for text, (position, n) in zip(rows, places, strict=True):
        want = coder.whole.encode(text or "", add_special_tokens=False).ids + [0]
        assert position == at and n == len(want) and reader.ids(position, n).tolist() == want
        at += n


def test_every_kind_of_white_space_between_words():
    """Runs of white space in all places, with words of one letter between them."""
    rng, coder = random.Random(6), Encoder(PATHS[1])
    parts = [" ", " ", " ", "\n", "\n", "\t", "\r", "\xa0", "\u3000", "\u2003", "a", "b", "é", "7", ".", "'s", "word", "中"]
    rows = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(20_000)]
    ids, sizes = coder.column(pa.array(rows, pa.string()))
    want = [e.ids for e in coder.whole.encode_batch(rows, add_special_tokens=False)]
    got = [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])]
    assert [r for r, g, w in zip(rows, got, want) if g != w] == []


def test_texts_with_blank_lines_share_their_units(monkeypatch):
    """Words beside blank lines are the words they are elsewhere: no text is taken apart by itself."""
    coder = Encoder(PATHS[1])
    monkeypatch.setattr(coder, "encode", None)
    rows = [f"one{a} two\n\none{b} two\n\n\n  one{a} end" for a in "abcdefgh" for b in "abcdefgh"]
    ids, sizes = coder.column(pa.array(rows, pa.string()))
    assert ids.tolist() == [i for t in rows for i in coder.whole.encode(t, add_special_tokens=False).ids]
    assert len(coder.units) < 40


@pytest.mark.parametrize("path", PATHS)
def test_a_long_word_with_and_without_a_mark(path):
    """Neither is remembered; the one with the mark came first."""
    coder, text = Encoder(path, bpe.Tree), "x" * 300 + ", " + "x" * 300
    (data,) = coder.encode([text])
    assert coder.ids(data).tolist() == coder.whole.encode(text, add_special_tokens=False).ids
