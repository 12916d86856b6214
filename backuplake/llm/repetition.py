"""Repetition coverage: how many characters of a text lie inside repeated n-grams and repeated lines.

Words are runs of anything but the six ASCII space characters. Many texts are measured at once in numpy:
each word is a random 64-bit value, the hash of an n-gram is rolled on from that of the (n-1)-gram before
it (a longer window can only repeat where a shorter one does), equal hashes of one text come together in a
sort, and equality is then verified word by word (should two different n-grams meet under one hash, the
batch is sorted by its words instead). So counts are exact.
A character counts as covered by length n if its word lies in a window of n words that an earlier window
of the same text equals; as covered by lines if its line equals an earlier one. The text is kept if no
length covers more than its share of the characters in words, nor the lines more than theirs.

`measure` gives one row per row of `docs`, whatever its id: null and empty texts, and texts of white space
alone, have no words, and fail the base rule of 50 words. Texts of any length are taken whole; a batch
is cut by words, so memory follows the longest single text. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from backuplake.llm.words import STEP, mixed

#: Most percent of word characters that repeated windows of so many words may cover.
GRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: The same for repeated lines.
LINE_LIMIT = 20
#: Words in one numpy batch, about.
BATCH_WORDS = 500_000
MIN_WORDS = 50
BASE_GRAM = 3

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_ROLL = np.uint64(0xD6E8FEB86659FD93)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def word_lengths(words: list[bytes]) -> np.ndarray:
    """Code points of each word."""
    if not words:
        return np.zeros(0, np.int64)
    begun = np.cumsum((np.frombuffer(b"".join(words), np.uint8) & 0xC0) != 0x80)
    return np.diff(begun[np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - 1], prepend=0)


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the characters in their words."""
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    if len(set(lines)) == len(lines):
        return 0, 0
    seen: set[bytes] = set()
    count = chars = 0
    for line in lines:
        if line in seen:
            count, chars = count + 1, chars + code_points(line.translate(None, _SPACE))
        seen.add(line)
    return count, chars


class Windows:
    """Repeated windows of the texts of one batch; ask for lengths in ascending order."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray):
        self.codes, self.owner = codes, owner
        # Texts share no hash: each has its own value added.
        self.word = mixed(codes.astype(np.uint64) * STEP + np.uint64(1))
        self.text = mixed(owner.astype(np.uint64) * STEP + np.uint64(2))
        self.rolled, self.n = self.word.copy(), 1
        #: Starts of the windows of the last length that equal another: longer ones start nowhere else.
        self.twins = np.arange(len(codes))

    def roll(self, n: int) -> np.ndarray:
        """Hashes of all windows of n words, from those of fewer."""
        while self.n < n:
            self.rolled = self.rolled[:-1] * _ROLL + self.word[self.n :]
            self.n += 1
        return self.rolled

    def repeats(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows that equal an earlier one, and of all windows that equal another."""
        at = self.twins[self.twins <= len(self.codes) - n]
        at = at[self.owner[at] == self.owner[at + n - 1]]
        if len(at) < 2:
            self.twins = at[:0]
            return self.twins, self.twins
        hashes = mixed(self.roll(n)[at]) + self.text[at]
        ranked = np.sort(hashes)
        double = ranked[1:][ranked[1:] == ranked[:-1]]
        if not len(double):
            self.twins = at[:0]
            return self.twins, self.twins
        place = np.minimum(np.searchsorted(double, hashes), len(double) - 1)
        at, hashes = at[double[place] == hashes], hashes[double[place] == hashes]
        at = at[np.argsort(hashes, kind="stable")]
        alike = self.equal(at, n)
        if not (alike == (np.diff(np.sort(hashes)) == 0)).all():
            # Two different windows under one hash: sort by the words themselves.
            at = at[np.lexsort([at, *[self.codes[at + i] for i in range(n)], self.owner[at]])]
            alike = self.equal(at, n)
        later = at[1:][alike]
        first = at[:-1][alike & ~np.concatenate([[False], alike[:-1]])]
        self.twins = np.sort(np.concatenate([first, later]))
        return later, self.twins

    def equal(self, at: np.ndarray, n: int) -> np.ndarray:
        """Which windows have the words and the text of the one listed before."""
        same = self.owner[at[1:]] == self.owner[at[:-1]]
        for i in range(n):
            same &= self.codes[at[1:] + i] == self.codes[at[:-1] + i]
        return same

    def covered(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Which words lie in one of the windows."""
        edges = np.zeros(len(self.codes) + 1, np.int32)
        edges[starts] += 1
        edges[starts + n] -= 1
        return np.cumsum(edges[:-1]) > 0


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base counts of each text, `line_chars`, and `chars_n` for each length of n-grams."""
    words: list[bytes] = []
    ends, lines = [], []
    for text in texts:
        words += text.split()
        ends.append(len(words))
        lines.append(repeated_lines(text))
    count = np.diff(np.array([0, *ends], np.int64))
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    chars = word_lengths(list(known))[codes]
    owner = np.repeat(np.arange(len(texts)), count)
    windows = Windows(codes, owner)

    def per_text(which: np.ndarray, value: np.ndarray | None = None) -> np.ndarray:
        sums = np.bincount(owner[which], None if value is None else value[which].astype(np.float64), minlength=len(texts))
        return sums.astype(np.int64)

    out = {
        "n_words": count,
        "word_chars": per_text(np.ones(len(codes), bool), chars),
        "n_symbols": np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([n for n, _ in lines], np.int64),
        "n_repeat_words": per_text(windows.covered(windows.repeats(BASE_GRAM)[1], BASE_GRAM)),
        "line_chars": np.array([c for _, c in lines], np.int64),
    }
    for n in sorted(GRAM_LIMITS):
        out[f"chars_{n}"] = per_text(windows.covered(windows.repeats(n)[0], n), chars)
    out["base_failed"] = (count < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * count)
    kept = ~out["base_failed"] & (100 * out["line_chars"] <= LINE_LIMIT * out["word_chars"])
    for n, limit in GRAM_LIMITS.items():
        kept &= 100 * out[f"chars_{n}"] <= limit * out["word_chars"]
    out["kept"] = kept
    return out


def _cut(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about `BATCH_WORDS` words together; a longer text stands alone."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text) // 5
        if size > BATCH_WORDS and i > begin:
            yield slice(begin, i)
            begin, size = i, len(text) // 5
    if begin < len(texts):
        yield slice(begin, len(texts))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, line_chars, chars_n, base_failed and kept of every row."""
    from backuplake.llm.bpe import _arrow

    kind = docs.schema["doc_id"].dataType
    counts = [*COUNTS, "line_chars", *[f"chars_{n}" for n in sorted(GRAM_LIMITS)]]
    flags = ["base_failed", "kept"]
    schema = pa.schema(
        [("doc_id", _arrow(kind)), *[(c, pa.int64()) for c in counts], *[(f, pa.bool_()) for f in flags]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for part in _cut(texts):
                found = measures(texts[part])
                ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
                arrays = [ids, *[pa.array(found[c]) for c in counts + flags]]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    ddl = ", ".join([f"doc_id {kind.simpleString()}", *[f"{c} long" for c in counts], *[f"{f} boolean" for f in flags]])
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def oracle() -> str:
    """The same measures in SQL."""
    leads = ", ".join(f"lead(word, {i}) OVER o AS w{i}" for i in range(1, max(GRAM_LIMITS)))
    grams = " UNION ALL ".join(
        f"SELECT r, {n} AS n, {limit} AS lim, i, concat_ws(' ', word, {', '.join(f'w{i}' for i in range(1, n))}) AS gram FROM e WHERE w{n - 1} IS NOT NULL"
        for n, limit in [(BASE_GRAM, 100), *GRAM_LIMITS.items()]
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
     s AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
     e AS (SELECT *, {leads} FROM s WINDOW o AS (PARTITION BY r ORDER BY i)),
     g AS ({grams}),
     t AS (SELECT r, n, lim, list(i) AS starts, min(i) AS first FROM g GROUP BY r, n, lim, gram HAVING count(*) > 1),
     k AS (SELECT r, n, lim, first, unnest(starts) AS i FROM t),
     p AS (SELECT r, n, lim, unnest(range(i, i + n)) AS i FROM k WHERE n = {BASE_GRAM} OR i > first),
     c AS (SELECT r, n, lim, count(*) AS covered, sum(length(word)) AS chars
           FROM (SELECT DISTINCT * FROM p) JOIN s USING (r, i) GROUP BY r, n, lim),
     l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY j) > 1 AS again
           FROM (SELECT r, unnest(x) AS line, unnest(range(len(x))) AS j FROM (SELECT r, string_split(t, chr(10)) AS x FROM w))
           WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
     q AS (SELECT r, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM l WHERE again GROUP BY r),
     a AS (SELECT w.r, any_value(doc_id) AS doc_id, any_value(len(ws)) AS n_words,
                  any_value(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))) AS word_chars,
                  any_value(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) AS n_symbols,
                  any_value(coalesce(q.n, 0)) AS n_dup_lines, any_value(coalesce(q.chars, 0)) AS line_chars,
                  coalesce(max(covered) FILTER (c.n = {BASE_GRAM}), 0) AS n_repeat_words,
                  coalesce(bool_or(100 * c.chars > lim * length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))) FILTER (c.n <> {BASE_GRAM}), false) AS over
           FROM w LEFT JOIN q ON q.r = w.r LEFT JOIN c ON c.r = w.r GROUP BY w.r),
     b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT over AND 100 * line_chars <= {LINE_LIMIT} * word_chars AS kept FROM b
"""
