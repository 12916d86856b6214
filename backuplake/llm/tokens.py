"""Encoding with public tokenizer files, a unit at a time.

A unit is a stretch of text whose ids do not depend on what stands around it: a run between white
space, or a run with the one space before it. The tokenizers library encodes each new unit; repeated
units come from a bounded table per worker, which forgets the units not met for longest. Files with
other pre-tokenizers, texts with special tokens or control separators go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of units and pieces remembered per worker, about, and what an entry takes beside its text and ids. Of units
#: there are two tables of half of it: when the newer is full, it becomes the older, and what that held is forgotten.
KNOWN_BYTES, ENTRY_BYTES = 240_000_000, 200
#: Longer units and pieces are not remembered.
LONGEST = 256

#: Fixed value: the pre-tokenizer pattern of byte-level BPE files that set `use_regex`.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PLAIN = regex.compile(r"[\x20-\x7e\n\t\r\xa1-ɏ‐-‧]*")
#: Marks that stand alone after letters, in both patterns.
_STOPS = frozenset(".,;:!?")
#: For Arrow: what the library must see whole, and white space beside white space, as `\s\s` in Python.
_ODD = r"<\||[\x00\x1c-\x1f]"
_SPACE = "".join(rf"\x{{{i:x}}}" for i in range(1 << 16) if chr(i).isspace())
_TWO_SPACES, _END_SPACES = f"[{_SPACE}]{{2}}", f"[{_SPACE}]{{2}}\\z"
#: Of white space before a word, all but the last character is a piece of its own: it becomes a unit marked by `\0`, its
#: spaces `\x1f` (twice, as matches do not overlap), and a line end before a word starts a unit.
_CUTS = [
    (f"([{_SPACE}]+)([{_SPACE}][^{_SPACE}])", " \0\\1\\2"),
    (f" ([{_SPACE}])", "\x1f\\1"),
    (f" ([{_SPACE}])", "\x1f\\1"),
    (f"\n([^{_SPACE}])", " \n\\1"),
]
_INNER = regex.compile(r"(?<=\S)(?= \S)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_letters()


def spelled(piece: str) -> str:
    """A piece's UTF-8 bytes as the letters BPE works on."""
    if piece.isascii() and " " not in piece and piece.isprintable():
        return piece
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LETTERS)


def _marks(texts: Sequence[str]) -> Iterator[tuple[bool, bool]]:
    """Whether each text matches `_ODD`, and whether it matches `_TWO_SPACES`."""
    for at in range(0, len(texts), 1000):
        part = pa.array(texts[at : at + 1000], pa.large_string())
        yield from zip(*(pc.match_substring_regex(part, p).to_numpy(zero_copy_only=False).tolist() for p in (_ODD, _TWO_SPACES)))


class Encoder:
    """Encodes and decodes as the library does with `add_special_tokens=False`.

    `long_pieces`, if given, encodes pieces of more letters than its `longest`.
    """

    def __init__(self, path: str, long_pieces=None):
        from tokenizers import Tokenizer, models

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_words, pattern = self._kind(spec)
        self.pattern = regex.compile(pattern) if pattern else None
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0
        self.no_decoder = spec.get("decoder") is None
        model = spec["model"]
        if self.pattern:
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            suffix = {"end_of_word_suffix": model["end_of_word_suffix"]} if model.get("end_of_word_suffix") else {}
            bare = lambda **k: Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, **k))
            # Pieces come from the tables here, so the library's own cache would only be asked in vain.
            self.bare = bare(cache_capacity=0, **suffix)
            self.model = self.bare.model
            self.long = long_pieces(bare, suffix) if long_pieces else None

    @staticmethod
    def _kind(spec: dict) -> tuple[bool, str | None]:
        """Whether units are words without white space, and the pattern of pieces; no pattern: no units."""
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
        plain = (
            model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "continuing_subword_prefix"))
            and spec.get("post_processor") is None
            and all(not t["normalized"] and t["content"].startswith("<|") for t in spec.get("added_tokens", []))
        )
        if plain and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return False, BYTE_PATTERN
        steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        split = (pre.get("pretokenizers") or [{}])[0]
        if plain and steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert"):
            return True, split["pattern"]["Regex"]
        return False, None

    def _unit(self, key: str) -> bytes:
        """Ids of a unit. Its key is itself without its leading space; those without one are marked."""
        by_words, plain = self.by_words, key.isascii()
        if plain and key.isalpha():
            return self._fresh(key.lower() if by_words else "\u0120" + key)
        unit = key if by_words or key[:1] == "\n" else key[1:] if key[:1] == "\0" else " " + key
        if not (plain or _PLAIN.fullmatch(unit)):
            return self._packed(self.whole.encode(unit, add_special_tokens=False).ids)
        if by_words:
            unit = unit.lower() if plain else unicodedata.normalize("NFC", unit).lower()
        if key[-1:] in _STOPS and key[:-1].isalpha() and unit[:-1].lstrip(" ").isalpha():
            # Letters and one mark (also once lowered): what the pattern finds, without asking it; the letters are a unit of their own.
            known = self.units.get(key[:-1])
            if known is None:
                known = self.older.get(key[:-1])
                known = self.units[key[:-1]] = self._unit(key[:-1]) if known is None else known
            return known + self._piece(key[-1])
        if unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
            return self._fresh(spelled(unit))
        return b"".join([self._piece(spelled(p)) for p in self.pattern.findall(unit)])

    def _add(self, new: Sequence[str]) -> dict[str, bytes]:
        """Ids of new units."""
        if self.held > KNOWN_BYTES // 2:
            self.older, self.units, self.pieces, self.held = self.units, {}, {}, 0
        unit, before = self._unit, len(self.units) + len(self.pieces)
        out = {key: unit(key) if known is None else known for key, known in zip(new, map(self.older.get, new))}
        self.units.update(out)
        # Parts of units are no longer than the units they came from.
        self.held += sum(map(len, out)) + sum(map(len, out.values())) + ENTRY_BYTES * (len(self.units) + len(self.pieces) - before)
        for key in [key for key in new if len(key) > LONGEST]:
            self.units.pop(key, None)
            self.units.pop(key[:-1], None)
        return out

    def _packed(self, ids: Sequence[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _fresh(self, letters: str) -> bytes:
        """Ids of one piece in the model's letters."""
        if self.long and len(letters) > self.long.longest:
            return self._packed(self.long.encode(letters))
        return self._packed([t.id for t in self.model.tokenize(letters)])

    def _piece(self, letters: str) -> bytes:
        """The same, remembered."""
        known = self.pieces.get(letters)
        if known is None:
            known = self._fresh(letters)
            if len(letters) <= LONGEST:
                self.pieces[letters] = known
        return known

    def _keys(self, text: str, spaced: bool) -> list[str]:
        """`spaced`: the text has white space beside white space."""
        if self.by_words:
            return text.split()
        if spaced:
            parts = _INNER.split(text)
            return ["\0" + parts[0], *[p[1:] for p in parts[1:]]]
        first, *rest = text.replace("\n", " \n").split(" ")
        if text[:1] in (" ", "\n"):
            return rest
        return ["\0" + first, *rest]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian ids of each text, as wide as `dtype`."""
        out: list[bytes] = [b""] * len(texts)
        rows, new = [], {}

        def settle() -> None:
            added = self._add(list(new))
            for i, keys, found, holes in rows:
                for h in holes:
                    found[h] = added[keys[h]]
                out[i] = b"".join(found)
            rows.clear()
            new.clear()

        for i, (text, (whole, spaced)) in enumerate(zip(texts, _marks(texts))):
            if whole or not self.pattern:
                out[i] = self._packed(self.whole.encode(text, add_special_tokens=False).ids)
                continue
            keys = self._keys(text, spaced) if text else []
            found = list(map(self.units.get, keys))
            if None not in found:
                out[i] = b"".join(found)
                continue
            holes = [h for h, v in enumerate(found) if v is None]
            new.update(dict.fromkeys([keys[h] for h in holes]))
            rows.append((i, keys, found, holes))
            if len(new) > 20_000:
                settle()
        settle()
        return out

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after the other, and how many each text has; null texts count as empty."""
        texts = pc.fill_null(texts, "")
        if not self.pattern or self.by_words:
            return self._joined(self.encode(texts.to_pylist()))
        apart = pc.or_(pc.match_substring_regex(texts, _ODD), pc.match_substring_regex(texts, _END_SPACES))
        if not pc.any(apart).as_py():
            return self._spaced(texts)
        ids, sizes = self._spaced(texts.filter(pc.invert(apart)))
        plain, rest = iter(np.split(ids, np.cumsum(sizes)[:-1])), iter(self.encode(texts.filter(apart).to_pylist()))
        return self._joined([next(rest) if a else next(plain).tobytes() for a in apart.to_pylist()])

    def _joined(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        return self.ids(b"".join(parts)), sizes

    def _spaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As `column`, for texts without control separators or white space beside white space at the end.

        Each distinct unit is looked up once.
        """
        spaced = pc.any(pc.match_substring_regex(texts, _TWO_SPACES)).as_py()
        if spaced:
            for pattern, put in _CUTS:
                texts = pc.replace_substring_regex(texts, pattern, put)
        else:
            texts = pc.replace_substring(texts, "\n", " \n")
        lists = pc.split_pattern(pc.binary_join_element_wise("\0", texts, ""), " ")
        coded = lists.values.dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if spaced:
            keys = [key.replace("\x1f", " ") for key in keys]
        found = list(map(self.units.get, keys))
        holes = [h for h, v in enumerate(found) if v is None]
        for at in range(0, len(holes), 20_000):
            some = holes[at : at + 20_000]
            for h, v in zip(some, self._add([keys[h] for h in some]).values()):
                found[h] = v
        known, sizes = self._joined(found)
        which = coded.indices.to_numpy()
        each = sizes[which]
        ends = np.append(0, np.cumsum(each))
        # From a place in the result to the place of the same id among those of distinct units.
        shift = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], each)
        shift += np.arange(len(shift))
        return known[shift], np.diff(ends[lists.offsets.to_numpy()])

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.dtype)

    @property
    def names(self) -> list[str | None]:
        """Token strings by id, for files without a decoder."""
        if not hasattr(self, "_names"):
            vocab = self.whole.get_vocab(with_added_tokens=True)
            self._names = [None] * (max(vocab.values()) + 1)
            for name, i in vocab.items():
                self._names[i] = name
        return self._names

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode with `skip_special_tokens=False`."""
        if self.no_decoder:
            names = self.names
            return " ".join([names[i] for i in ids.tolist() if i < len(names) and names[i] is not None])
        return self.whole.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(maxsize=4)
def encoder(path: str, long_pieces=None) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path, long_pieces)
