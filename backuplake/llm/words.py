"""Words of a text as 64-bit digests, and digests of runs of words."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash

#: The odd multipliers of a 64-bit finaliser.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Runs between white space remembered per worker; the table starts again when it is full.
KNOWN = 150_000

_WORD = re.compile(r"\w+")


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled one to one."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def steps(k: int) -> np.uint64:
    """k steps, modulo 2**64."""
    return np.uint64(k * int(STEP) % (1 << 64))


class Words:
    """Lower-cased runs of letters, digits and underscores, as digests that are the same everywhere."""

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> np.ndarray:
        runs = text.split()
        known = self.known
        found = list(map(known.get, runs))
        if None in found:
            if len(known) > KNOWN:
                known.clear()
            for i, value in enumerate(found):
                if value is None:
                    run = runs[i]
                    value = known.get(run)
                    if value is None:
                        low = run.lower()
                        # Lower-casing may add marks, which part words.
                        parts = [low] if low.isalnum() else _WORD.findall(low)
                        value = b"".join([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")).to_bytes(8, "little") for w in parts])
                        known[run] = value
                    found[i] = value
        return np.frombuffer(b"".join(found), "<u8")


@lru_cache(maxsize=1)
def words() -> Words:
    """One table per worker."""
    return Words()


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Digests of all runs of `size` words; of the whole text if it has fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out ^ hashes[i : n - size + 1 + i]) + STEP
    return out


def occurrences(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each stands."""
    return np.unique(values, return_counts=True)
