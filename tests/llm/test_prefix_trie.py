"""The prefix trie against a dictionary of prefixes, and on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from backuplake.llm import prefix_trie
from backuplake.operators import ordered

SCHEMA = "conv_id long, turn long, role string, text string, depth int, pos string, member array<int>"


def rem(c, n):
    return c - n * int(c / n)


def plain(rows):
    """Every prefix of every rebuilt conversation, kept whole."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - rem(c, 100), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []

    def visit(p):
        leaves, saved = (0 if children[p] else 1), ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        for kid in children[p]:
            a, b = visit(kid)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(whole[c]) == len(p)))
        up = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), up, len(members[p]), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        visit(())
    return sorted(out, key=str)


def rows():
    rng, out = random.Random(9), []
    said = [("user", "hi"), ("assistant", "hello\nthere"), ("user", "ünï中"), (None, None), ("", "x"), ("u", "serhi"), ("us", "erhi")]
    for c in [*range(0, 60), *range(150, 190), 200, 307, -5, -150, -151, 2**40 + 3]:
        for turn in range(rng.randrange(1, 7)):
            out.append((c, rng.choice([turn, turn, None]), *said[rng.randrange(2 if turn < 2 else 7)]))
    # Copies of whole conversations, one with a very long text, one with many turns, repeated rows and rows without an id.
    out += [(c, t, "user", "same") for c in range(400, 430) for t in range(7)]
    out += [(500, 0, "user", "y" * 200_000)] + [(600, t, "user", str(t)) for t in range(120)] + [(601, 0, "user", "again")] * 30
    return [(*r, 1, "p", [1]) for r in out + [(None, 0, "user", "hi"), (None, None, None, None)]]


@pytest.mark.parametrize("small", [False, True])
def test_nodes_equal_a_dictionary_of_prefixes(spark, small, monkeypatch):
    if small:
        for name, value in {"RULERS": 4, "WALK": 20, "BLOCK_ARCS": 50}.items():
            monkeypatch.setattr(prefix_trie, name, value)
        monkeypatch.setattr(ordered, "BLOCK_ROWS", 40)
    data = rows()
    got = prefix_trie.trie(spark.createDataFrame(data, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == plain(data)


def test_no_conversations(spark):
    none = spark.createDataFrame([(None, 0, "user", "hi", 1, "p", [1])], SCHEMA)
    assert prefix_trie.trie(none).count() == 0
