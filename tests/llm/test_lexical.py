"""Lexical search by ball trees against plain scoring, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from backuplake.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n string, places int, score long, item_id long"


def words(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def plain(docs, items, k=10):
    """Ranks from the definition, one document after the other."""
    own = [(i, words(t)) for i, t in docs]
    count, total = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    df = Counter(t for _, w in own for t in set(w))
    out = []
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, []).extend(words(t))
    for item, terms in asked.items():
        scores = []
        for i, w in own:
            tf = Counter(w)
            m = 25 + 75 * len(w) * count // total if w else 0
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if tf[t]
            )
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus(seed, size=300):
    rng = random.Random(seed)
    vocabulary = [w + rng.choice("abcxyz") + str(i % 7) for i, w in enumerate(["Alpha", "beta", "ÄÖ", "gamma", "İstanbul", "中文", "x"] * 12)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(size)]
    odd = [None, "", " ,;\x7f\x00", "a-b_c'd", "ALPHA" * 4000, "beta " * 30_000, "no term of any item ßß"]
    texts += odd + [texts[0]] * 40
    docs = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5])]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12)))) for i in range(12)]
    return docs, items + [(50, None), (51, ""), (52, "unseenword"), (None, texts[1]), (1, "Alpha beta"), (53, texts[2])]


@pytest.mark.parametrize("block, leaf, numbers, seeds, run", [(8192, 8, 1 << 24, 8192, 20_000), (50, 3, 1 << 24, 40, 30), (64, 1, 2_000, 100, 5)])
def test_ranks_equal_plain_scores(spark, block, leaf, numbers, seeds, run, monkeypatch):
    docs, items = corpus(block)
    for name, value in {"BLOCK_DOCS": block, "LEAF": leaf, "BLOCK_NUMBERS": numbers, "ITEM_TERMS": run}.items():
        monkeypatch.setattr(lexical, name, value)
    d = spark.createDataFrame([(i, t, "n", 1, 2, 3) for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, rank int")
    got = sorted(map(tuple, lexical.search(d, b, seed_docs=seeds).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == plain(docs, items)


def test_no_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(d.limit(0), b).count() == 0
    assert lexical.search(d, b.limit(0)).count() == 0
    assert lexical.search(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), b).count() == 0


def test_bounds_hold_and_prune():
    """No row of a ball exceeds its bound, and most rows are never scored."""
    rng = np.random.default_rng(4)
    dims, rows = 400, 1500
    topics = [rng.choice(dims, 40, replace=False) for _ in range(30)]
    lists = [np.unique(np.concatenate([rng.choice(topics[r % 30], 18), rng.choice(dims, 4)])) for r in range(rows)]
    size = np.array(list(map(len, lists)))
    place = np.concatenate(lists).astype(np.int64)
    block = lexical.Block(np.arange(rows), np.cumsum(size) - size, place, rng.integers(1, 900_000, len(place)))
    vectors = [(np.unique(rng.choice(topics[q % 30], 12)), None) for q in range(20)]
    queries = lexical.Queries([(at, rng.integers(1, 4, len(at))) for at, _ in vectors], rng.integers(0, 9000, dims))
    tree, visited = lexical.Tree(block, queries), [0]
    for q, (at, value) in enumerate(queries.exact):
        dense = np.zeros(dims, np.int64)
        dense[at] = value
        scores = tree.block.scores(dense)
        nodes, bound = tree.bounds(q, np.arange(len(tree.nodes)), 0)
        for i, b in zip(nodes, bound):
            first, end, _ = tree.nodes[i]
            inner = float(tree.centre[i, at].astype(float) @ queries.bent[q])
            assert scores[first:end].max() <= b
            assert scores[first:end].max() <= (inner + queries.norms[q] * tree.radius[i]) * (1 + 1e-6) + 1
        heap = []
        tree.search(q, heap, 10, 1, visited)
        best = sorted(zip(scores.tolist(), (-tree.block.ids).tolist()), reverse=True)
        assert sorted(heap, reverse=True) == [x for x in best if x[0] > 0][:10]
    assert visited[0] < 0.5 * rows * len(queries.exact)
