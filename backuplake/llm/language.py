"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to `ORDER` long with frozen counts. A byte's probability
after a context is its count there; a byte not seen there is coded by an escape (as often as the
context has distinct bytes) and the next shorter context, down to one in 256. The language whose
tree codes the whole lower-cased text shortest is predicted; the score is its posterior if a text
had at most `EVIDENCE` bytes, so that it falls where languages mix.

The model is fit on at most `SAMPLE` labelled rows per language, those with the smallest digests of
their ids; it keeps at most `CONTEXTS` contexts, the most frequent. Predictions read whole texts and
nothing else. Null texts and texts without a letter are `und` with score 0, and so is every text
if no language was learned. Rows with a null id are never learned from. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backuplake.session import pin

ORDER = 3
SAMPLE = 1000
CONTEXTS = 8192
EVIDENCE = 32
#: Bytes scored at once.
STRETCH = 1 << 19
UNKNOWN = "und"
#: In the pipeline a text is kept if its language is known with at least this score.
LEAST_SCORE = 0.5

_HAS_LETTER = re.compile(r"[^\W\d_]")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def prepared(text: str) -> bytes:
    """A text's bytes after a start of line breaks, one for each byte of the longest context."""
    return b"\n" * ORDER + text.lower().encode("utf-8", "replace")


class Model:
    """Context trees of all languages in one table of code lengths.

    `counts`: language to Counter of byte runs of ORDER + 1 bytes.
    """

    def __init__(self, counts: dict[str, Counter]):
        self.languages = sorted(counts)
        seen = sorted({b for c in counts.values() for run in c for b in run})
        self.symbol = np.full(256, len(seen), np.int32)
        self.symbol[seen] = np.arange(len(seen))
        self.width = len(seen) + 1
        after: dict[bytes, list] = defaultdict(lambda: [None] * len(self.languages))
        total: Counter = Counter()
        for k, name in enumerate(self.languages):
            for run, n in counts[name].items():
                byte = run[-1]
                for d in range(ORDER + 1):
                    context = run[ORDER - d : ORDER]
                    own = after[context]
                    if own[k] is None:
                        own[k] = Counter()
                    own[k][byte] += n
                    total[context] += n
        # A context is never rarer than a longer one that ends in it, so its shorter ones stay too.
        kept = sorted(total, key=lambda c: (-total[c], len(c), c))[:CONTEXTS]
        kept.sort(key=lambda c: (len(c), c))
        place = {c: i for i, c in enumerate(kept)}
        self.dead = len(kept)
        self.child = np.full((self.dead + 1, self.width), self.dead, np.int32)
        self.bits = np.zeros((max(1, self.dead), self.width, len(self.languages)), np.float32)
        for context, i in place.items():
            if context:
                self.child[place[context[1:]], self.symbol[context[0]]] = i
                base = self.bits[place[context[1:]]]
            else:
                base = np.full((self.width, len(self.languages)), 8.0, np.float32)
            self.bits[i] = base
            for k, own in enumerate(after[context]):
                if own:
                    n, distinct = sum(own.values()), len(own)
                    self.bits[i, :, k] += np.log2((n + distinct) / distinct)
                    for byte, c in own.items():
                        self.bits[i, self.symbol[byte], k] = np.log2((n + distinct) / c)
        self.child[:, self.width - 1] = self.dead

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each prepared text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        starts = ends - sizes + ORDER
        data = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        child, bits = self.child.reshape(-1), self.bits.reshape(-1, len(self.languages))
        for low in range(0, len(data), STRETCH):
            high = min(low + STRETCH, len(data))
            first = max(low, ORDER)
            if first >= high:
                continue
            node, best = np.zeros(high - first, np.int32), np.zeros(high - first, np.int32)
            for d in range(1, ORDER + 1):
                node = child[node * self.width + data[first - d : high - d]]
                best = np.where(node == self.dead, best, node)
            cost = bits[best * self.width + data[first:high]]
            inside = np.flatnonzero((starts < high) & (ends > first) & (starts < ends))
            if len(inside):
                a = np.maximum(starts[inside], first) - first
                b = np.minimum(ends[inside], high) - first
                edges = np.stack([a, b], axis=1).reshape(-1)
                sums = np.add.reduceat(np.vstack([cost, np.zeros((1, cost.shape[1]), np.float32)]), edges, axis=0, dtype=np.float64)
                out[inside] += np.where((b > a)[:, None], sums[::2], 0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.languages and _HAS_LETTER.search(t)]
        if known:
            rows = [prepared(texts[i]) for i in known]
            length = np.array([len(r) - ORDER for r in rows])
            bits = self.lengths(rows)
            fair = np.log(2) * bits * (np.minimum(length, EVIDENCE) / length)[:, None]
            weight = np.exp(fair.min(axis=1, keepdims=True) - fair)
            share = weight / weight.sum(axis=1, keepdims=True)
            pick = bits.argmin(axis=1)
            for i, p, s in zip(known, pick, share):
                names[i], scores[i] = self.languages[p], float(s[p])
        return names, scores


def drawn(rows: DataFrame, group: str, sample: int) -> DataFrame:
    """At most `sample` rows for each value of `group`, those with the smallest digests of doc_id.

    About four times as many are cut out by their digests first, so that no task ranks a whole group.
    """
    digest = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    # One row for each value of the group.
    counts = rows.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__rows"))
    near = rows.join(F.broadcast(counts), F.col(group) == F.col("__group")).filter(digest < F.lit(4.0 * sample * (1 << 40)) / F.col("__rows"))
    order = Window.partitionBy(group).orderBy(digest, "doc_id")
    return near.withColumn("__nth", F.row_number().over(order)).filter(F.col("__nth") <= sample).drop("__group", "__rows", "__nth")


def fit(docs: DataFrame, learnable: Column, sample: int = SAMPLE) -> Model:
    """The model of the rows where `learnable` holds and lang is not null."""
    narrow = docs.filter(learnable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    picked = pin(drawn(narrow, "lang", sample), "language-sample")
    # At most `sample` rows for each language.
    rows = docs.select("doc_id", "lang", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), ["doc_id", "lang"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                data = prepared(text)
                found[lang].update([data[i : i + ORDER + 1] for i in range(len(data) - ORDER)])
            flat = [(lang, run_, n) for lang, own in found.items() for run_, n in own.items()]
            langs, runs, ns = zip(*flat) if flat else ((), (), ())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "run": pa.array(runs, pa.binary()), "n": pa.array(ns, pa.int64())})

    counted = rows.mapInArrow(run, "lang string, run binary, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    # Bounded by the sample and by the number of byte runs of that length that languages use.
    counts: dict[str, Counter] = defaultdict(Counter)
    for row in counted.collect():
        counts[row["lang"]][bytes(row["run"])] = row["n"]
    return Model(counts)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (doc_id if not given) with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            columns = [batch.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def keep_known(docs: DataFrame, learnable: Column, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is known, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, learnable))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
