"""Near-duplicate documents by BagMinHash over multisets of word shingles.

A document is the multiset of its runs of five words (lower-cased; a shorter text is one run of all
its words). Each unit of weight of each shingle starts a Poisson process of its own; its points fall
in time order on `REGISTERS` registers, and a register keeps its earliest point. Two documents agree
in a register with the probability of their weighted Jaccard similarity. Only points before a time
by which all registers are likely filled are drawn; if one is still empty, more are.

Equal word sequences fold into one class first. The others meet in bands of registers; each member
of a band is compared with the band's centre, exactly, on multiset overlap. Members that belong to
different components afterwards are compared with each other where the distances to the centre, a
metric, leave a similarity of `threshold` possible and enough registers agree in a few bits. The
components of the links are the classes.

Texts without a word have no shingles: only equal ones fold into one class, and null counts as empty. Rows with a null id take no part. A repeated id counts with each of its texts, and all
of them share a class. Only `doc_id` and `text` are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backuplake.llm.components import components
from backuplake.llm.words import STEP, mixed, occurrences, shingles, steps, words
from backuplake.session import pin

SHINGLE = 5
THRESHOLD = 0.8
#: 25 bands of 5 registers find a pair of similarity 0.8 but for 5 in 100,000.
BANDS, ROWS = 25, 5
REGISTERS = 256
#: Bits kept of each register. Registers of documents of similarity 0.8 differ in them with a probability
#: of 0.2 * 15 / 16; more than `APART` of 256 do in 2 of 1,000 pairs just at 0.8, in 1 of 10,000 at 0.82. Only
#: pairs that no centre has linked are filtered so.
PLANES = 4
APART = 66
#: Words whose registers are computed together.
TOGETHER = 150_000


def units(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights as one digest per unit: (shingle, n-th occurrence)."""
    distinct, counts = occurrences(values)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(distinct, counts), nth.astype(np.uint64)


def levels(distinct: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A seed for each unit of weight; weights share the seeds of all smaller ones."""
    return mixed(distinct + (nth + np.uint64(1)) * STEP)


def signatures(seeds: np.ndarray, counts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers of several documents: the digest of the earliest point on each.

    `seeds` holds the units of one document after another, `counts` how many each has. A unit's
    process has rate `registers`, and each point falls on a random register. The k-th point of a
    unit is drawn only while the unit is still below its document's time limit.
    """
    best = np.full(len(counts) * registers, np.inf)
    mark = np.zeros(len(best), np.uint64)
    live, at, k, points = seeds, np.zeros(len(seeds)), 0, []
    base = np.repeat(np.arange(len(counts)) * registers, counts)
    limit = np.repeat((np.log(registers) + 3.0) / counts, counts)
    while len(live):
        k += 1
        draw = mixed(live + steps(k))
        # 53 bits make the waiting time; scrambled again they make the register.
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / registers
        inside = np.flatnonzero(at <= limit)
        live, at, draw, base, limit = live[inside], at[inside], draw[inside], base[inside], limit[inside]
        place = base + (mixed(draw) >> np.uint64(7)).astype(np.int64) % registers
        np.minimum.at(best, place, at)
        points.append((place, at, draw))
    for place, at, draw in points:
        won = at == best[place]
        mark[place[won]] = draw[won]
    out = mark.reshape(-1, registers)
    open_rows = np.flatnonzero(~np.isfinite(best.reshape(-1, registers)).all(axis=1))
    for i in open_rows:
        end = int(counts[: i + 1].sum())
        out[i] = _complete(seeds[end - counts[i] : end], registers)
    return out


def _complete(seeds: np.ndarray, registers: int) -> np.ndarray:
    """Registers of one document whose time limit was too short: points until all are filled."""
    best, mark = np.full(registers, np.inf), np.zeros(registers, np.uint64)
    at, k = np.zeros(len(seeds)), 0
    while True:
        k += 1
        draw = mixed(seeds + steps(k))
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / registers
        if at.min() > best.max():
            return mark
        place = (mixed(draw) >> np.uint64(7)).astype(np.int64) % registers
        before = best.copy()
        np.minimum.at(best, place, at)
        won = (at == best[place]) & (best[place] < before[place])
        mark[place[won]] = draw[won]


def band_keys(marks: np.ndarray) -> np.ndarray:
    """A key for each band of each row of registers."""
    rows = marks[:, : BANDS * ROWS].reshape(len(marks), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * STEP, (len(marks), BANDS))
    for i in range(ROWS):
        key = mixed(key ^ rows[:, :, i]) + STEP
    return key.view(np.int64)


def planes(marks: np.ndarray) -> np.ndarray:
    """`PLANES` bits of each register, a plane of 64-bit numbers for each."""
    scrambled = mixed(marks)
    bits = [((scrambled >> np.uint64(40 + i)) & np.uint64(1)).astype(np.uint8) for i in range(PLANES)]
    return np.concatenate([np.packbits(b, axis=1).view("<i8") for b in bits], axis=1)


def text_key(text: str, own: np.ndarray) -> bytes:
    """Digest of the word sequence; of the text itself if it has no word."""
    return xxhash.xxh3_128_digest(own.tobytes() if len(own) else b"text:" + text.encode("utf-8", "surrogatepass"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the word sequence), size (units), bands, planes."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("key", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64())), ("planes", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = words()
        for batch in batches:
            keys: list[bytes] = []
            sizes = np.zeros(batch.num_rows, np.int64)
            bands: list = [[]] * batch.num_rows
            flags: list = [[]] * batch.num_rows
            waiting: list[tuple[int, np.ndarray]] = []

            def settle() -> None:
                if waiting:
                    marks = signatures(np.concatenate([s for _, s in waiting]), np.array([len(s) for _, s in waiting]))
                    for (i, s), b, f in zip(waiting, band_keys(marks), planes(marks)):
                        sizes[i], bands[i], flags[i] = len(s), b, f
                    waiting.clear()

            held = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = hashed(text or "")
                keys.append(text_key(text or "", own))
                if len(own):
                    waiting.append((i, levels(*units(shingles(own, SHINGLE)))))
                    held += len(own)
                    if held > TOGETHER:
                        settle()
                        held = 0
            settle()
            columns = [batch.column("doc_id"), keys, sizes, bands, flags]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, key binary, size long, bands array<long>, planes array<long>")


def contents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, bag: the sorted unit digests of the documents in `ids`."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bag", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = words()
        for batch in batches:
            keys, bags = [], []
            for text in batch.column("text").to_pylist():
                own = hashed(text or "")
                keys.append(text_key(text or "", own))
                bags.append(np.sort(levels(*units(shingles(own, SHINGLE)))).tobytes() if len(own) else b"")
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(bags, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # A merge join at every size: ids grow with the documents.
    wanted = rows.join(ids.select("doc_id").hint("merge"), "doc_id", "left_semi")
    found = wanted.mapInArrow(run, "doc_id long, key binary, bag binary")
    # A repeated id has several texts; the sketch of the class named one of them.
    return found.join(ids.select("doc_id", "key"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])


def compare(star: DataFrame, bags: DataFrame) -> DataFrame:
    """`star` (centre, doc_id) with the exact weighted Jaccard `similarity`, the centre's size, and what the
    document's bag lacks of the centre's and adds to it."""
    of = lambda n, m: bags.select(F.col("doc_id").alias(n), F.col("bag").alias(m)).hint("merge")
    joined = star.join(of("doc_id", "bag"), "doc_id").join(of("centre", "middle"), "centre")
    schema = pa.schema(
        [("centre", pa.int64()), ("doc_id", pa.int64()), ("similarity", pa.float64()), ("whole", pa.int64()), ("lacks", pa.binary()), ("adds", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share, whole, lacks, adds = [], [], [], []
            for x, c in zip(batch.column("bag"), batch.column("middle")):
                x, c = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(c.as_buffer(), "<u8")
                less = np.setdiff1d(c, x, assume_unique=True)
                more = np.setdiff1d(x, c, assume_unique=True)
                share.append((len(c) - len(less)) / (len(c) + len(more)))
                whole.append(len(c))
                lacks.append(less.tobytes())
                adds.append(more.tobytes())
            columns = [batch.column("centre"), batch.column("doc_id"), *map(pa.array, (share, whole)), *(pa.array(c, pa.binary()) for c in (lacks, adds))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "centre long, doc_id long, similarity double, whole long, lacks binary, adds binary"
    return joined.select("centre", "doc_id", "bag", "middle").mapInArrow(run, ddl)


def through_centre(pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """`pairs` (centre, a, b) with their exact similarity.

    Both bags are the centre's but for what they lack and add, so only that travels: the common units
    are those of the centre that neither lacks, and those that both add.
    """
    of = lambda n: compared.select(
        "centre", F.col("doc_id").alias(n), F.col("whole").alias(f"whole_{n}"), F.col("lacks").alias(f"lacks_{n}"), F.col("adds").alias(f"adds_{n}")
    ).hint("merge")
    joined = pairs.join(of("b"), ["centre", "b"]).join(of("a"), ["centre", "a"])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c) for c in ("whole_a", "lacks_a", "lacks_b", "adds_a", "adds_b"))
            for whole, *parts in zip(*columns):
                la, lb, aa, ab = (np.frombuffer(p.as_buffer(), "<u8") for p in parts)
                twice = lambda x, y: int((np.diff(np.sort(np.concatenate([x, y])).view("<i8")) == 0).sum())
                n = whole.as_py()
                common = n - (len(la) + len(lb) - twice(la, lb)) + twice(aa, ab)
                out.append(common / (2 * n - len(la) - len(lb) + len(aa) + len(ab) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], schema=schema)

    wanted = ["a", "b", "whole_a", "lacks_a", "lacks_b", "adds_a", "adds_b"]
    return joined.select(*wanted).mapInArrow(run, "a long, b long, similarity double")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id, the smallest id of its class, for every document."""
    sketched = pin(sketches(docs), "sketches")
    same = sketched.groupBy("key").agg(F.min("doc_id").alias("rep"))
    members = pin(sketched.select("doc_id", "key").join(same, "key"), "members")
    firsts = same.withColumnRenamed("rep", "doc_id")
    # One row for each distinct text: its smallest id stands for it.
    reps = sketched.join(firsts, ["key", "doc_id"], "left_semi").dropDuplicates(["key"])
    reps = pin(reps.filter("size > 0"), "reps")
    banded = reps.select("doc_id", F.posexplode("bands").alias("nth", "band"))
    crowded = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = pin(banded.join(crowded.hint("merge"), "band"), "shared-bands")
    # The member that meets most others is the likeliest original: it is its bands' centre.
    weights = shared.groupBy("doc_id").agg(F.sum("n").alias("w"))
    weighed = pin(shared.join(weights.hint("merge"), "doc_id").select("band", "nth", "doc_id", "w"), "weighed-bands")
    centres = weighed.groupBy("band").agg(F.max(F.struct("w", -F.col("doc_id"))).alias("_c")).select("band", (-F.col("_c.col2")).alias("centre"))
    placed = pin(weighed.join(centres.hint("merge"), "band").select("band", "nth", "doc_id", "centre"), "placed-bands")
    star = placed.filter("doc_id <> centre").select("centre", "doc_id").distinct()
    wanted = reps.join(weights.select("doc_id").hint("merge"), "doc_id", "left_semi")
    bags = pin(contents(docs, wanted.select("doc_id", "key")), "bags")
    compared = pin(compare(star, bags), "compared")
    links = compared.filter(F.col("similarity") >= threshold).select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
    roots = pin(components(links), "roots")
    # Pairs within a band that are still in different components.
    rooted = placed.join(roots.select(F.col("node").alias("doc_id"), "root").hint("merge"), "doc_id", "left").withColumn(
        "root", F.coalesce("root", "doc_id")
    )
    split = rooted.groupBy("band").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi").select("band")
    near = compared.select("centre", "doc_id", (1 - F.col("similarity")).alias("far"))
    opened = rooted.join(split.hint("merge"), "band", "left_semi").join(near.hint("merge"), ["centre", "doc_id"])
    facts = reps.select("doc_id", "size", "bands", "planes")
    opened = pin(opened.select("band", "nth", "centre", "doc_id", "root", "far").join(facts.hint("merge"), "doc_id"), "open-bands")
    x = opened.select("band", "nth", "centre", *[F.col(c).alias(f"{c}_x") for c in ("doc_id", "root", "far", "size", "bands", "planes")])
    y = opened.select("band", *[F.col(c).alias(f"{c}_y") for c in ("doc_id", "root", "far", "size", "bands", "planes")])
    width = REGISTERS // 64
    differ = [F.get("planes_x", F.lit(i)).bitwiseXOR(F.get("planes_y", F.lit(i))) for i in range(width * PLANES)]
    lanes = differ[:width]
    for i in range(width, width * PLANES):
        lanes[i % width] = lanes[i % width].bitwiseOR(differ[i])
    apart = sum((F.bit_count(lane) for lane in lanes[1:]), F.bit_count(lanes[0]))
    first = F.array_position(F.zip_with("bands_x", "bands_y", lambda p, q: p == q), True) - 1
    possible = (
        (x["band"] == y["band"])
        & (F.col("doc_id_x") < F.col("doc_id_y"))
        & (F.col("root_x") != F.col("root_y"))
        # Distances to the centre are a metric.
        & (F.abs(F.col("far_x") - F.col("far_y")) <= 1 - threshold + 1e-9)
        & (F.least("size_x", "size_y") >= threshold * F.greatest("size_x", "size_y"))
        & (apart <= APART)
        # Each pair once, in the first band it shares.
        & (first == F.col("nth"))
    )
    more = x.join(y, possible).select("centre", F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b"))
    late = through_centre(more, compared).filter(F.col("similarity") >= threshold).select("a", "b")
    late = pin(late, "late-links")
    # A root stands for its component; repeated ids link the classes of their texts.
    hubs = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
    repeated = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("_z"))
    repeated = repeated.filter("a <> _z").select("a", F.col("_z").alias("b"))
    final = components(hubs.unionByName(late).unionByName(repeated))
    labelled = members.join(final.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left")
    return labelled.groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("class_id"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, one for each class: that with the smallest id. Rows with a null id all stay."""
    found = classes(docs, threshold)
    kept = found.filter("doc_id = class_id").select(F.col("doc_id").alias("__near_dedup_kept"))
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    named = docs.filter("doc_id IS NOT NULL").join(kept, F.col("doc_id").cast("bigint") == F.col("__near_dedup_kept"), "left_semi")
    once = named.withColumn("__near_dedup_n", F.row_number().over(order)).filter("__near_dedup_n = 1").drop("__near_dedup_n")
    return once.unionByName(docs.filter("doc_id IS NULL"))
