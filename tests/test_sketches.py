"""Sketches of chunk sets: exact while small, within their error beyond, merged in any way."""

import random

from backuplake.operators import sketches as sk

SCHEMA = "day int, device string, digest string, size int"


def references(rng, rows=30_000, distinct=9_000):
    return [(rng.randrange(10), rng.choice("aaab"), f"c{rng.randrange(distinct)}", None) for _ in range(rows)]


def exact(data, key):
    out = {}
    for row in data:
        out.setdefault(key(row), set()).add(row[2])
    return out


def sized(data):
    return [(d, v, c, int(c[1:]) % 100 + 1) for d, v, c, _ in data]


def found(sketches, *keys):
    return {tuple(r[k] for k in keys): r for r in sk.estimates(sketches, keys).collect()}


def test_small_sets_are_exact(spark):
    data = sized(references(random.Random(1), 3000, 400)) + [(1, "z", None, 5), (1, "z", "c1", None), (1, "z", "c1", 7)]
    daily = sk.sketch(spark.createDataFrame(data, SCHEMA), ["day", "device"], 500)
    whole = found(sk.merge(daily, ["device"], 500), "device")
    known = [r for r in data if r[2]]
    for device, chunks in exact(known, lambda r: r[1]).items():
        r, sizes = whole[device,], {}
        for _, v, c, s in known:
            if v == device:
                sizes[c] = max(sizes.get(c, 0), s or 0)
        assert (r.distinct_chunks, r.distinct_bytes, r.relative_error) == (len(chunks), sum(sizes.values()), 0.0)
        assert (r.references, r.bytes) == (sum(x[1] == device for x in known), sum(x[3] or 0 for x in known if x[1] == device))


def test_large_sets_are_within_the_error(spark):
    data = sized(references(random.Random(2)))
    df = spark.createDataFrame(data, SCHEMA)
    daily = sk.sketch(df, ["day", "device"], 400)
    merged = sk.merge(daily, ["device"], 400)
    for (device,), r in found(merged, "device").items():
        chunks = {x[2] for x in data if x[1] == device}
        size = sum(int(c[1:]) % 100 + 1 for c in chunks)
        assert 0.04 < r.relative_error < 0.08
        assert abs(r.distinct_chunks / len(chunks) - 1) < 4 * r.relative_error
        assert abs(r.distinct_bytes / size - 1) < 6 * r.relative_error
    assert merged.selectExpr("max(size(entries))").first()[0] <= 400
    # Days first or all at once: the same sketch.
    halves = sk.merge(daily.withColumn("half", daily.day < 5), ["half", "device"], 400)
    a, b = (sorted((r.device, sorted(map(tuple, r.entries)), r.limit) for r in m.collect()) for m in (merged, sk.merge(halves, ["device"], 400)))
    assert a == b


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sk.merge(sk.sketch(none, ["device"]), ["device"]).count() == 0
