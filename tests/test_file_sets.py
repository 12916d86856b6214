"""Sets of files per chunk, and the trigram search built on them, against plain sets and scans."""

import random

from backuplake.operators import file_sets as fs
from backuplake.operators import path_index as pi

SCHEMA = "chunk string, file_no bigint"


def made(rng, hot):
    """A chunk in nearly every file, and chunks in a few."""
    wide = [("zeros", i) for i in range(hot) if i % 10]
    return wide + [(f"c{rng.randrange(50)}", rng.randrange(hot)) for _ in range(2000)]


def as_sets(rows):
    out = {}
    for chunk, number in rows:
        if chunk is not None and number is not None:
            out.setdefault(chunk, set()).add(number)
    return out


def listed(sets):
    return as_sets((r.chunk, r.file_no) for r in fs.members(sets, ["chunk"]).collect())


def test_sets_and_their_algebra(spark):
    rng = random.Random(4)
    left, right = made(rng, 70_000), made(rng, 50_000)
    left += left[:500] + [(None, 3), ("none", None)]
    right += [("only", 1)]
    a, b = (fs.build(spark.createDataFrame(r, SCHEMA), "chunk").cache() for r in (left, right))
    x, y = as_sets(left), as_sets(right)
    assert listed(a) == x and {r.chunk: r.file_count for r in fs.counts(a, "chunk").collect()} == {k: len(v) for k, v in x.items()}
    rows = a.filter("chunk = 'zeros'").collect()
    # The hot chunk lies in three buckets of bounded size; those with few members hold positions.
    assert len(rows) == 3 and all(len(r.bitmap or b"") in (0, 4096) for r in rows) and a.filter("bitmap IS NULL AND size(positions) <> members").count() == 0
    keys = set(x) | set(y)
    pick = lambda rule: {k: v for k in keys if (v := rule(x.get(k, set()), y.get(k, set())))}
    assert listed(fs.combine(a, b, "chunk", "union")) == pick(set.union)
    assert listed(fs.combine(a, b, "chunk", "difference")) == pick(set.difference)
    both = fs.combine(a, b, "chunk", "intersection")
    assert listed(both) == pick(set.intersection)
    assert {r.chunk: r.file_count for r in fs.counts(both, "chunk").collect()} == {k: len(v) for k, v in pick(set.intersection).items()}
    none = fs.build(spark.createDataFrame([], SCHEMA), "chunk")
    assert listed(fs.combine(a, none, "chunk", "difference")) == x and fs.combine(none, none, "chunk", "union").count() == 0


def test_numbers_are_dense_and_ordered(spark):
    names = [f"/a/{i % 700}" for i in range(3000)] + [None]
    got = [(r.file, r.file_no) for r in fs.numbered(spark.createDataFrame([(n,) for n in names], "file string"), first=5).collect()]
    assert sorted(got) == [(n, i + 5) for i, n in enumerate(sorted({n for n in names if n}))]


def test_search_equals_a_scan_and_reads_less(spark):
    rng = random.Random(6)
    words = ["Alpha", "beta", "GAMMA", "Über", "ΑΣΒ", "日本語", "x", ".cache", "a%b", "we_ird"]
    paths = sorted({"/" + "/".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(3)) + rng.choice([".jpg", ".TXT", ""]) for _ in range(5000)})
    index = pi.build(spark.createDataFrame([(p,) for p in [*paths, *paths[:50], None]], "path string"), span=1, bucket_files=16)
    for needle in ["alpha1", "ÜBER2", "ασβ", "本語1", "/x1/", "t", "", "beta7/gamma1", "nothing at all", "a%b", "_ir"]:
        got = [r.path for r in pi.search(index, needle).collect()]
        assert sorted(got) == [p for p in paths if needle.lower() in p.lower()], needle
    got = [r.path for r in pi.search(index, "GAMMA1", [".jpg", ".txt"], name_only=True).collect()]
    assert sorted(got) == [p for p in paths if "gamma1" in p.rsplit("/", 1)[1].lower() and p.lower().endswith((".jpg", ".txt"))]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    for pattern in ["%Alpha1%.jpg", "/ΑΣ%", "%x_/%", "%we\\_ird3%", "/beta1/%"]:
        got = sorted(r.path for r in pi.like(index, pattern).collect())
        assert got == sorted(r.path for r in frame.filter(frame.path.like(pattern)).collect()), pattern
    read = index.postings().filter("gram IN ('lph')")
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,lph)]" in read._jdf.queryExecution().toString()
    assert read.count() >= 1 and len(index.postings().inputFiles()) > 4


def test_candidates_choose_folders(spark):
    paths = [f"/d{i:06d}/{'rare' if i == 40_000 else 'plain'}" for i in range(70_000)]
    index = pi.build(spark.createDataFrame([(p,) for p in paths], "path string"), span=1)
    hit = pi.search(index, "rare")
    assert [r.path for r in hit.collect()] == [paths[40_000]]
    plan = hit._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(span" in plan and "(span#" in plan
    assert sorted({r.span for r in index.paths().select("span").distinct().collect()}) == [0, 1, 2]
