"""Differences by folder digests against the plain outer join, and how little they join."""

import random

import pytest

from backuplake.operators import joins, merkle

SCHEMA = "device string, path string, checksum string"


def tree(rng, devices=3, files=200):
    out = {}
    for _ in range(files):
        depth = rng.randrange(0, 5)
        folders = "".join(f"/d{rng.randrange(3)}" for _ in range(depth))
        out[str(rng.randrange(devices)), f"{folders}/f{rng.randrange(20)}"] = rng.choice(["1", "2", None])
    return out


def frames(spark, *states):
    return [spark.createDataFrame([(*k, v) for k, v in s.items()], SCHEMA) for s in states]


def changed(rng, state, share):
    out = {}
    for k, v in state.items():
        r = rng.random()
        if r >= share:
            out[k] = v
        elif r < share / 2:
            out[k] = "changed"
    return out | {k: v for k, v in tree(rng, files=int(200 * share)).items() if k not in state}


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5])
def test_rows_equal_the_outer_join(spark, rows, share):
    rng = random.Random(int(share * 100))
    old = tree(rng)
    new = changed(rng, old, share)
    a, b = frames(spark, old, new)
    want = rows(joins.snapshot_diff(a, b, ["device", "path"]), "device", "path", "old_checksum", "new_checksum", "change")
    digests = [merkle.digested(s, ["device"]) for s in (a, b)]
    found = merkle.compare(*digests)
    assert rows(found.changes, "device", "path", "old_checksum", "new_checksum", "change") == want
    only = merkle.compare(*digests, unchanged=False).changes
    assert rows(only, "device", "path", "old_checksum", "new_checksum", "change") == [w for w in want if w[-1] != "unchanged"]
    if share == 0:
        assert found.joined[0] == 6 and not any(found.joined[1:])


def test_a_file_in_place_of_a_folder_and_empty_states(spark, rows):
    a, b, none = frames(spark, {("1", "/a"): "x", ("1", "/b/c"): "y"}, {("1", "/a/b"): "x", ("1", "/b/c"): "y"}, {("9", "/z"): "1"})
    none = none.limit(0)
    d = {n: merkle.digested(s, ["device"]) for n, s in [("a", a), ("b", b), ("none", none)]}
    changes = lambda x, y: rows(merkle.compare(d[x], d[y]).changes, "path", "change")
    assert changes("a", "b") == [("/a", "deleted"), ("/a/b", "new"), ("/b/c", "unchanged")]
    assert changes("none", "a") == [("/a", "new"), ("/b/c", "new")]
    assert changes("a", "none") == [("/a", "deleted"), ("/b/c", "deleted")]
    assert changes("none", "none") == []


def test_joined_rows_follow_the_changes(spark):
    old = {("1", f"/d{i}/e{j}/f{k}"): "x" for i in range(20) for j in range(20) for k in range(5)}
    new = old | {("1", "/d3/e4/f0"): "y", ("1", "/d3/e4/f9"): "y"}
    found = merkle.compare(*[merkle.digested(s, ["device"]) for s in frames(spark, old, new)])
    # The root, 20 folders of it, 20 folders of one of those, and the files of one of those; each on both sides.
    assert found.joined == [2, 40, 40, 11]
    assert found.changes.filter("change = 'unchanged'").count() == len(old) - 1
