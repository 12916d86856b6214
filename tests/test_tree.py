"""The directory source against a walk of the same tree."""

import os

import pytest

from backuplake.sources import tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for i in range(6):
        for j in range(4):
            folder = top / f"d{i}" / f"e {j}" / "ü"
            folder.mkdir(parents=True)
            for k in range(5):
                (folder / f"f{k}.txt").write_bytes(b"x" * (k * 100 + i))
    (top / "empty" / "below").mkdir(parents=True)
    (top / "zero").touch()
    (top / "locked").write_text("secret")
    os.chmod(top / "locked", 0o640)
    os.symlink(top / "d0", top / "link")
    return str(top)


def walked(root):
    out = set()
    for folder, folders, files in os.walk(root):
        for name in folders + files:
            path = os.path.join(folder, name)
            directory = os.path.isdir(path) and not os.path.islink(path)
            out.add((path, folder, name, 0 if directory else os.lstat(path).st_size, directory, oct(os.lstat(path).st_mode & 0o777)))
    return out


def listed(df):
    def mode(text):
        return oct(sum(1 << (8 - i) for i, c in enumerate(text) if c != "-"))

    return {(r.path, r.parent_path, r.name, r.size, r.is_directory, mode(r.permissions)) for r in df.collect()}


@pytest.mark.parametrize("pieces", [1, 3, 40, 256])
def test_rows_equal_a_walk(spark, root, pieces):
    found = tree.directory_tree(spark, root, pieces=pieces)
    assert listed(found) == walked(root) and found.count() == len(walked(root))
    assert any(p.endswith("/zero") and s == 0 for p, _, _, s, _, _ in listed(found))
    assert found.filter("modified_time IS NULL").count() == 0


def test_wide_folders_are_cut_by_name(root, monkeypatch):
    monkeypatch.setattr(tree, "WIDE", 3)
    reader = tree.TreeReader(f"file://{root}", 4)
    pieces = reader.partitions()
    assert len(pieces) == 4 and {p.parts for p in pieces} == {4}
    rows = [path for p in pieces for batch in reader.read(p) for path in batch.column("path").to_pylist()]
    assert sorted(rows) == sorted(p for p, *_ in walked(root))


def test_options_narrow_the_scan(spark, root):
    prefix = f"{root}/d3/e 1"
    want = {r for r in walked(root) if r[0].startswith(prefix) and 200 <= r[3] < 400 and not r[4]}
    found = tree.directory_tree(spark, root, prefix, 200, 399, "file")
    assert listed(found) == want and len(want) == 2
    assert listed(tree.directory_tree(spark, root, kind="directory")) == {r for r in walked(root) if r[4]}
    # One DataFrame under two filters.
    every = tree.directory_tree(spark, root)
    both = every.filter("is_directory").select("path").join(every.filter("NOT is_directory").select(every.parent_path.alias("path")), "path")
    assert both.count() == 120


def test_filters_are_pushed_down(spark, root):
    prefix = f"{root}/d3/e 1"
    spark.dataSource.register(tree.TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = spark.read.format("backup_tree").option("pushdown", True).load
        df = load(root).filter(f"startswith(path, '{prefix}') AND size >= 200 AND size < 400 AND NOT is_directory")
        # Nothing is left for Spark to filter.
        assert "Filter" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert listed(df) == {r for r in walked(root) if r[0].startswith(prefix) and 200 <= r[3] < 400 and not r[4]}
        # A filter that the scan cannot decide stays with Spark.
        rest = load(root).filter("name LIKE '%3.txt'")
        assert "Filter EndsWith" in rest._jdf.queryExecution().optimizedPlan().toString() and rest.count() == 24
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_subtrees_without_a_match_are_not_opened(root, monkeypatch):
    opened = []
    entries = tree.LocalFiles.entries
    monkeypatch.setattr(tree.LocalFiles, "entries", lambda self, folder: (opened.append(folder), entries(self, folder))[1])
    reader = tree.PushedTreeReader(root, 256)
    assert reader.pushFilters([tree.StringStartsWith(("path",), f"{root}/d3/e 1/"), tree.EqualTo(("parent_path",), f"{root}/d3/e 1/ü")]) == []
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(len(b) for b in rows) == 5
    assert not [f for f in opened if not (f"{root}/d3/e 1/ü").startswith(f)]


def test_no_such_folder(spark, root):
    with pytest.raises(Exception, match="No such file"):
        tree.directory_tree(spark, f"{root}/missing").count()
