"""Whole jobs against SQL and rows that hold for the whole job."""

import datetime as dt
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract
from backuplake.operators import joins
from backuplake.plans.registry import with_views
from compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
STATE = """(SELECT * FROM (SELECT device_id, path, arg_max({{'c': checksum, 'd': is_deleted}}, (created_at, snapshot_id)) AS s
    FROM snapshots WHERE {} GROUP BY ALL) WHERE NOT s.d)"""
DIFF = f"""SELECT coalesce(a.device_id, n.device_id) AS device_id, coalesce(a.path, n.path) AS path,
    a.s.c AS old_checksum, n.s.c AS new_checksum,
    CASE WHEN a.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN a.s.c = n.s.c THEN 'unchanged'
         ELSE 'modified' END AS change
    FROM {STATE.format("created_at < TIMESTAMP '1999-01-01'")} a
    FULL JOIN {STATE.format("true")} n ON a.device_id = n.device_id AND a.path = n.path"""
RATIOS = f"""WITH df AS ({DIFF}), s AS (SELECT DISTINCT device_id FROM snapshots),
    r AS (SELECT device_id, count(*) FILTER (change = 'modified')::DOUBLE / nullif(count(*) FILTER (change <> 'deleted'), 0) AS modified_files_ratio,
      count(*) FILTER (change = 'new')::DOUBLE / nullif(count(*) FILTER (change <> 'deleted'), 0) AS new_files_ratio FROM df GROUP BY 1)
    SELECT device_id, modified_files_ratio, new_files_ratio FROM s LEFT JOIN r USING (device_id)"""


@pytest.mark.parametrize("name, sql", [("jn_06_snapshot_diff", DIFF), ("agg_22_file_set_features", RATIOS)])
def test_diff_of_whole_states(spark, name, sql):
    want = connect(SF_DIR).execute(with_views(sql, "snapshots")).df()
    got = contract.queries()[name](spark, SF_DIR).select(*want.columns).toPandas()
    assert difference(got, want) is None


def test_state_keeps_old_files_and_drops_deleted_ones(spark, rows):
    at = lambda y: dt.datetime(y, 6, 1)
    data = [
        ("1", "still", at(1990), "a", False), ("2", "gone", at(1990), "a", False), ("3", "gone", at(2000), "b", True),
        ("4", "back", at(1990), "a", True), ("5", "back", at(2000), "a", False), ("6", "edit", at(1998), "a", False),
        ("7", "edit", at(2000), "b", False),
    ]
    table = spark.createDataFrame(data, "snapshot_id string, path string, created_at timestamp_ntz, checksum string, is_deleted boolean")
    old, new = joins.state_as_of(table, ["path"], "1999-01-01"), joins.state_as_of(table, ["path"])
    got = rows(joins.snapshot_diff(old, new, ["path"]), "path", "change")
    assert got == [("back", "new"), ("edit", "modified"), ("gone", "deleted"), ("still", "unchanged")]
