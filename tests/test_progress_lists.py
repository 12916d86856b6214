"""How often progress until done goes to the state: a fake handle counts the calls and keeps what is written."""

import pandas as pd
import pytest

from backuplake.streaming import stateful


class Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def _call(self):
        self.calls += 1

    def exists(self):
        self._call()
        return self.value is not None

    def get(self):
        self._call()
        return self.value

    def update(self, value):
        self._call()
        self.value = value

    def clear(self):
        self._call()
        self.value = None


class Lists(Value):
    def __init__(self):
        super().__init__()
        self.value = {}

    def containsKey(self, key):
        self._call()
        return key in self.value

    def getValue(self, key):
        self._call()
        return self.value[key]

    def updateValue(self, key, value):
        self._call()
        self.value[key] = value

    def clear(self):
        self._call()
        self.value = {}


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Value())

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Lists())

    def calls(self):
        return sum(s.calls for s in self.states.values())


def job(total_files, total_bytes, buckets=64):
    handle, work = Handle(), stateful.Progress(buckets, None)
    work.init(handle)
    work.handleInitialState(("j",), pd.DataFrame({"total_files": [total_files], "total_bytes": [total_bytes]}), None)

    def trigger(*parts):
        rows = (pd.DataFrame({"file_id": [f"f{i}" for i in p], "size": [1] * len(p)}) for p in parts)
        return [tuple(r.iloc[0])[1:] for r in work.handleInputRows(("j",), rows, None)]

    return handle, trigger


def test_small_jobs_go_to_the_state_a_few_times():
    handle, trigger = job(500, 500)
    assert trigger(range(400), range(400)) == [(400, 500, 400, 500, 80)]
    assert handle.calls() <= 7
    assert trigger(range(100, 450)) == [(450, 500, 450, 500, 90)] and trigger(range(450)) == []
    assert trigger(range(500), range(300)) == [(500, 500, 500, 500, 100)]
    assert not handle.states["seen"].value and handle.states["plan"].value is None and handle.states["done"].value is None
    assert trigger(range(500)) == []


def test_a_job_that_ends_in_its_first_trigger_writes_no_list():
    handle, trigger = job(500, 500)
    assert trigger(range(300), range(500)) == [(500, 500, 500, 500, 100)]
    assert handle.states["seen"].calls == 0 and handle.states["done"].calls == 1


@pytest.mark.parametrize("held", [50, 1 << 18])
def test_large_jobs_keep_their_lists_short_and_write_them_seldom(monkeypatch, held):
    monkeypatch.setattr(stateful, "HELD_FILES", held)
    handle, trigger = job(20_000, 20_000, buckets=16)
    parts = [range(at, at + 200) for at in range(0, 10_000, 100)]
    assert trigger(*parts) == [(10_100, 20_000, 10_100, 20_000, 50)]
    lists = handle.states["seen"].value
    assert len(lists) == 16 and sum(len(v[0]) for v in lists.values()) == 10_100
    if held > 10_100:
        assert handle.states["seen"].calls == 16
    assert trigger(range(20_100)) == [(20_100, 20_000, 20_100, 20_000, 100)]


def test_a_null_id_is_one_file_and_not_the_empty_name(spark):
    from backuplake.session import shared_path
    from backuplake.sources.sinks import batch_writer
    from backuplake.streaming.run import start

    schema, source, check, out = "job_id bigint, file_id string, size bigint", *(shared_path(spark, p) for p in ("files", "check", "out"))
    for row in ((1, None, 2), (1, "", 3), (1, None, 2), (1, "", 3)):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(source)
    plan = spark.createDataFrame([(1, 3, 10)], "job_id bigint, total_files bigint, total_bytes bigint")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    start(stateful.progress_until_done(stream, plan), "names" + out[-8:], batch_writer(out), check, "update", None).awaitTermination()
    got = spark.read.parquet(out).orderBy("batch_id").select("processed_files", "processed_bytes").collect()
    assert len(got) == 2 and tuple(got[-1]) == (2, 5)
