"""JSON documents in and out, and the string hash beyond ASCII."""

from pyspark.sql import functions as F

from backuplake.functions import features
from backuplake.sources import readers, sinks


def test_documents_of_arrays_over_many_lines(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("line\n\"quoted\" é "), F.col("id").cast("string")).alias("text"))
    df = df.withColumn("text", F.when(F.col("id") % 10 != 0, F.col("text")))
    path = str(tmp_path / "many")
    sinks.write_documents(df, path, rows=300)
    assert len(list((tmp_path / "many").glob("*.txt"))) == 4
    got = readers.training_set(spark, path, "id long, text string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_documents(df.limit(0), str(tmp_path / "none"))
    assert readers.training_set(spark, str(tmp_path / "none"), "id long, text string").count() == 0


def test_keys_in_a_pretty_printed_array(spark, tmp_path):
    (tmp_path / "keys.json").write_text('[\n  {"keyId": "a",\n   "deviceId": "d", "encryptedKey": "s"},\n  {"keyId": "b"}\n]\n')
    got = readers.key_registry(spark, str(tmp_path / "keys.json"))
    assert sorted(r.keyId for r in got.collect()) == ["a", "b"] and "encryptedKey" not in got.columns


def test_string_hash_counts_utf16_units(spark):
    texts = ["", "a", "plain/path-1", "é", "naïve.txt", "日本語", "😀", "x😀y" * 9]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", features.java_hash(F.col("t")).alias("h")).collect()
    for r in rows:
        h, data = 0, r.t.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = (31 * h + int.from_bytes(data[i : i + 2], "big")) % 2**32
        assert r.h == h - 2**32 * (h >= 2**31), r.t
