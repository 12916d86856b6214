"""Feature, forecasting and anomaly-scoring queries. Where a result comes out of a trained
model, the query reports what must hold for any such model."""

from __future__ import annotations

from pyspark.sql import functions as F

from backuplake.functions import features as fx
from backuplake.ml import anomaly, isolation_forest, regressors, scoring
from backuplake.ml import features as mf
from backuplake.ml.store import ModelStore
from backuplake.plans.registry import query
from backuplake.session import pin, shared_path
from backuplake.sources import bindings as b

HEALTH = list(mf.HEALTH_FEATURES)


@query(
    "ml_01_standardise",
    "SELECT event_id, "
    + ", ".join(f"round(({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER (), 6) AS {m}" for m in HEALTH)
    + " FROM health",
    "ev health",
)
def ml_01(spark, d):
    rows = mf.standardise(b.health_metrics(spark, d), HEALTH)
    # Adding zero turns a rounded -0.0 into 0.0.
    return rows.select("event_id", *[(F.round(f"{m}_scaled", 6) + 0.0).alias(m) for m in HEALTH])


@query(
    "ml_02_min_max",
    """SELECT job_id, (size - lo) / (hi - lo)::DOUBLE AS scaled, size AS restored
       FROM jobs, (SELECT min(size) AS lo, max(size) AS hi FROM jobs)""",
    "jobs",
)
def ml_02(spark, d):
    jobs = b.jobs(spark, d)
    rows = jobs.join(F.broadcast(mf.range_of(jobs, "size")), F.lit(True), "left")
    bounds = (F.col("_least").cast("double"), F.col("_most").cast("double"))
    scaled = mf.to_unit(F.col("size"), *bounds)
    return rows.select(
        "job_id", scaled.alias("scaled"), F.round(mf.from_unit(scaled, *bounds)).cast("bigint").alias("restored")
    )


_META = (
    ["0.0::DOUBLE AS file_count", "size::DOUBLE AS total_size_bytes", "stored_size::DOUBLE AS compressed_size_bytes"]
    + [f"0.0::DOUBLE AS {n}" for n in mf.METADATA_BEFORE_TIME[3:5]]
    + ["duration::DOUBLE AS backup_duration_seconds", "0.0::DOUBLE AS throughput_mbps", 'hour(created_at)::DOUBLE AS "hour"']
    + ["(isodow(created_at) - 1)::DOUBLE AS day_of_week", "day(created_at)::DOUBLE AS day_of_month", 'month(created_at)::DOUBLE AS "month"']
    + [f"0.0::DOUBLE AS {n}" for n in mf.METADATA_AFTER_TIME]
)


@query("ml_03_metadata_features", f"SELECT job_id, {', '.join(_META)} FROM jobs", "jobs")
def ml_03(spark, d):
    """Fields a backup does not report are zero."""
    rows = b.jobs(spark, d).select(
        "job_id",
        F.col("size").alias("total_size_bytes"),
        F.col("stored_size").alias("compressed_size_bytes"),
        F.col("duration").alias("backup_duration_seconds"),
        F.col("created_at").alias("timestamp"),
    )
    return rows.select("job_id", *[c.alias(n) for n, c in mf.metadata_features(rows).items()])


@query(
    "ml_03_feature_vectors",
    """SELECT event_id, 15::BIGINT AS window_width, 5::BIGINT AS health_width, round(cpu_usage + memory_usage, 6) AS usage FROM health""",
    "ev health",
)
def ml_03v(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = b.health_metrics(spark, d)
    window = mf.window_features(rows)
    out = mf.assemble(mf.assemble(rows.withColumns(window), list(window), "window"), HEALTH, "health")
    health = vector_to_array("health")
    return out.select(
        "event_id",
        F.size(vector_to_array("window")).alias("window_width"),
        F.size(health).alias("health_width"),
        F.round(health[0] + health[1], 6).alias("usage"),
    )


_SPLIT = "CAST(('0x' || substr(md5('42:' || {}), 1, 8)) AS BIGINT) % 100 < 80"


@query(
    "ml_04_split",
    f"SELECT event_id, {_SPLIT.format('event_id')} AS is_train FROM ev",
    "ev",
)
def ml_04(spark, d):
    train, test = mf.split(b.events(spark, d).select("event_id"), F.col("event_id"))
    return train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))


def _runs(spark, d):
    rows = b.backup_training(spark, d)
    return rows.withColumn("run_key", F.concat_ws("-", "request_id", "device_id", F.col("file_count").cast("bigint")))


_RUN_KEY = "request_id || '-' || device_id || '-' || CAST(file_count AS BIGINT)"


@query(
    "ml_05_duration_regressor",
    f"""SELECT count(*) AS test_rows, TRUE AS floor_kept, TRUE AS explains FROM training WHERE NOT ({_SPLIT.format('(' + _RUN_KEY + ')')})""",
    "training",
)
def ml_05(spark, d):
    """Held-out runs: no duration under thirty seconds, and nine tenths of the variance explained."""
    train, test = mf.split(_runs(spark, d), F.col("run_key"))
    model = regressors.train_duration(train)
    scored = regressors.predict_duration(test, model, "run_key")
    error = F.avg(F.pow(F.col("predicted_duration") - F.col("backup_duration"), 2))
    return scored.agg(
        F.count(F.lit(1)).alias("test_rows"),
        (F.min("predicted_duration") >= 30).alias("floor_kept"),
        (1 - error / F.var_pop("backup_duration") > 0.9).alias("explains"),
    )


def _history(spark, d):
    """Hours of each tenant with load, activity, success and quality."""
    return b.hourly_scores(spark, d).select(
        "tenant_id",
        F.col("hour_ts").alias("timestamp"),
        (F.col("duration") / (F.col("n") * 100.0)).alias("system_load"),
        (F.col("n") / (F.col("n") + 5.0)).alias("user_activity"),
        F.col("quality_score").alias("backup_success_rate"),
        F.col("quality_score").alias("window_quality_score"),
    )


def _window_model(spark, d):
    key = F.concat_ws(":", "tenant_id", F.unix_timestamp("timestamp"))
    # Hours per tenant: small, and read by every fit and evaluation.
    return regressors.train_windows(pin(_history(spark, d), "history"), key)[0]


def _next_day(spark, d):
    """The 24 hours after each tenant's last event, with its latest state."""
    last = _history(spark, d).groupBy("tenant_id").agg(
        F.max_by(F.struct("system_load", "user_activity", "backup_success_rate"), "timestamp").alias("s"), F.max("timestamp").alias("at")
    )
    current = last.select("tenant_id", "s.*", (F.col("at") + F.expr("INTERVAL 1 HOUR")).alias("start"))
    return mf.horizon(current, F.col("start")).drop("start")


@query(
    "ml_06_window_ensemble",
    "SELECT tenant_id, 24::BIGINT AS hours, TRUE AS in_range FROM ev GROUP BY 1",
    "ev",
)
def ml_06(spark, d):
    model = _window_model(spark, d)
    scored = model.predict(_next_day(spark, d))
    return scored.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("hours"), F.bool_and(F.col("quality_score").between(-0.5, 1.5)).alias("in_range")
    )


@query(
    "ml_07_importances",
    """SELECT model, 15::BIGINT AS features, TRUE AS adds_up, 'backup_success_rate' AS strongest
       FROM (SELECT unnest(['random_forest', 'gradient_boosting']) AS model), (SELECT 1 FROM ev LIMIT 1)""",
    "ev",
)
def ml_07(spark, d):
    """The quality of an hour is its success rate here, so that feature must come first."""
    model = _window_model(spark, d)
    return model.importances(spark).groupBy("model").agg(
        F.count(F.lit(1)).alias("features"),
        (F.abs(F.sum("importance") - 1) < 1e-6).alias("adds_up"),
        F.max_by("feature", "importance").alias("strongest"),
    )


@query(
    "ml_08_fallback",
    """SELECT job_id, CASE WHEN estimated_duration IS NULL THEN 300.0 ELSE greatest(30.0::DOUBLE, estimated_duration::DOUBLE) END::DOUBLE AS predicted_duration,
       CASE WHEN estimated_duration IS NULL THEN 0.95 ELSE greatest(0.7::DOUBLE, least(0.99::DOUBLE, 1.0::DOUBLE - estimated_duration::DOUBLE / 3600.0::DOUBLE * 0.1::DOUBLE)) END::DOUBLE AS predicted_success_rate,
       CASE WHEN estimated_duration IS NULL THEN 0.3 ELSE 0.8 END::DOUBLE AS confidence FROM jobs""",
    "jobs",
)
def ml_08(spark, d):
    scored = b.jobs(spark, d).select("job_id", F.col("estimated_duration").cast("double").alias("raw_duration"))
    return regressors.with_fallback(scored, regressors.FAILED_CONFIDENCE)


def _forest(spark, d):
    readings = b.health_metrics(spark, d)
    return readings, isolation_forest.fit(readings, HEALTH, "event_id")


@query("ml_09_isolation_forest", "SELECT count(*) AS readings, TRUE AS tenth_flagged, TRUE AS flagged_are_far FROM health", "ev health")
def ml_09(spark, d):
    """A tenth is flagged, and flagged readings lie further from the mean than the others."""
    readings, forest = _forest(spark, d)
    scored = mf.standardise(forest.score(readings), HEALTH)
    far = sum((F.abs(f"{m}_scaled") for m in HEALTH), F.lit(0.0))
    flagged = F.col("is_anomaly")
    return scored.agg(
        F.count(F.lit(1)).alias("readings"),
        (F.count_if(flagged) / F.count(F.lit(1))).between(0.08, 0.12).alias("tenth_flagged"),
        (F.avg(F.when(flagged, far)) > F.avg(F.when(~flagged, far))).alias("flagged_are_far"),
    )


@query(
    "ml_10_tenant_distance",
    """WITH m AS (SELECT tenant_id, avg(size) AS sm, stddev_pop(size) AS ss, avg(duration) AS dm, stddev_pop(duration) AS ds FROM ev GROUP BY 1)
       SELECT event_id, round(1.0 / (1.0 + exp(-sqrt((((size - sm) / ss) ** 2 + ((duration - dm) / ds) ** 2) / 2))), 9) AS anomaly_score
       FROM ev JOIN m USING (tenant_id)""",
    "ev",
)
def ml_10(spark, d):
    rows = b.events(spark, d)
    metrics = ["size", "duration"]
    joined = rows.join(scoring.tenant_model(rows, ["tenant_id"], metrics), "tenant_id")
    return joined.select("event_id", F.round(fx.logistic(scoring.distance(metrics)), 9).alias("anomaly_score"))


@query(
    "ml_11_horizon",
    """SELECT tenant_id, unnest(generate_series(h + INTERVAL 1 HOUR, h + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS "timestamp"
       FROM (SELECT tenant_id, max(hour_ts) AS h FROM scores GROUP BY 1)""",
    "ev scores",
)
def ml_11(spark, d):
    return _next_day(spark, d).select("tenant_id", "timestamp")


_RUNS = """WITH m AS (SELECT device_id, date_trunc('hour', "timestamp") AS hour_ts,
      CAST(count(*) FILTER (backup_type <> 'error') AS DOUBLE) / count(*) AS q FROM ev GROUP BY ALL),
    i AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY hour_ts) AS n,
      lead(hour_ts) OVER (PARTITION BY device_id ORDER BY hour_ts) IS NULL AS last FROM m),
    g AS (SELECT *, epoch(hour_ts) / 3600 - row_number() OVER (PARTITION BY device_id ORDER BY hour_ts) AS run FROM i WHERE q > 0.7),
    r AS (SELECT device_id, min(hour_ts) AS start_time, round(avg(q), 9) AS avg_quality FROM g GROUP BY device_id, run
      HAVING count(*) >= 2 AND NOT bool_or(last))"""


@query(
    "ml_12_recommendation",
    _RUNS
    + """ SELECT d.device_id, CASE WHEN start_time IS NULL THEN 'schedule_fallback' ELSE 'schedule_backup' END AS action,
       coalesce(start_time, TIMESTAMP '2024-02-01 02:00:00') AS "at", avg_quality AS window_quality
       FROM (SELECT DISTINCT device_id FROM ev) d LEFT JOIN (SELECT * FROM r
         QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY avg_quality DESC, start_time) = 1) USING (device_id)""",
    "ev",
)
def ml_12(spark, d):
    ok = F.count_if(F.col("backup_type") != "error").cast("double")
    scores = b.events(spark, d).groupBy("device_id", F.date_trunc("hour", "timestamp").alias("hour_ts")).agg(
        (ok / F.count(F.lit(1))).alias("quality_score")
    )
    return regressors.recommend(scores, ["device_id"], F.lit("2024-02-01").cast("timestamp_ntz"))


@query(
    "ml_13_score_requests",
    f"""SELECT {_RUN_KEY} AS run_key, least(80.0::DOUBLE, file_count * 0.01::DOUBLE) AS cpu, least(90.0::DOUBLE, total_size / 1000000.0::DOUBLE) AS memory,
        least(100.0::DOUBLE, total_size / 100000.0::DOUBLE) AS network, total_size > 10000000 AS advises_compression, TRUE AS plausible FROM training""",
    "training",
)
def ml_13(spark, d):
    rows = _runs(spark, d)
    model = regressors.train_duration(mf.split(rows, F.col("run_key"))[0])
    scored = regressors.score_requests(rows.drop("backup_duration"), model, "run_key", F.lit("2024-02-01").cast("timestamp_ntz"))
    advice = F.array_contains("recommendations", "Enable compression to reduce transfer time")
    plausible = (
        (F.col("predicted_duration") >= 30) & F.col("predicted_success_rate").between(0.7, 0.99) & (F.col("confidence") == 0.8)
    )
    return scored.select(
        "run_key", "cpu", "memory", "network", advice.alias("advises_compression"), plausible.alias("plausible")
    )


@query(
    "ml_14_score_readings",
    "SELECT event_id, TRUE AS consistent FROM health",
    "ev health",
)
def ml_14(spark, d):
    """Exactly the flagged readings name two metrics, and advice only comes with a flag."""
    readings, forest = _forest(spark, d)
    scored = anomaly.score_health(readings, forest, readings)
    two = F.size("affected_metrics") == F.when(F.col("is_anomaly"), 2).otherwise(0)
    quiet = F.col("is_anomaly") | (F.size("recommendations") == 0)
    return scored.select("event_id", (two & quiet & (F.col("is_anomaly") == (F.col("anomaly_score") < 0))).alias("consistent"))


@query(
    "ml_15_reconstruction_error",
    """SELECT vec_id, FALSE AS is_corrupt, TRUE AS has_error FROM embeddings
       UNION ALL SELECT -1 - vec_id, TRUE, TRUE FROM embeddings""",
)
def ml_15(spark, d):
    """Vectors like the training data are rebuilt within the threshold; shifted and stretched copies are not."""
    vectors = b.read(spark, d, "embeddings").select("vec_id", "embedding")
    model = anomaly.train_corruption(vectors, "embedding")
    broken = F.transform("embedding", lambda x, i: x * 20 + F.when(i % 2 == 0, 30.0).otherwise(-30.0))
    planted = vectors.select((-1 - F.col("vec_id")).alias("vec_id"), broken.cast(vectors.schema["embedding"].dataType).alias("embedding"))
    out = anomaly.detect_corruption(vectors.unionByName(planted), "embedding", model)
    return out.select("vec_id", "is_corrupt", F.col("reconstruction_error").isNotNull().alias("has_error"))


@query("ml_16_model_store", "SELECT count(*) AS requests, 0::BIGINT AS changed FROM training", "training")
def ml_16(spark, d):
    """A stored model answers as the trained one did."""
    rows = _runs(spark, d)
    path = shared_path(spark, "duration-model")
    trained = regressors.train_duration(rows, trees=3, depth=5)
    regressors.save(trained, path)
    stored = regressors.load(path)
    both = stored.transform(trained.transform(rows).select(*rows.columns, F.col("raw_duration").alias("first")))
    return both.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("first") != F.col("raw_duration")).alias("changed")
    )


@query(
    "ml_16_load_or_train",
    f"""SELECT 'load_or_train' AS step, 1::BIGINT AS version, count(*) FILTER (request_id % 5 <> 0) AS trained_on, TRUE AS changed FROM training
        UNION ALL SELECT 'load_again', 1, count(*) FILTER (request_id % 5 <> 0), FALSE FROM training
        UNION ALL SELECT 'no_drift', 1, count(*) FILTER (request_id % 5 <> 0), FALSE FROM training
        UNION ALL SELECT 'drift', 2, count(*) FILTER (request_id % 5 <> 0 AND file_count > 200), TRUE FROM training""",
    "training",
)
def ml_16_versions(spark, d):
    """A first model, the same one loaded, retraining without need, and retraining once large backups take ten times as long."""
    rows, holdout = pin(_runs(spark, d), "runs"), F.col("request_id") % 5 == 0
    args = (lambda part: regressors.train_duration(part, trees=5, depth=5), "backup_duration", "raw_duration", holdout)
    store = ModelStore(spark, shared_path(spark, "models"), "duration")
    steps = [("load_or_train", store.load_or_train(rows, *args)[1], True), ("load_again", store.load_or_train(rows, *args)[1], False)]
    kept = store.retrain(rows, *args)
    slower = rows.filter("file_count > 200").withColumn("backup_duration", F.col("backup_duration") * 10)
    moved = store.retrain(slower, *args)
    steps += [("no_drift", kept.version, kept.drifted), ("drift", moved.version, moved.promoted)]
    return spark.createDataFrame([(s, v.number, v.rows, c) for s, v, c in steps], "step string, version bigint, trained_on bigint, changed boolean")
