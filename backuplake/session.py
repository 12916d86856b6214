"""Session set-up and the shared folder that long plans are cut in."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "backuplake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword `conf` entries use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once per application.

    Workers started from another folder cannot import it otherwise. The driver's file server hands
    the archive out, so no shared folder is needed.
    """
    context = spark.sparkContext
    if getattr(context, "_backuplake_shipped", False):
        return
    top = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="backuplake-ship-")) / "backuplake.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._backuplake_shipped = True


def shared_root(spark: SparkSession) -> str:
    """Root of the folder every executor can reach.

    `spark.checkpoint.dir` wins. Only a local-mode session without it gets a temporary
    folder; on a cluster a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not configured:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            configured = tempfile.mkdtemp(prefix="backuplake-")
        context.setCheckpointDir(configured)
    return configured or current.get()


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared root; nothing is ever reused or cleared."""
    return f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def pin(df: DataFrame, purpose: str = "pin") -> DataFrame:
    """Writes the rows to the shared folder and reads them back.

    Cuts lineage and freezes sampled or tagged values; unlike a checkpoint, later steps read
    only the columns they need.
    """
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
