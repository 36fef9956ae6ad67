"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# The scoring projections compile to large generated methods; HotSpot skips JIT
# for methods over 8000 bytecodes unless told otherwise, which leaves them
# interpreted (several times slower). Set the same on executors of a cluster.
JIT_OPTS = "-XX:-DontCompileHugeMethods"

# Settings the engine relies on; a cluster's own values win where already set.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Skip per-Column call-site capture (a JVM round trip per operator call).
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "creditspark") -> SparkSession:
    """A local session for tests and benchmarks (the UI stays off)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CREDITSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.extraJavaOptions", JIT_OPTS)
        .config("spark.executor.extraJavaOptions", JIT_OPTS)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir`` if set; otherwise, for a local
    master only (tests, benchmarks), a fresh scratch folder under /tmp. On a
    cluster a machine-local folder would not survive executor loss, so an unset
    checkpoint dir is an error there."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
    path = tempfile.mkdtemp(prefix="creditspark-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path
