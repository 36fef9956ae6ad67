"""The folder that driver and executors share, and tables cut off from their lineage."""

from __future__ import annotations

import gc
import time
import uuid

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.session import ensure_checkpoint_dir
from creditspark.sources.scan import is_file_scan


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that ``folder`` named and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as computed once and kept in the shared folder, so that later
    uses neither compute it again nor depend on an executor's disk."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Seconds after which Python has told the JVM what it no longer refers to
# (py4j looks once a second).
TOLD_S = 1.05


def release(spark: SparkSession) -> None:
    """What nothing refers to any more, shuffles and checkpoints, leaves the disk
    now. Spark's cleaner follows the driver's garbage collection, which in a chain
    of large steps otherwise comes too late. Listeners keep the last query until
    the next one, so a small one goes before."""
    gc.collect()
    spark.range(1).collect()
    time.sleep(TOLD_S)
    spark.sparkContext._jvm.System.gc()


def compact(df: DataFrame, rows_per_part: int = 200_000) -> DataFrame:
    """``cut``, then as few partitions as its rows need: tables that a filter has
    made small do not go on in as many tasks as there are shuffle partitions."""
    kept = cut(df)
    parts = 1 + kept.count() // rows_per_part
    # Many small parts are written again as few, which each use then reads.
    return cut(kept.coalesce(parts)) if 4 * parts < kept.rdd.getNumPartitions() else kept


def fewer_tasks(df: DataFrame, task_bytes: int = 4 << 20) -> DataFrame:
    """``df`` in tasks of about ``task_bytes`` of what it reads, if it has more
    and smaller ones: for passes whose tasks each give a whole table of counts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes))
    return df.coalesce(parts) if parts < df.rdd.getNumPartitions() else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of a small table (under 200 bytes each) that may be broadcast.
MOST_BROADCAST = 1 << 17


def checked(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, kept, with a broadcast hint as long as it has ``most`` rows at
    most; a larger one is joined by a shuffle, whose hot partitions Spark splits."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, with underscores before those that are taken (in any case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of all columns of a row; maps, which have no order, as JSON."""
    def plain(field: T.StructField) -> Column:
        name = "`" + field.name.replace("`", "``") + "`"
        return F.to_json(F.struct(name)) if "map<" in field.dataType.simpleString() else F.col(name)

    return F.xxhash64(F.lit(seed), *[plain(f) for f in df.schema.fields])


def located(df: DataFrame) -> tuple[DataFrame, str, str]:
    """``df`` with two more columns, whose names are returned: the file and the
    row in it that each row stands at, the same in every attempt of a task. What
    is no scan of files is written to the shared folder first."""
    if not is_file_scan(df) or "Union" in df._jdf.queryExecution().analyzed().toString():
        path = folder(df.sparkSession, "rows")
        df.write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    file, row = free_names(df.columns, "file", "row")
    return df.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row)), file, row
