"""Sets of tables that are published whole or not at all.

Publishing has two phases. First every table is written under a staging name of
this attempt, ``<root>/_staging/<id>-<attempt>/<table>``, its rows are counted
as they are written, and the counts are compared with what the files hold. Then
one small table, ``<root>/<id>/manifest``, names the staged tables and their
counts; it is a single file, so it is there whole or not at all. Readers go
through the manifest and refuse an id without one, so a write that fails midway,
or that is still running, leaves nothing that can be read. Nothing is renamed,
which object stores could not do at once.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "table string, path string, n_rows long, id string, published_utc string"


class PublishError(ValueError):
    """A set of tables that is not published, or no longer holds what it did."""


@dataclass(frozen=True)
class Published:
    """Published tables: where each lies and how many rows it has."""

    spark: SparkSession
    id: str
    paths: dict[str, str]
    rows: dict[str, int]

    def table(self, name: str) -> DataFrame:
        if name not in self.paths:
            raise PublishError(f"{self.id} has no table {name!r}; it has {', '.join(sorted(self.paths))}")
        return self.spark.read.parquet(self.paths[name])

    def verify(self) -> Published:
        """Counts the rows of every table again (from the files' footers)."""
        for name, n in self.rows.items():
            found = self.table(name).count()
            if found != n:
                raise PublishError(f"table {name!r} of {self.id} has {found} rows, published were {n}")
        return self


def _manifest_path(root: str, id: str) -> str:
    return f"{root.rstrip('/')}/{id}/manifest"


def read_published(spark: SparkSession, root: str, id: str) -> Published:
    """The published tables; ``PublishError`` if that id is not published."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(_manifest_path(root, id)).collect()  # a row per table
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    if not rows:
        raise PublishError(f"{id} is not published under {root}")
    return Published(spark, id, {r.table: f"{root.rstrip('/')}/{r.path}" for r in rows}, {r.table: r.n_rows for r in rows})


class Publisher:
    """One attempt to publish a set of tables under an id."""

    def __init__(self, spark: SparkSession, root: str, id: str):
        self.spark, self.root, self.id = spark, root.rstrip("/"), id
        self.stage = f"_staging/{id}-{uuid.uuid4().hex[:8]}"
        self.rows: dict[str, int] = {}
        try:
            read_published(spark, root, id)
        except PublishError:
            return
        raise PublishError(f"{id} is already published; it is never overwritten")

    def stage_table(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        """Writes a table and returns it as read back."""
        watch, path = Observation(), f"{self.root}/{self.stage}/{name}"
        out = df.observe(watch, F.count(F.lit(1)).alias("n_written"))
        out.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        held = written.count()
        if held != watch.get["n_written"]:
            raise PublishError(f"table {name!r} holds {held} rows, written were {watch.get['n_written']}")
        self.rows[name] = held
        return written

    def publish(self) -> Published:
        now = _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        rows = [(name, f"{self.stage}/{name}", n, self.id, now) for name, n in self.rows.items()]
        (self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
         .write.mode("errorifexists").parquet(_manifest_path(self.root, self.id)))
        return read_published(self.spark, self.root, self.id)
