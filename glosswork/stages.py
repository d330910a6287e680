"""Boundaries between the steps of an analysis: tables that are written once and read by later steps.

A step's plan then starts from a table, so plans stay small and nothing is computed twice, and a
lost executor costs no more than its own step.  Tables are Parquet, in the folder that the driver
and all executors share (spark.checkpoint.dir, else the context's checkpoint folder).
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scopes: contextvars.ContextVar[tuple] = contextvars.ContextVar("scopes", default=())


def folder(spark: SparkSession) -> str:
    """The shared folder.  A local run without one gets a temporary one that goes at exit; on a
    cluster that is an error, as each executor would write to its own disk."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have and (found := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        have = found.get()
    if not have:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="stages-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        have = "file://" + local
        spark.sparkContext.setCheckpointDir(have)
    return have.rstrip("/")


def write(df: DataFrame) -> DataFrame:
    """df as a table that is computed now.  It goes at the end of the scope that is open; without one it
    stays, for the results that read it, until release() or the folder is cleared."""
    spark = df.sparkSession
    path = f"{folder(spark)}/stage-{uuid.uuid4().hex}"
    open_ = _scopes.get()
    if open_:
        open_[-1].append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def write_by(df: DataFrame, column: str) -> DataFrame:
    """write(), in a folder for each value of a column, so that a filter on it reads no others."""
    parts = Chain(df.sparkSession, column, df.schema)
    parts.add(df)
    return parts.all()


class Chain:
    """A table that grows step by step, in a folder for each value of a column, which later steps read."""

    def __init__(self, spark: SparkSession, column: str, schema):
        self.spark, self.column, self.schema, self.steps = spark, column, schema, 0
        self.path = f"{folder(spark)}/stage-{uuid.uuid4().hex}"
        if open_ := _scopes.get():
            open_[-1].append((spark, self.path))

    def add(self, df: DataFrame) -> None:
        df.write.partitionBy(self.column).parquet(f"{self.path}/step={self.steps}")
        self.steps += 1

    def part(self, value, step="*") -> DataFrame:
        """The rows with a value of the column, of all steps or of one."""
        at = f"{self.path}/step={step}/{self.column}={value}"
        glob = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        if not len(glob.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(glob) or []):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(at).drop("step")

    def all(self) -> DataFrame:
        out = self.spark.read.schema(self.schema).parquet(self.path).drop("step")
        out.staged_at = self.path
        return out


def spread(df: DataFrame) -> DataFrame:
    """df with its rows dealt to all cores where it is small: less than a file split for each core,
    so that a scan would keep only some of them busy.  Larger and streaming inputs stay as they are."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < split * cores else df


@contextlib.contextmanager
def scope():
    """The tables written inside go at its end, also after an error, except those in the list that is given."""
    held, kept = [], []
    token = _scopes.set((*_scopes.get(), held))
    try:
        yield kept
    finally:
        _scopes.reset(token)
        stay = {df.staged_at for df in kept}
        outer = _scopes.get()
        for spark, path in held:
            if path not in stay:
                _delete(spark, path)
            elif outer:
                outer[-1].append((spark, path))


def release(df: DataFrame) -> None:
    """Deletes the table of write() or of a result, once nothing reads it any more; other rows have none."""
    if path := getattr(df, "staged_at", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
