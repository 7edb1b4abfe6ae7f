"""Session settings and shared scratch storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Joins in this package carry no broadcast hint unless the hinted side is bounded by
# construction: Spark broadcasts a side whose measured size is under its threshold and
# otherwise sort-merges, splitting the partitions of hot keys.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM never compiles a method of more than 8000 bytecodes: past that, a stage over
    # dozens of columns runs faster as separate operators, whose code is split into methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Turn on the runtime re-planning the operators count on."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for `name` in the shared folder the session names.

    The folder is ``spark.checkpoint.dir``; where that is unset, the warehouse folder,
    which a session shares with its executors just as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/codonloom/{name}-{uuid.uuid4().hex}"


def side_by_side(spark: SparkSession, *builds: Callable, most: int | None = None) -> list:
    """Results of independent builders that run at the same time (at most `most`), as each has many small jobs of its own."""
    with ThreadPoolExecutor(max(1, min(len(builds), most or len(builds)))) as pool:
        # Each is wrapped by itself, or they would share one set of thread properties.
        started = [pool.submit(inheritable_thread_target(spark)(build)) for build in builds]
        return [future.result() for future in started]


class Scope:
    """Paths of the stages written since it was opened, which go when it ends."""

    def __init__(self, spark: SparkSession, outer: Scope | None):
        self.spark, self.outer, self.paths = spark, outer, []

    def keep(self, df: DataFrame, name: str = "kept") -> DataFrame:
        """`df` as a written table that outlives this scope and goes with the scope around it, if any."""
        token = _SCOPE.var.set(self.outer)
        try:
            return stage(df, name)
        finally:
            _SCOPE.var.reset(token)

    def drop(self) -> None:
        """Delete the stages written so far."""
        for path in self.paths:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.paths.clear()


class _Current:
    """The scope open in this thread of the driver; code that is sent to tasks finds none."""

    def __init__(self):
        self.var: ContextVar[Scope | None] = ContextVar("scope", default=None)

    def __reduce__(self):
        return _Current, ()


_SCOPE = _Current()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scope]:
    """A scope whose stages are deleted at its end: `keep` what is read afterwards.

    Frames are lazy, so whatever leaves the scope and still has to read one of its stages
    must be kept. Scopes may be nested.
    """
    scope = Scope(spark, _SCOPE.var.get())
    token = _SCOPE.var.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.var.reset(token)
        scope.drop()


def stage(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """Write `df` as Parquet on shared storage, with writer `options`, and continue from the written table.

    Inside a `scratch_scope` the table goes with the scope.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (scope := _SCOPE.var.get()) is not None:
        scope.paths.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
