"""Cut lineage: tables that are written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str, str]] = []
_scope: list[str] = [""]


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local master gets a folder of its own; a cluster fails."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="citeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when its scope is released, or the driver ends."""
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    _written.append((spark, path, _scope[-1]))
    return path


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside send so many rows at most to Python at once, for rows of many kilobytes; the setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage; executors may be lost afterwards.

    ``batch_rows`` bounds the rows that Python functions in ``df`` get at once.
    """
    path = new_path(df.sparkSession)
    with arrow_rows(df.sparkSession, batch_rows) if batch_rows else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepared(df: DataFrame) -> DataFrame:
    """``df`` written, for what reads it several times; rows are dealt out first only where the input has fewer parts than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return materialize(df.repartition(cores) if df.rdd.getNumPartitions() < cores else df)


def dealt(df: DataFrame, *by: str, tasks: int = 4) -> DataFrame:
    """``df`` over so many tasks a core by the hash of columns, ahead of work in Python: small rows that cost much lie in few parts of their file."""
    return df.repartition(tasks * df.sparkSession.sparkContext.defaultParallelism, *by)


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables that are cut inside belong to ``name`` and go with ``release(name)``."""
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def release(name: str) -> None:
    """Remove the tables of a scope. Only for results that have been written: what still reads them fails."""
    for entry in [x for x in _written if x[2] == name]:
        _written.remove(entry)
        _delete(*entry[:2])


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for spark, path, _ in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: nothing can be asked of it any more
            return
