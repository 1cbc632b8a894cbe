"""New files as they come: the incremental run of a step as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, path: str, suffix: str = ".xml", per_trigger: int = 1000) -> DataFrame:
    """``(path, content)`` of files that appear below ``path``; the source's log remembers what has been read."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return reader.option("pathGlobFilter", f"*{suffix}").option("maxFilesPerTrigger", per_trigger).load(path)


def run_step(files: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, item: Column | None = None, within: str | None = None) -> StreamingQuery:
    """Writes ``step`` of every new item to Parquet below ``out``, once; stops when nothing new is left.

    An item is a file of one name, wherever it lies, or what ``item`` makes of the columns of ``files``. The names of
    items that were done are keys of the state store, of which a batch asks for its own only, and the sink's log
    takes a batch once, also if it is run again after a failure; so nothing that was written before is read. Of items
    of one name within a batch one is taken. With ``within`` a name is forgotten that long after the newest
    ``modificationTime``, which bounds the state; without it, names are kept for ever. Rows with a null path are one item.
    """
    named = files.withColumn("_item", F.element_at(F.split("path", "/"), -1) if item is None else item)
    new = named.dropDuplicates(["_item"]) if within is None else named.withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["_item"])
    written = step(new.drop("_item")).writeStream.format("parquet").outputMode("append")
    return written.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_by_window(events: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts per window of time; events later than ``late`` behind the newest are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"))
