"""Replays of stored tables as streams, run to their end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from corvane.session import scratch

#: The state store that typed states and timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """RocksDB as the state store of the streams that are started inside; the session's own setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files under `path`, or the file that it is, as a stream of the same schema."""
    stored = spark.read.parquet(path)
    stream, (folder, _, name) = spark.readStream.schema(stored.schema), path.rstrip("/").rpartition("/")
    # A stream watches folders: a single file is its folder, seen through a filter.
    if [f.rpartition("/")[2] for f in stored.inputFiles()] == [name]:
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives until its source is used up, with `batch_id`, from files that each batch writes anew: a
    batch that is run again after a failure replaces what it wrote."""
    spark = stream.sparkSession
    out = scratch(spark, "stream")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch}")

    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/log").foreachBatch(write)
    with rocks(spark):
        query = writer.start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows")
