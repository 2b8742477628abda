"""The outcome log as a file stream: batches that appear are folded into a table of the last outcome of each task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pairfold.sources.store import LOG, compact, exists, path_of


def follow(spark: SparkSession, log: str, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep ``table`` at the last outcome of each task in ``log``.

    Each micro-batch writes a new version from the last one and the batch, so a batch that runs again gives the same.  Versions
    before the last one are deleted when the new one is complete.
    """
    keys = ["config", "rep", "ndim"]

    def fold(batch: DataFrame, number: int) -> None:
        before = f"{table}/version={number - 1}"
        rows = batch.unionByName(spark.read.schema(LOG).parquet(before)) if number and exists(spark, before) else batch
        compact(rows, keys).select(*batch.columns).write.mode("overwrite").parquet(f"{table}/version={number}")
        for old in _versions(spark, table):
            if old < number - 1:
                fs, path = path_of(spark, f"{table}/version={old}")
                fs.delete(path, True)

    writer = spark.readStream.schema(LOG).parquet(log).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the versions that are complete, by their names alone."""
    fs, path = path_of(spark, f"{table}/version=*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName().partition("=")[2]) for s in fs.globStatus(path) or [])


def current(spark: SparkSession, table: str) -> DataFrame:
    """The latest version that ``follow`` wrote; no rows before the first."""
    found = _versions(spark, table)
    return spark.read.schema(LOG).parquet(f"{table}/version={found[-1]}") if found else spark.createDataFrame([], LOG)
