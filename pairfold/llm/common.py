"""Helpers shared by the training-data operators: shared tables and skew-safe lookups."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with at least 1/HOT_SHARE of all rows are hot, so there are at most HOT_SHARE of them.
HOT_SHARE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local one is made and put in the session if the master is local, that is if driver and
    executors are one process; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"shared-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which goes when the driver's JVM ends."""
    own = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    path, fs = _hadoop(spark, own)
    fs.mkdirs(path)  # what isn't there is not deleted
    fs.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def _hadoop(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def delete(spark: SparkSession, at: str) -> None:
    path, fs = _hadoop(spark, at)
    fs.delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables written by ``save`` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_saved_at", None)
        if path:
            delete(t.sparkSession, path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many "_" behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row per ``key``) that holds up when one key has a third of the rows.

    ``groups`` has the number of rows of each key in ``weight`` and should be a saved table, as it is read twice.  Keys
    with at least ``total / HOT_SHARE`` rows are at most HOT_SHARE, whatever the input, so those are broadcast; the other
    keys are joined by an ordinary shuffle, in which the rows of hot keys take part under a spread-out key that matches
    nothing.
    """
    cols = [c for c in groups.columns if c not in (key, weight)]
    is_hot = F.col(weight) * F.lit(HOT_SHARE) >= F.lit(max(1, int(total)))
    hot = groups.where(is_hot).select(F.col(key), F.lit(1).alias("_is_hot"), *[F.col(c).alias(f"_hot_{c}") for c in [weight, *cols]])
    rest = groups.where(~is_hot).select(F.col(key), F.lit(0).alias("_salt"), F.col(weight), *cols)
    marked = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_is_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int"))
    )
    out = marked.join(rest, [key, "_salt"], "left")
    for c in [weight, *cols]:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_hot_{c}"))).drop(f"_hot_{c}")
    return out.drop("_salt", "_is_hot")


def blocks(batches, columns: list[str], limit: int = 8 << 20):
    """Lists of the columns of Arrow batches, in blocks of at most about ``limit`` bytes of column data (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(n, int(n * limit / max(1, batch.nbytes))))
        for a in range(0, n, step):
            part = batch.slice(a, step)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
