"""Simulation snapshots, the result store with numbered commits, and the append log of scaling outcomes, as Parquet."""

from __future__ import annotations

import json
import struct
import uuid
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfold.operators import distances
from pairfold.operators import experiments as ex
from pairfold.sources import commits, frames

PREFIX, SUFFIX = "simulation_", ".parquet"
EXPERIMENTS = f"{ex.GRID.removeprefix('config int, ')}, rep int"
STORED = f"i long, j long, dist_sum double, n_obs int, run_at timestamp, {EXPERIMENTS}"
LOG = "seq long, config int, rep int, ndim int, niter int, stress double, confdist array<float>, error string, logged_at timestamp"


def path_of(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return fs.exists(p)


def snapshot_name(started: datetime) -> str:
    return f"{PREFIX}{started.strftime('%Y%m%d')}{SUFFIX}"


def date_key(name):
    """The text between the first "_" and the next "." of a file name."""
    return F.split(F.split(name, "_")[1], "[.]")[0]


def latest(names: DataFrame, column: str = "name", prefix: str = PREFIX, suffix: str = SUFFIX) -> DataFrame:
    """One row (name): the snapshot with the largest date key; ties go to the larger name, null without snapshots."""
    found = names.where(F.startswith(F.col(column), F.lit(prefix)) & F.endswith(F.col(column), F.lit(suffix)))
    return found.agg(F.max_by(F.col(column), F.struct(date_key(F.col(column)), F.col(column))).alias("name"))


def with_params(observations: DataFrame, grid: DataFrame) -> DataFrame:
    """Observations with their parameters in place of a grid's numbers."""
    return observations.join(F.broadcast(grid), "config").drop("config")


def write_snapshot(observations: DataFrame, folder: str, started: datetime | None = None) -> str:
    """Write pair observations with their parameters, partitioned by them, so reading one configuration prunes the rest.

    ``run_at`` says when.
    """
    started = started or datetime.now()
    path = f"{folder.rstrip('/')}/{snapshot_name(started)}"
    observations.withColumn("run_at", F.lit(started)).write.mode("overwrite").partitionBy(*ex.PARAMS).parquet(path)
    return path


def read_snapshot(spark: SparkSession, *path: str, base: str | None = None) -> DataFrame:
    types = {"subjects_noise_scale": "double"}
    df = spark.read.options(**({"basePath": base} if base else {})).parquet(*path)
    return df.select(*[F.col(c).cast(types.get(c, "int")).alias(c) if c in ex.PARAMS else F.col(c) for c in df.columns])


def load_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest snapshot of a folder; FileNotFoundError if it has none."""
    fs, p = path_of(spark, folder)
    names = [(s.getPath().getName(),) for s in fs.listStatus(p)] if fs.exists(p) else []
    name = latest(spark.createDataFrame(names, "name string")).first()["name"] if names else None
    if name is None:
        raise FileNotFoundError(f"no simulation in {folder}")
    return read_snapshot(spark, f"{folder.rstrip('/')}/{name}")


def load_or_create(spark: SparkSession, folder: str, create) -> DataFrame:
    """The latest snapshot, or what ``create()`` gives, written as today's."""
    try:
        return load_latest(spark, folder)
    except FileNotFoundError:
        return read_snapshot(spark, write_snapshot(create(), folder))


def rows_where(rows: DataFrame, **values) -> DataFrame:
    """The rows of a store, summary or outcome table whose columns have these values (null is a value)."""
    for name, value in values.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows


def get_experiment(store: DataFrame, **params) -> DataFrame:
    """The rows of one configuration; none if it was not run."""
    return rows_where(store, **{k: v for k, v in params.items() if k in ex.PARAMS})


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """All committed observations of a store, with their parameters; no rows before the first commit.

    A commit names its batch of files and the experiments that count in it, so what a writer left behind that never
    committed, or ran although another one was quicker, is not read.
    """
    found = commits.entries(spark, f"{store}/commits")
    if not found:
        return spark.createDataFrame([], STORED)
    counted = spark.createDataFrame([(e["batch"], *x) for _, e in found for x in e["experiments"]], f"batch string, {EXPERIMENTS}")
    paths = [f"{store}/data/batch={e['batch']}" for _, e in found if e["experiments"]]
    rows = read_snapshot(spark, *paths, base=f"{store}/data").withColumn("batch", F.col("batch").cast("string"))
    return rows.join(F.broadcast(counted), ["batch", *ex.PARAMS, "rep"], "left_semi").select(*[c.split()[0] for c in STORED.split(", ")])


def _keys(experiments: DataFrame) -> list[list]:
    """The experiments of a grid as lists (parameters, rep)."""
    return [list(r) for r in experiments.select(*ex.PARAMS, "rep").distinct().collect()]


def _run(spark: SparkSession, todo: DataFrame, embeddings: DataFrame, store: str, seed: int, spread: DataFrame | None = None) -> list[list]:
    """Simulate experiments (config, params, rep) and commit their observations, with the time, to a store.

    Gives those that this call committed: an experiment that another writer committed meanwhile is left to that one, whose
    observations are the same.
    """
    todo = todo.select("config", *ex.PARAMS, "rep")
    batch, own = f"b{uuid.uuid4().hex}", _keys(todo)
    new = ex.simulate(todo, embeddings, seed, spread).join(F.broadcast(todo), ["config", "rep"]).drop("config")
    new.withColumn("run_at", F.current_timestamp()).write.partitionBy(*ex.PARAMS).parquet(f"{store}/data/batch={batch}")
    counted: list[list] = []

    def decide(before: list[dict]) -> dict | None:
        nonlocal counted
        have = {tuple(x) for e in before for x in e["experiments"]}
        counted = [x for x in own if tuple(x) not in have]
        return {"batch": batch, "experiments": counted} if counted else None

    commits.commit(spark, f"{store}/commits", decide)
    return counted


def _of_grid(rows: DataFrame, grid: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(grid), ex.PARAMS).select("config", "rep", "i", "j", "dist_sum", "n_obs", *ex.PARAMS)


def run_experiment(spark: SparkSession, store: str, grid: DataFrame, embeddings: DataFrame, seed: int = 42, spread: DataFrame | None = None) -> DataFrame:
    """One more repetition of each configuration of ``grid``, committed to the store; gives its observations.

    A repetition's number is one more than the largest that the store has of its configuration, from 0 on.  Where another
    writer commits that repetition first, the next one is run.  ``spread`` is that of the embeddings, if it is known.
    """
    left, mine = grid, []
    spread = spread if spread is not None else distances.known_spread(embeddings)
    while True:
        have = [x for _, e in commits.entries(spark, f"{store}/commits") for x in e["experiments"]]
        last = spark.createDataFrame([tuple(x) for x in have], EXPERIMENTS).groupBy(*ex.PARAMS).agg(F.max("rep").alias("last"))
        todo = left.join(last, ex.PARAMS, "left").withColumn("rep", F.coalesce(F.col("last") + 1, F.lit(0)).cast("int")).drop("last")
        mine += _run(spark, todo, embeddings, store, seed, spread)
        done = spark.createDataFrame([tuple(x) for x in mine], EXPERIMENTS)
        left = grid.join(done, ex.PARAMS, "left_anti")
        if left.isEmpty():
            return _of_grid(read_store(spark, store).join(F.broadcast(done), [*ex.PARAMS, "rep"], "left_semi"), grid)


def get_or_run(spark: SparkSession, store: str, grid: DataFrame, embeddings: DataFrame, reps: int, seed: int = 42, spread: DataFrame | None = None) -> DataFrame:
    """Observations of ``reps`` repetitions of each configuration; those that the store lacks are run and committed.

    A configuration's draws depend on its parameters alone, so a repetition is the same whichever grid asked for it.  ``spread`` is that
    of the embeddings, if it is known.
    """
    have = [tuple(x) for _, e in commits.entries(spark, f"{store}/commits") for x in e["experiments"]]
    todo = ex.missing_reps(grid, reps, spark.createDataFrame(have, EXPERIMENTS))
    if not todo.isEmpty():
        _run(spark, todo, embeddings, store, seed, spread)
    return _of_grid(read_store(spark, store).where(F.col("rep") < reps), grid)


#: A batch of the log has at most so many files, so the places of its rows (2**33 for each file) stay below 2**44.
_FILES, _BATCH = 1024, 44


def append_outcomes(outcomes: DataFrame, path: str) -> None:
    """Append a batch of outcomes, with the time; ``seq`` is unique, and a batch that begins later has a larger one.

    The batch's number is reserved before its rows are written, so two writers never share one, and a batch that is
    broken off leaves a number unused.
    """
    spark = outcomes.sparkSession
    number = commits.commit(spark, f"{path}/_numbers", lambda before: {})
    at = F.monotonically_increasing_id() + F.lit(number << _BATCH)
    rows = outcomes.coalesce(_FILES).select(at.alias("seq"), *[F.col(c.split()[0]) for c in LOG.split(", ")[1:-1]], F.current_timestamp().alias("logged_at"))
    rows.write.mode("append").parquet(path)


def record_of(config: int, rep: int, ndim: int, niter, stress, confdist, error) -> bytes:
    """An outcome as the payload of a frame."""
    head = json.dumps([int(config), int(rep), int(ndim), None if niter is None else int(niter), None if stress is None else float(stress), error]).encode()
    return struct.pack("<I?", len(head), confdist is not None) + head + (b"" if confdist is None else np.asarray(confdist, "<f4").tobytes())


def framed_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """(config, rep, ndim, niter, stress, confdist, error) of the sound records of a folder of frames, one for each task."""

    def run(batches):
        for b in batches:
            rows = []
            for payload in b["payload"].to_pylist():
                size, known = struct.unpack_from("<I?", payload)
                numbers = np.frombuffer(payload, "<f4", offset=5 + size) if known else None
                rows.append((*json.loads(payload[5 : 5 + size]), numbers))
            config, rep, ndim, niter, stress, error, confdist = zip(*rows, strict=True) if rows else ((),) * 7
            ints = [pa.array(c, pa.int32()) for c in (config, rep, ndim, niter)]
            yield pa.record_batch([*ints, pa.array(stress, pa.float64()), pa.array(confdist, pa.list_(pa.float32())), pa.array(error, pa.string())], ["config", "rep", "ndim", "niter", "stress", "confdist", "error"])

    rows = frames.read_frames(spark, folder).mapInArrow(run, "config int, rep int, ndim int, niter int, stress double, confdist array<float>, error string")
    return rows.dropDuplicates(["config", "rep", "ndim"])


def compact(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The row of the largest ``seq`` of each key: one hash aggregation, no sort of the log."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("last"))
    return best.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def load_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The log's outcomes, the last one of each task; none if there is no log."""
    fs, p = path_of(spark, f"{path}/*.parquet")
    if not fs.globStatus(p):
        return spark.createDataFrame([], LOG)
    return compact(spark.read.schema(LOG).parquet(path), ["config", "rep", "ndim"])
