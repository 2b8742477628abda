"""Plans of a whole study, and stand-ins that read the driver's tables as images, paths and logs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfold.functions.draws import draw_key, uniform
from pairfold.operators import distances, mds
from pairfold.operators import experiments as ex
from pairfold.session import scratch
from pairfold.sources import frames, images, store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.col("embedding").alias("vec"))


@dataclass(frozen=True)
class Study:
    """A grid with its repetitions, over some images."""

    num_subjects: tuple = (4, 6)
    trials_per_subject: tuple = (5,)
    images_per_trial: tuple = (10,)
    subjects_noise_scale: tuple = (0.0, 0.5)
    subjects_noise_df: tuple = (1, 5)
    reps: int = 3
    seed: int = 42

    def grid(self, spark: SparkSession) -> DataFrame:
        return ex.param_grid(spark, self.num_subjects, self.trials_per_subject, self.images_per_trial, self.subjects_noise_scale, self.subjects_noise_df)

    def experiments(self, spark: SparkSession) -> DataFrame:
        return ex.repetitions(self.grid(spark), self.reps)

    def observations(self, spark: SparkSession, vectors: DataFrame) -> DataFrame:
        return ex.simulate(self.experiments(spark), vectors, self.seed)


MAIN = Study()
MAX_ITERS = 500
#: Trials so many and so large that up to some thousand images are connected.
CONNECTED = Study(num_subjects=(12,), trials_per_subject=(30,), images_per_trial=(80,), subjects_noise_scale=(0.5,), subjects_noise_df=(5,), reps=3)
#: Vectors of many independent dimensions go on gaining some 1e-6 of stress an iteration in a map of two or three for thousands of them.
CONNECTED_TOL = 1e-5


def create_simulation(spark: SparkSession, folder: str, n_images: int, n_dims: int, study: Study) -> str:
    """Simulate a study over drawn embeddings and write its snapshot; gives the snapshot's path."""
    for k in study.images_per_trial:
        ex.check_params(1, 1, k, 0.0, 1, n_images)
    vectors = distances.make_embeddings(spark, n_images, n_dims, study.seed)
    grid = F.broadcast(study.grid(spark))
    return store.write_snapshot(study.observations(spark, vectors).join(grid, "config").drop("config"), folder)


def scaling_outcomes(spark: SparkSession, vectors: DataFrame, study: Study = MAIN, max_dims: int | None = None, max_iters: int = MAX_ITERS, tol: float = 1e-6, precalc_init: bool = False) -> DataFrame:
    """Outcomes of the scaling sweep over a study: mask, gate, solver, failures as rows; up to the vectors' own dimensions if none are given."""
    max_dims = distances.size_of(vectors).first()["dimensions"] if max_dims is None else max_dims
    experiments, at = study.experiments(spark), scratch(spark, "observed")
    study.observations(spark, vectors).write.mode("overwrite").parquet(at)  # the gate and the solver read them
    masked = mds.mask(spark.read.parquet(at))
    gates = mds.gate(masked, experiments, vectors)
    return mds.run_mds(masked, ex.mds_tasks(experiments, max_dims), gates, max_iters, tol, precalc_init, study.seed)


def sweep(spark: SparkSession, log: str, observations: DataFrame, experiments: DataFrame, images: DataFrame, max_dims: int, max_iters: int = MAX_ITERS, seed: int = 42, precalc_init: bool = False,
          max_seconds: float | None = None, claim_seconds: float = 3600.0) -> DataFrame:
    """Run the scaling tasks that ``log`` lacks and give the log's outcomes.

    Each executor puts the outcome of a task in the folder ``_solved`` of the log, as a framed record, when the task is done:
    if the sweep is broken off, the next one goes on from what was solved, and only tasks under way are lost.  At its end, and
    at the next one's beginning, those records become a batch of the log.  Tasks that another sweep began less than
    ``claim_seconds`` ago are left to that one.  ``observations`` are read twice and should be those of a store.  The log must be in a folder that Arrow
    can write to from executors.
    """
    solved, claims, own = f"{log}/_solved", f"{log}/_claims", uuid.uuid4().hex
    name = "-".join
    keys = ["config", "rep", "ndim"]

    def fold() -> DataFrame:
        new = store.framed_outcomes(spark, solved).join(store.load_outcomes(spark, log).select(*keys), keys, "left_anti")
        names = [name(map(str, r)) for r in new.select(*keys).collect()]
        if names:
            store.append_outcomes(new, log)
            frames.delete(solved, names)
        return store.load_outcomes(spark, log)

    tasks = ex.mds_tasks(experiments.select("config", "rep"), max_dims).join(fold().select(*keys), keys, "left_anti")
    if not tasks.isEmpty():
        masked = mds.mask(observations)
        gates = mds.gate(masked, experiments, images)
        ask = lambda task: frames.claim(claims, name(map(str, task)), own, claim_seconds)
        put = lambda task, *outcome: frames.write_record(solved, name(map(str, task)), store.record_of(*task, *outcome))
        done = mds.run_mds(masked, tasks, gates, max_iters, precalc_init=precalc_init, seed=seed, max_seconds=max_seconds, claim=ask, sink=put)
        at = scratch(spark, "stopped")
        done.withColumn("confdist", F.lit(None).cast("array<float>")).drop("needs_more_iters").write.mode("overwrite").parquet(at)
        # what was solved has its record; the rest are the gate's errors
        stopped = spark.read.parquet(at).join(fold().select(*keys), keys, "left_anti")
        if not stopped.isEmpty():
            store.append_outcomes(stopped, log)
    return store.load_outcomes(spark, log)


def stand_in_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, height, width, n_channels): paths of three depths made from parts, customers and suppliers."""
    part = table(spark, sf_dir, "part").select(
        F.concat_ws("/", F.lit("inanimate"), F.when(F.col("p_size") < 25, "handmade").otherwise("natural"), F.col("p_brand"),
                    F.concat("p_name", F.lit(" "), F.when(F.col("p_size") == 1, "").otherwise(F.col("p_partkey").cast("string")), F.lit(".png"))).alias("path"),
        (F.col("p_size") * 10).alias("height"), (F.col("p_size") * 20).alias("width"),
        F.when(F.col("p_size") == 2, 1).when(F.col("p_size") == 3, F.lit(None)).when(F.col("p_size") > 40, 4).otherwise(3).cast("int").alias("n_channels"),
    )
    size = F.lit(64)
    nation = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"))
    customer = table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        F.concat_ws("/", F.lit(" animate "), F.when(F.col("n_regionkey") < 2, "animal").otherwise("human"), F.concat(F.lower("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit(".png"))).alias("path"),
        size.alias("height"), size.alias("width"), F.lit(3).alias("n_channels"),
    )
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("path"), size.alias("height"), size.alias("width"), F.lit(4).alias("n_channels"))
    return part.unionByName(customer).unionByName(supplier)


def stand_in_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.catalogue(stand_in_images(spark, sf_dir))


def stand_in_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes: (seq, user_id, event_type, niter, stress, error)."""
    error = F.when(F.col("event_type") != "error", F.lit(None)).when(F.col("value") < 20, "The distance graph has 3 connected components.").otherwise("singular matrix")
    niter = F.when(error.isNull(), F.least(F.floor(F.col("value") * 10), F.lit(MAX_ITERS))).cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type", niter.alias("niter"), F.when(error.isNull(), F.col("value")).alias("stress"), error.alias("error"))


def stand_in_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of scaling tasks (config, rep, ndim, niter, stress, confdist, error): the last event of each task.

    confdist has a drawn number for each of twelve pairs, part of it common to the repetitions.
    """
    at = F.col("seq")
    common, own = uniform(draw_key(MAIN.seed, "common", "config", "ndim", "k")), uniform(draw_key(MAIN.seed, "own", "seq", "k"))
    rows = stand_in_log(spark, sf_dir).select(
        "seq", F.pmod(at, F.lit(8)).cast("int").alias("config"), F.pmod(F.floor(at / 8), F.lit(3)).cast("int").alias("rep"),
        (2 + F.pmod(F.floor(at / 24), F.lit(9))).cast("int").alias("ndim"), "niter", "stress", "error",
    )
    last = store.compact(rows, ["config", "rep", "ndim"])
    long = last.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("v", F.round(common + own, 6).cast("float"))
    found = long.where("error is null").groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("confdist"))
    return last.join(found, "seq", "left").select("config", "rep", "ndim", "niter", "stress", "confdist", "error")
