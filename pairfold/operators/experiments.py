"""Simulated arrangement experiments over a parameter grid, all configurations in one plan.

An experiment is a configuration (``config``: its place in a grid) and a repetition (``rep``).  All draws are functions of
the seed, the configuration's five parameters and the ids within the experiment, so any part of a study can be computed
again, alone, from another grid and on any partitioning.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairfold.functions.draws import abs_student_t, draw_key, normal, uniform
from pairfold.functions.stats import euclidean
from pairfold.operators import distances

PARAMS = ["num_subjects", "trials_per_subject", "images_per_trial", "subjects_noise_scale", "subjects_noise_df"]
GRID = "config int, num_subjects int, trials_per_subject int, images_per_trial int, subjects_noise_scale double, subjects_noise_df int"


def check_params(num_subjects: int, trials_per_subject: int, images_per_trial: int, subjects_noise_scale: float, subjects_noise_df: int, n_images: int | None = None) -> None:
    """Raises ValueError for parameters that no experiment can have."""
    for name, value in (("num_subjects", num_subjects), ("trials_per_subject", trials_per_subject), ("subjects_noise_df", subjects_noise_df)):
        if value <= 0:
            raise ValueError(f"an experiment needs {name} > 0, not {value}")
    if subjects_noise_scale < 0:
        raise ValueError(f"noise can't be scaled by {subjects_noise_scale}, as that is below 0")
    if images_per_trial <= 0:
        raise ValueError(f"a trial needs at least one image (got images_per_trial={images_per_trial})")
    if n_images is not None and images_per_trial >= n_images:
        raise ValueError(f"a trial must leave images out (got images_per_trial={images_per_trial} of {n_images} images)")


def param_grid(spark: SparkSession, num_subjects, trials_per_subject, images_per_trial, subjects_noise_scale, subjects_noise_df) -> DataFrame:
    """All combinations of the parameter values, numbered in their order (the last varies fastest)."""
    rows = list(product(num_subjects, trials_per_subject, images_per_trial, map(float, subjects_noise_scale), subjects_noise_df))
    for r in rows:
        check_params(*r)
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], GRID)


def repetitions(grid: DataFrame, reps: int) -> DataFrame:
    """One row for each experiment: the grid times repetitions 0..reps-1."""
    return grid.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def mds_tasks(experiments: DataFrame, max_dims: int) -> DataFrame:
    """One row for each experiment and number of dimensions from 2 to ``max_dims``."""
    return experiments.withColumn("ndim", F.explode(F.sequence(F.lit(2), F.lit(max_dims))))


def own_key() -> Column:
    """What tells an experiment's draws from those of all others: its parameters and repetition, not its place in a grid."""
    return F.concat_ws("|", *[F.col(p).cast("string") for p in [*PARAMS, "rep"]])


def trial_selection(experiments: DataFrame, embeddings: DataFrame, seed: int = 42) -> DataFrame:
    """(config, rep, subject, trial, img): the images of each trial, without replacement.

    Each trial draws k of the n images' places by Floyd's method: for j from n - k to n - 1, one place of 0..j, or j itself if
    that is drawn already.  So a trial costs k draws, and only what is drawn is joined with the images.  ValueError if a
    trial would have all images.
    """
    n = embeddings.count()
    most = experiments.agg(F.max("images_per_trial")).first()[0]
    if most is not None:
        check_params(1, 1, most, 0.0, 1, n)
    subjects = experiments.withColumn("subject", F.explode(F.expr("sequence(0, num_subjects - 1)")))
    trials = subjects.withColumn("trial", F.explode(F.expr("sequence(0, trials_per_subject - 1)"))).withColumn("own", own_key())

    def draw(chosen, j):
        place = F.floor(uniform(draw_key(seed, "trial", "own", "subject", "trial", j)) * (j + 1)).cast("long")
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, place), j).otherwise(place)))

    steps = F.sequence(F.lit(n) - F.col("images_per_trial"), F.lit(n - 1))
    places = F.aggregate(steps.cast("array<long>"), F.array().cast("array<long>"), draw)
    drawn = trials.select("config", "rep", "subject", "trial", F.explode(places).alias("place"))
    return drawn.join(distances.numbered(embeddings), "place").select("config", "rep", "subject", "trial", "img")


def trial_pairs(selection: DataFrame) -> DataFrame:
    """(config, rep, subject, trial, i, j): all pairs i < j within a trial, which has images_per_trial rows alone.

    A trial has images_per_trial - 1 times as many pairs as half its images, so trials are dealt out by an explicit number of
    partitions, which adaptive execution leaves as it is, however few bytes there are before.
    """
    keys = ["config", "rep", "subject", "trial"]
    spark = selection.sparkSession
    dealt = selection.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)
    x, y = dealt.withColumnRenamed("img", "i"), dealt.withColumnRenamed("img", "j")
    return x.join(y, keys).where("i < j").select(*keys, "i", "j")


def subject_noises(experiments: DataFrame, spread: DataFrame, seed: int = 42) -> DataFrame:
    """(config, rep, subject, noise, own): half-t draws, scaled so that their mean in an experiment is scale * sd of distances.

    ``spread`` is one row with ``sd``.  A scale of 0 gives 0 for all.  ``own`` is the experiment's key for draws.
    """
    rows = experiments.withColumn("subject", F.explode(F.expr("sequence(0, num_subjects - 1)"))).withColumn("own", own_key())
    raw = rows.withColumn("raw", abs_student_t(draw_key(seed, "subject", "own", "subject"), F.col("subjects_noise_df")))
    mean = F.avg("raw").over(Window.partitionBy("config", "rep"))
    target = F.col("subjects_noise_scale") * F.col("sd")
    noise = F.when(target == 0, 0.0).otherwise(target * F.col("raw") / mean)
    return raw.join(F.broadcast(spread.select("sd").limit(1))).select("config", "rep", "subject", noise.alias("noise"), "own")


def pair_observations(pairs: DataFrame, noises: DataFrame, embeddings: DataFrame, seed: int = 42) -> DataFrame:
    """(config, rep, i, j, dist_sum, n_obs): summed noisy distances of each observed pair, over subjects and trials.

    The vectors of a pair's images are looked up once a pair and experiment, with the errors of all its observations, so no
    table of all distances takes part.  Noisy distances are cut at 0; a sum of 0 is a missing distance (null), though the pair
    counts as observed.
    """
    error = F.when(F.col("noise") == 0, 0.0).otherwise(F.col("noise") * normal(draw_key(seed, "noise", "own", "subject", "trial", "i", "j")))
    rows = pairs.join(noises, ["config", "rep", "subject"]).groupBy("config", "rep", "i", "j").agg(F.collect_list(error).alias("errors"))
    v = embeddings.select("img", "vec")
    rows = rows.join(v.withColumnsRenamed({"img": "i", "vec": "x"}), "i").join(v.withColumnsRenamed({"img": "j", "vec": "y"}), "j")
    true = euclidean(F.col("x"), F.col("y")).cast("float").cast("double")
    # the distance is part of what the sum begins with, as a lambda would work it out for every error
    begin = F.struct(F.lit(0.0).alias("s"), true.alias("d"))
    add = lambda a, e: F.struct((a["s"] + F.greatest(F.lit(0.0), a["d"] + e)).alias("s"), a["d"].alias("d"))
    summed = rows.select("config", "rep", "i", "j", F.aggregate("errors", begin, add, lambda a: a["s"]).alias("s"), F.size("errors").alias("n_obs"))
    return summed.select("config", "rep", "i", "j", F.when(F.col("s") > 0, F.col("s")).alias("dist_sum"), "n_obs")


def simulate(experiments: DataFrame, embeddings: DataFrame, seed: int = 42, spread: DataFrame | None = None) -> DataFrame:
    """Pair observations of all experiments; ``spread`` is that of the embeddings, if it is known."""
    chosen = trial_pairs(trial_selection(experiments, embeddings, seed))
    spread = spread if spread is not None else distances.known_spread(embeddings)
    return pair_observations(chosen, subject_noises(experiments, spread, seed), embeddings, seed)


def missing_reps(requested: DataFrame, reps: int, existing: DataFrame) -> DataFrame:
    """Experiments that are asked for (the grid's configurations, ``reps`` times) and not among ``existing`` ones yet."""
    have = existing.select(*PARAMS, "rep").distinct()
    return repetitions(requested, reps).join(have, [*PARAMS, "rep"], "left_anti").select("config", *PARAMS, "rep")
