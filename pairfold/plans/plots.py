"""Plot-ready tables: one row for each mark of a figure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The figures' names of measures.
MEASURES = {"% IMG COVERAGE": "percent_img_coverage", "% PAIR COVERAGE": "percent_pair_coverage", "P[CONNECTED]": "p_is_connected"}


def coverage_long(summary: DataFrame) -> DataFrame:
    """(measure, images_per_trial, trials_per_subject, n_subjects, mean, sem)."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"{v}_mean").cast("double").alias("mean"), F.col(f"{v}_sem").cast("double").alias("sem")) for k, v in MEASURES.items()]))
    return summary.select(each.alias("m"), "images_per_trial", "trials_per_subject", "n_subjects").select("m.measure", "images_per_trial", "trials_per_subject", "n_subjects", "m.mean", "m.sem")


def _label(*extra):
    return F.concat(F.lit("Scale="), F.col("subjects_noise_scale").cast("string"), F.lit("<br>DFs="), F.col("subjects_noise_df").cast("string"), *extra)


def stability_long(stable: DataFrame) -> DataFrame:
    """(trials_per_subject, images_per_trial, series, n_subjects, mean, sem)."""
    return stable.select("trials_per_subject", "images_per_trial", _label().alias("series"), "n_subjects", F.col("r_mean").alias("mean"), F.col("r_sem").alias("sem"))


def scree_long(scree: DataFrame) -> DataFrame:
    """(trials_per_subject, images_per_trial, series, ndim, mean, sem); a missing error is 0."""
    n = F.concat(F.lit("<br>N="), F.col("num_subjects").cast("string"))
    return scree.select("trials_per_subject", "images_per_trial", _label(n).alias("series"), "ndim", "mean", F.coalesce("sem", F.lit(0.0)).alias("sem"))


def embedding_long(stable: DataFrame) -> DataFrame:
    """(trials_per_subject, images_per_trial, series, ndim, mean, sem); a missing error is 0."""
    n = F.concat(F.lit("<br>N="), F.col("num_subjects").cast("string"))
    return stable.select("trials_per_subject", "images_per_trial", _label(n).alias("series"), "ndim", F.col("r_mean").alias("mean"), F.coalesce("r_sem", F.lit(0.0)).alias("sem"))


def on_facets(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows with num_subjects and the noise settings, on every facet of the grid: facets without rows stay, with nulls."""
    return facets(grid).join(rows, ["num_subjects", "subjects_noise_scale", "subjects_noise_df"], "left")


def facets(grid: DataFrame) -> DataFrame:
    """Every combination of the distinct noise settings and subject counts, so that empty facets are kept."""
    noise = grid.select("subjects_noise_scale", "subjects_noise_df").distinct()
    return noise.join(grid.select("num_subjects").distinct()).select("num_subjects", "subjects_noise_scale", "subjects_noise_df")
