"""Coverage, connectivity, rank stability and their summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.functions.stats import sem
from pairfold.operators import ranks
from pairfold.operators.experiments import PARAMS

EXPERIMENT = ["config", "rep"]


def _images(embeddings: DataFrame) -> DataFrame:
    return embeddings.agg(F.count("*").alias("num_images"))


def pair_coverage(observations: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(config, rep, num_pairs, average_pair_obs, pair_coverage) from sums over observed pairs alone."""
    sums = observations.groupBy(*EXPERIMENT).agg(F.sum("n_obs").alias("obs"), F.count_if(F.col("n_obs") > 0).alias("seen"))
    pairs = (F.col("num_images") * (F.col("num_images") - 1) / F.lit(2)).cast("long")
    rows = sums.join(F.broadcast(_images(embeddings))).withColumn("num_pairs", pairs)
    return rows.select(*EXPERIMENT, "num_pairs", (F.col("obs") / F.col("num_pairs")).alias("average_pair_obs"), (100.0 * F.col("seen") / F.col("num_pairs")).alias("pair_coverage"))


def image_partners(observations: DataFrame) -> DataFrame:
    """(config, rep, img, partners): distinct images that each observed image was seen with."""
    seen = observations.where("n_obs > 0").select(*EXPERIMENT, F.explode(F.array("i", "j")).alias("img"))
    return seen.groupBy(*EXPERIMENT, "img").agg(F.count("*").alias("partners"))


def connected_components(edges: DataFrame, embeddings: DataFrame, keys: list[str] = EXPERIMENT) -> DataFrame:
    """(keys, num_connected_components) of the edges (keys, i, j) of each graph; every image without edges is one.

    An experiment's graph has at most as many edges as its trials have pairs, whatever the corpus, so each is united in
    one task; graphs are spread over tasks.  A graph without any edge has no row here.
    """

    def unite(pdf):
        nodes, at = np.unique(pdf[["i", "j"]].to_numpy().ravel(), return_inverse=True)
        at = at.reshape(-1, 2)
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[at[:, 0]], root[at[:, 1]])
            new = root.copy()
            np.minimum.at(new, at[:, 0], low)
            np.minimum.at(new, at[:, 1], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        out = pdf.iloc[:1][keys].copy()
        out["parts"], out["linked"] = len(np.unique(root)), len(nodes)
        return out

    slim = edges.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    found = slim.groupBy(*keys).applyInPandas(unite, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", parts long, linked long")
    return found.join(F.broadcast(_images(embeddings))).select(*keys, (F.col("parts") + F.col("num_images") - F.col("linked")).alias("num_connected_components"))


def coverage(observations: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row for each experiment: image and pair coverage and the number of connected components."""
    partners = image_partners(observations).groupBy(*EXPERIMENT).agg(F.sum("partners").alias("sum"), F.count("*").alias("seen"))
    of_images = partners.join(F.broadcast(_images(embeddings)))
    of_images = of_images.select(*EXPERIMENT, "num_images", (F.col("sum") / F.col("num_images")).alias("average_img_obs"), (100.0 * F.col("seen") / F.col("num_images")).alias("img_coverage"))
    parts = connected_components(observations.where("n_obs > 0"), embeddings)
    return of_images.join(pair_coverage(observations, embeddings), EXPERIMENT).join(parts, EXPERIMENT)


def coverage_summary(coverages: DataFrame, grid: DataFrame) -> DataFrame:
    """Means and standard errors of coverage and connectivity by subjects, trials and images, over noise settings and reps."""
    rows = coverages.join(F.broadcast(grid.select("config", *PARAMS)), "config").withColumn("connected", (F.col("num_connected_components") == 1).cast("int"))
    measures = {"percent_img_coverage": "img_coverage", "percent_pair_coverage": "pair_coverage", "p_is_connected": "connected"}
    aggs = [a for name, c in measures.items() for a in (F.avg(c).alias(f"{name}_mean"), sem(F.col(c)).alias(f"{name}_sem"))]
    by = [F.col("num_subjects").alias("n_subjects"), "trials_per_subject", "images_per_trial"]
    return rows.groupBy(*by).agg(F.count("*").alias("num_reps"), *aggs).orderBy("n_subjects", "trials_per_subject", "images_per_trial")


def mean_distances(observations: DataFrame) -> DataFrame:
    """(config, rep, i, j, mean_dist): null where nothing but zeros was observed."""
    return observations.select(*EXPERIMENT, "i", "j", F.try_divide("dist_sum", "n_obs").alias("mean_dist"))


def joint_pairs(means: DataFrame) -> DataFrame:
    """(config, rep1, rep2, i, j, x, y): pairs with a mean distance in both of two repetitions, rep1 < rep2."""
    known = means.where("mean_dist is not null")
    x = known.select("config", F.col("rep").alias("rep1"), "i", "j", F.col("mean_dist").alias("x"))
    y = known.select("config", F.col("rep").alias("rep2"), "i", "j", F.col("mean_dist").alias("y"))
    return x.join(y, ["config", "i", "j"]).where("rep1 < rep2").select("config", "rep1", "rep2", "i", "j", "x", "y")


def spearman(joint: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, r): rank correlations; comparisons of fewer than two pairs have no row, constant ones a null r."""
    return ranks.spearman(joint, keys or ["config", "rep1", "rep2"]).where("n >= 2")


def stability(correlations: DataFrame, grid: DataFrame) -> DataFrame:
    """(params, r_mean, r_sem): configurations without any correlation stay, with nulls."""
    means = correlations.groupBy("config").agg(F.avg("r").alias("r_mean"), sem(F.col("r")).alias("r_sem"))
    return grid.join(means, "config", "left").select(F.col("num_subjects").alias("n_subjects"), *PARAMS[1:], "r_mean", "r_sem")
