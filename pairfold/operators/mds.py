"""Weighted metric multidimensional scaling (ratio scale) over tasks, with failures kept as data.

The solver is stress majorization (de Leeuw and Mair 2009; Borg and Groenen 2005): disparities are normalised so that
their weighted squares sum to n (n - 1) / 2, and coordinates follow the Guttman transform until stress falls by less than
the tolerance.  Tasks whose graph of weighted pairs is not connected never reach the solver.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairfold.functions.stats import sem
from pairfold.operators import ranks
from pairfold.operators.experiments import PARAMS
from pairfold.operators.metrics import EXPERIMENT, connected_components

OUTCOME = "niter int, stress double, confdist array<float>, error string"


def mask(observations: DataFrame) -> DataFrame:
    """(config, rep, i, j, d, w): mean distances, with weight 0 where a distance is missing or 0."""
    d = F.try_divide("dist_sum", "n_obs")
    w = F.when(d.isNull() | (d == 0), 0.0).otherwise((F.col("n_obs") > 0).cast("double"))
    return observations.select(*EXPERIMENT, "i", "j", d.alias("d"), w.alias("w"))


def gate(masked: DataFrame, experiments: DataFrame, images: DataFrame) -> DataFrame:
    """(config, rep, n_components, error) of every experiment; the error is null where the graph is connected."""
    parts = connected_components(masked.where("w > 0"), images).withColumnRenamed("num_connected_components", "n_components")
    n = images.agg(F.count("*").alias("n"))
    rows = experiments.select(*EXPERIMENT).join(parts, EXPERIMENT, "left").join(F.broadcast(n))
    rows = rows.select(*EXPERIMENT, F.coalesce("n_components", "n").alias("n_components"))
    text = F.format_string("The distance graph has %d connected components.", F.col("n_components"))
    return rows.withColumn("error", F.when(F.col("n_components") > 1, text))


def isotonic(values: np.ndarray) -> np.ndarray:
    """The rising sequence closest to ``values`` in squares: falling runs of block means are pooled until none falls."""
    start, mean = np.arange(len(values)), np.asarray(values, float)
    total = np.append(0.0, np.cumsum(mean))
    while len(mean) > 1 and (falls := np.diff(mean) < 0).any():
        start = start[np.append(True, ~falls)]
        ends = np.append(start[1:], len(values))
        mean = (total[ends] - total[start]) / (ends - start)
    return np.repeat(mean, np.diff(np.append(start, len(values))))


class Pairs:
    """Some pairs i < j of n points, worked through in blocks, so memory follows the pairs and not n squared."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, block: int = 1 << 18) -> None:
        self.n, self.i, self.j, self.block = n, i, j, block

    def blocks(self):
        for a in range(0, len(self.i), self.block):
            yield slice(a, a + self.block)

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """The distance of each pair."""
        out = np.empty(len(self.i))
        for s in self.blocks():
            d = x[self.i[s]] - x[self.j[s]]
            out[s] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return out

    def laplacian(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each point, the weighted sum of what it is away from the points that it makes pairs with."""
        out = np.zeros_like(x)
        for s in self.blocks():
            d = (x[self.i[s]] - x[self.j[s]]) * weights[s, None]
            for k in range(x.shape[1]):
                out[:, k] += np.bincount(self.i[s], d[:, k], self.n) - np.bincount(self.j[s], d[:, k], self.n)
        return out


class Square:
    """The same of all pairs of few points as square forms, which is faster where most pairs count."""

    def __init__(self, n: int) -> None:
        self.n = n

    def gaps(self, x: np.ndarray) -> np.ndarray:
        squares = (x**2).sum(1)
        out = x @ x.T
        out *= -2
        out += squares
        out += squares[:, None]
        np.maximum(out, 0, out)
        np.fill_diagonal(out, 0)
        return np.sqrt(out, out)

    def laplacian(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        return weights.sum(1)[:, None] * x - weights @ x

    def form(self, i: np.ndarray, j: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        out[i, j] = out[j, i] = values
        return out


def nonmetric_start(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, ndim: int, max_iters: int, tol: float, seed: int = 42) -> np.ndarray:
    """Coordinates by non-metric scaling from a random start; pairs that are not given take what the map has.

    What the other pairs add has closed forms: they pull each point to the centre, and their squared distances are those of
    all pairs less those of the given ones.
    """
    given = d > 0
    order = np.argsort(d[given], kind="stable")
    pairs = Pairs(n, i[given][order], j[given][order])
    before = np.inf
    x = np.random.default_rng(seed).standard_normal((n, ndim))
    for _ in range(max_iters):
        gaps = pairs.gaps(x)
        wanted = isotonic(gaps)
        every = max(n * (x**2).sum() - (x.sum(0) ** 2).sum(), 1e-300)
        rest = max(every - (gaps**2).sum(), 0.0)
        scale = np.sqrt(every / max(rest + (wanted**2).sum(), 1e-300))
        stress = np.sqrt((rest * (1 - scale) ** 2 + ((gaps - scale * wanted) ** 2).sum()) / every)
        if before - stress < tol:
            break
        before = stress
        more = np.divide(wanted, gaps, out=np.zeros_like(gaps), where=gaps > 0) - 1
        x = scale * (n * x - x.sum(0) + pairs.laplacian(more, x)) / n
    if not np.isfinite(x).all():
        raise FloatingPointError("the non-metric start has no finite coordinates")
    return x


#: Points up to which a scaling has square forms and the inverse of its matrix; beyond, pairs and steps solved by iteration.
DENSE = 2000


def _dense_solver(square: Square, w: np.ndarray):
    inverse = np.linalg.inv(np.diag(w.sum(1)) - w + 1 / square.n) - 1 / square.n
    return lambda b, x: inverse @ b


def _sparse_solver(pairs: Pairs, w: np.ndarray, tol: float = 1e-11, most: int = 2000):
    """Conjugate gradients with the points' sums of weights as preconditioner, for all dimensions at once, from the last map."""
    degree = (np.bincount(pairs.i, w, pairs.n) + np.bincount(pairs.j, w, pairs.n))[:, None]

    def solve(b: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = x - x.mean(0)
        r = b - pairs.laplacian(w, x)
        z = r / degree
        p, rz, enough = z, (r * z).sum(0), tol**2 * (b * b / degree).sum(0)
        for _ in range(most):
            if (rz <= enough).all():
                break
            q = pairs.laplacian(w, p)
            step = np.divide(rz, (p * q).sum(0), out=np.zeros_like(rz), where=rz > enough)
            x, r = x + step * p, r - step * q
            z = r / degree
            rz, last = (r * z).sum(0), rz
            p = z + np.divide(rz, last, out=np.zeros_like(rz), where=last > 0) * p
        return x - x.mean(0)

    return solve


def smacof(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, w: np.ndarray, ndim: int, max_iters: int = 1000, tol: float = 1e-6, start: np.ndarray | None = None, seed: int = 0, dense: int = DENSE, max_seconds: float | None = None):
    """(niter, stress, coordinates) of n points from the distances and weights of pairs i < j, whose graph must be connected.

    TimeoutError if it hasn't ended after ``max_seconds``.

    Pairs that are missing, 0 or without weight don't count.  Maps of more than ``dense`` points take memory by the pairs that do.
    """
    ends = np.inf if max_seconds is None else time.monotonic() + max_seconds
    use = np.isfinite(d) & (d > 0) & (w > 0)
    i, j, w, all_pairs = i[use], j[use], w[use].astype(float), n * (n - 1) / 2
    delta = d[use] * np.sqrt(all_pairs / max((w * d[use] ** 2).sum(), 1e-300))
    if n <= dense:
        pairs, all_pairs = Square(n), 2 * all_pairs  # square forms have every pair twice
        w, delta = pairs.form(i, j, w), pairs.form(i, j, delta)
        solve = _dense_solver(pairs, w)
    else:
        pairs = Pairs(n, i, j)
        solve = _sparse_solver(pairs, w)
    x = np.random.default_rng(seed).standard_normal((n, ndim)) if start is None else start.astype(float)
    pull = w * delta
    dist = pairs.gaps(x)
    scale = np.vdot(pull, dist) / max(np.vdot(w * dist, dist), 1e-300)
    x, dist = x * scale, dist * scale
    stress = np.vdot(w, (delta - dist) ** 2) / all_pairs
    niter = 0
    while niter < max_iters:
        if time.monotonic() > ends:
            raise TimeoutError(f"not at an end after {max_seconds:g} seconds")
        niter += 1
        ratio = np.divide(pull, dist, out=np.zeros_like(dist), where=dist > 0)
        x = solve(pairs.laplacian(ratio, x), x)
        dist = pairs.gaps(x)
        before, stress = stress, np.vdot(w, (delta - dist) ** 2) / all_pairs
        if before - stress < tol:
            break
    return niter, float(np.sqrt(stress)), x


#: Cap and tolerance of the start.
START_ITERS, START_SHARE, START_TOL = 50, 10, 1e-3


def _start(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, ndim: int, max_iters: int, tol: float) -> np.ndarray | None:
    """A non-metric start with a cap and a tolerance of its own, loose ones; None, so a random start, if it fails."""
    try:
        return nonmetric_start(n, i, j, d, ndim, min(START_ITERS, max_iters // START_SHARE), min(tol, START_TOL))
    except Exception:
        return None


def condensed_distances(x: np.ndarray) -> np.ndarray:
    """All distances of a map in the condensed order, to six decimals as single-precision numbers."""
    n = len(x)
    out, at = np.empty(n * (n - 1) // 2, np.float32), 0
    for k in range(n - 1):
        gaps = x[k + 1 :] - x[k]
        out[at : at + len(gaps)] = np.round(np.sqrt(np.einsum("ij,ij->i", gaps, gaps)), 6)
        at += len(gaps)
    return out


def _solver(keys: list[str], max_iters: int, tol: float, precalc_init: bool, seed: int, dense: int, max_seconds: float | None, claim: Callable | None, sink: Callable | None):
    def solve(pdf):
        nodes, at = np.unique(pdf[["i", "j"]].to_numpy().ravel(), return_inverse=True)
        at, n, ndim = at.reshape(-1, 2), len(nodes), int(pdf["ndim"].iloc[0])
        out = pdf.iloc[:1][keys].copy()
        task = tuple(int(out[k].iloc[0]) for k in keys)
        out["niter"], out["stress"], out["confdist"], out["error"] = None, None, None, None
        if claim and not claim(task):
            return out.iloc[:0].astype({"niter": "Int32", "stress": "float64"})
        try:
            i, j = at.min(1), at.max(1)
            d, w = pdf["d"].fillna(0.0).to_numpy(), pdf["w"].to_numpy()
            start = _start(n, i, j, d, ndim, max_iters, tol) if precalc_init else None
            own = zlib.crc32("|".join(str(out[k].iloc[0]) for k in keys).encode())
            niter, stress, x = smacof(n, i, j, d, w, ndim, max_iters, tol, start, seed ^ own, dense, max_seconds)
            out["niter"], out["stress"] = niter, stress
            out.at[out.index[0], "confdist"] = condensed_distances(x)
        except Exception as e:  # a failed task is a result of the sweep
            out["error"] = f"{type(e).__name__}: {e}"
        if sink:
            sink(task, *(out[c].iloc[0] for c in ("niter", "stress", "confdist", "error")))
        out["niter"] = out["niter"].astype("Int32")
        out["stress"] = out["stress"].astype("float64")
        return out

    return solve


def run_mds(masked: DataFrame, tasks: DataFrame, gates: DataFrame, max_iters: int = 500, tol: float = 1e-6, precalc_init: bool = True, seed: int = 42, dense: int = DENSE, max_seconds: float | None = None, claim: Callable | None = None, sink: Callable | None = None) -> DataFrame:
    """One row for each task (config, rep, ndim): niter, stress, confdist (condensed order of images), error, needs_more_iters.

    With ``precalc_init``, tasks begin with a short non-metric scaling, else, or if that fails, with random coordinates.

    A task that takes longer than ``max_seconds`` fails with that.  ``claim(task)`` is asked in the executor before a task is
    solved (if it says no, the task has no row), and ``sink(task, niter, stress, confdist, error)`` gets an outcome as soon as
    it is there; both must do no harm if a lost task runs again.

    A task is a group, so tasks are solved in parallel and a lost one alone is solved again.  Tasks that the gate stops
    get its error; any other failure of a task is its error too.
    """
    if max_iters <= 0 or tol < 0:
        raise ValueError("max_iters must be positive and tol non-negative")
    keys = [*EXPERIMENT, "ndim"]
    own = tasks.select(*keys).distinct()
    open_tasks = own.join(gates.where("error is null").select(*EXPERIMENT), EXPERIMENT)
    inputs = masked.join(open_tasks, EXPERIMENT).select(*keys, "i", "j", "d", "w")
    # few rows can be much work: an explicit number of partitions is one that adaptive execution doesn't coalesce
    inputs = inputs.repartition(4 * masked.sparkSession.sparkContext.defaultParallelism, *keys)
    solved = inputs.groupBy(*keys).applyInPandas(_solver(keys, max_iters, tol, precalc_init, seed, dense, max_seconds, claim, sink), f"config int, rep int, ndim int, {OUTCOME}")
    stopped = own.join(gates.where("error is not null"), EXPERIMENT)
    stopped = stopped.select(*keys, F.lit(None).cast("int").alias("niter"), F.lit(None).cast("double").alias("stress"), F.lit(None).cast("array<float>").alias("confdist"), "error")
    return solved.unionByName(stopped).withColumn("needs_more_iters", needs_more_iters(F.col("niter"), max_iters))


def needs_more_iters(niter: Column, max_iters: int) -> Column:
    """Whether a task used all its iterations; null for one that failed."""
    return niter >= max_iters


def status(error: Column, niter: Column, max_iters: int) -> Column:
    """"connected components", another error's text, "max_iters", or "success"."""
    return (
        F.when(F.contains(error, F.lit("connected components")), F.lit("connected components"))
        .when(error.isNotNull(), error)
        .when(niter == max_iters, F.lit("max_iters"))
        .otherwise(F.lit("success"))
    )


def failure_counts(outcomes: DataFrame, max_iters: int, by: list[str] | None = None) -> DataFrame:
    """(by, status, n, percent): outcomes by status, over all or within groups, with each one's share."""
    by = by or []
    counted = outcomes.groupBy(*by, status(F.col("error"), F.col("niter"), max_iters).alias("status")).agg(F.count("*").alias("n"))
    whole = counted.groupBy(*by).agg(F.sum("n").alias("all"))
    joined = counted.join(whole, by) if by else counted.join(F.broadcast(whole))
    return joined.select(*by, "status", "n", (100.0 * F.col("n") / F.col("all")).alias("percent"))


def successes(outcomes: DataFrame, max_iters: int) -> DataFrame:
    return outcomes.where(status(F.col("error"), F.col("niter"), max_iters) == "success")


def sorted_successes(outcomes: DataFrame, grid: DataFrame, max_iters: int) -> DataFrame:
    """(params, rep, ndim, niter, stress, confdist) of the tasks that succeeded, in the order of those seven keys."""
    order = ["trials_per_subject", "images_per_trial", "subjects_noise_scale", "subjects_noise_df", "num_subjects", "rep", "ndim"]
    rows = successes(outcomes, max_iters).join(F.broadcast(grid.select("config", *PARAMS)), "config")
    return rows.select(*order, "niter", "stress", "confdist").orderBy(*order)


def scree(outcomes: DataFrame, grid: DataFrame, max_iters: int) -> DataFrame:
    """(params, ndim, N, mean, sem) of stress over the repetitions that succeeded."""
    rows = successes(outcomes, max_iters).join(F.broadcast(grid.select("config", *PARAMS)), "config")
    return rows.groupBy(*PARAMS, "ndim").agg(F.count("stress").alias("N"), F.avg("stress").alias("mean"), sem(F.col("stress")).alias("sem")).orderBy(*PARAMS, "ndim")


def embedding_correlations(outcomes: DataFrame, max_iters: int) -> DataFrame:
    """(config, ndim, rep1, rep2, n, r): rank correlations of the configurations' distances between repetitions."""
    return ranks.array_correlations(successes(outcomes, max_iters), ["config", "ndim"], "rep", "confdist")


def embedding_stability(outcomes: DataFrame, grid: DataFrame, max_iters: int) -> DataFrame:
    """(params, ndim, N, r_mean, r_sem): groups with one repetition stay, with N 0 and nulls."""
    groups = successes(outcomes, max_iters).select("config", "ndim").distinct()
    means = embedding_correlations(outcomes, max_iters).groupBy("config", "ndim").agg(F.count("r").alias("N"), F.avg("r").alias("r_mean"), sem(F.col("r")).alias("r_sem"))
    rows = groups.join(means, ["config", "ndim"], "left").join(F.broadcast(grid.select("config", *PARAMS)), "config")
    return rows.select(*PARAMS, "ndim", F.coalesce("N", F.lit(0)).cast("long").alias("N"), "r_mean", "r_sem").orderBy(*PARAMS, "ndim")
