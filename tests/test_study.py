import math
import shutil
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import spark_partition_id

from pairfold.operators import distances, mds, metrics
from pairfold.operators import experiments as ex
from pairfold.plans.study import Study

SMALL = Study(num_subjects=(4,), trials_per_subject=(5,), images_per_trial=(8,), subjects_noise_scale=(0.0, 0.5), subjects_noise_df=(1, 5), reps=2)
N = 50


@pytest.fixture(scope="module")
def vectors(spark):
    return distances.make_embeddings(spark, N, 4, seed=3).cache()


@pytest.fixture(scope="module")
def observed(spark, vectors):
    return SMALL.observations(spark, vectors).cache()


def test_pairs_are_all_pairs(spark, vectors):
    v = {r["img"]: np.array(r["vec"], np.float64) for r in vectors.collect()}
    rows = distances.pairs(vectors, per_block=7).collect()
    assert len(rows) == N * (N - 1) // 2 == len({(r["i"], r["j"]) for r in rows})
    assert all(r["i"] < r["j"] and abs(np.linalg.norm(v[r["i"]] - v[r["j"]]) - r["d"]) < 1e-5 for r in rows)
    spread = distances.distance_spread(vectors, per_block=7).first()
    assert spread["pairs"] == len(rows) and abs(spread["sd"] - np.std([r["d"] for r in rows])) < 1e-9
    assert distances.pairs(vectors.where("img < 1")).count() == 0
    assert tuple(distances.distance_spread(vectors.where("img < 1")).first()) == (0, None) == tuple(distances.distance_spread(vectors.where("false")).first())


def test_vectors_are_sent_to_few_blocks(spark):
    """What is sent grows as the vectors do: each goes to at most 24 blocks, however many there are; ids that are not in a row, near copies and far-off vectors."""
    rng = np.random.default_rng(5)
    ids, x = rng.permutation(600) * 1000 - 300, rng.standard_normal((600, 3))
    x[50:90] = x[:40] + 1e-9 * rng.standard_normal((40, 3))
    x[90:120] = x[:30] + 1e6
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "img long, vec array<double>")
    sent = distances._block_pairs(rows, 2).groupBy("img").count().agg({"count": "max"}).first()[0]
    assert sent == distances.BLOCKS
    want = {(a, b): np.float32(np.sqrt(((x[m] - x[k]) ** 2).sum())) for k, a in enumerate(ids) for m, b in enumerate(ids) if a < b}
    got = {(r["i"], r["j"]): r["d"] for r in distances.pairs(rows, per_block=2).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-6 * want[k] for k in want)
    spread = distances.distance_spread(rows, per_block=2).first()
    assert spread["pairs"] == len(want) and abs(spread["sd"] / np.std(np.array([*want.values()], np.float64)) - 1) < 1e-9
    assert {tuple(r) for r in distances.id_pairs(rows, per_block=2).collect()} == want.keys()
    assert all(r["d"] == math.floor(float(got[r["i"], r["j"]]) * 1e3 + 0.5) / 1e3 for r in distances.pairs(rows, per_block=100, digits=3).limit(500).collect())


def test_spread_of_tiles(spark):
    """Blocks of several tiles with repeated ids across their edges, sent to one and to several blocks."""
    rng = np.random.default_rng(6)
    ids, x = np.sort(np.arange(700) // np.where(np.arange(700) < 400, 3, 1)), rng.standard_normal((700, 4))
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "img long, vec array<double>")
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[ids[:, None] < ids].astype(np.float32).astype(np.float64)
    for per_block in (1024, 100):
        spread = distances.distance_spread(rows, per_block).first()
        assert spread["pairs"] == len(gaps) and abs(spread["sd"] - gaps.std()) < 1e-12


def test_each_pair_of_blocks_is_a_partition(spark):
    """No partition has two pairs of blocks and none is empty; the vectors are sent once."""
    rows = distances.make_embeddings(spark, 200, 2)
    dealt = distances._block_pairs(rows, 20).select("turn", "lo", "hi", spark_partition_id().alias("at")).distinct().collect()
    assert len(dealt) == 55 == len({r["at"] for r in dealt}) == len({(r["lo"], r["hi"]) for r in dealt})
    assert all(r["at"] == r["turn"] and (r["turn"] >= 45) == (r["lo"] == r["hi"]) for r in dealt)
    assert _exchanges(distances.pairs(rows, 20)) == 1


def test_close_vectors_of_a_tile():
    """Copies, near copies, a far-off and a broken vector anywhere in a tile: distances are those by differences, and a few close pairs take no other form of the whole tile."""
    rng = np.random.default_rng(7)
    x, y = rng.standard_normal((300, 8)), rng.standard_normal((280, 8))
    y[[3, 90, 250]], y[200], x[5], y[7] = x[[200, 4, 131]], x[131] + 1e-9, 1e6, np.nan
    gaps = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    for tall, wide in ((256, 256), (64, 128), (1, 280)):
        got = np.full(gaps.shape, -1.0)
        for own, at, d in distances._tiles(x, y, False, tall, wide):
            got[own, at] = d
        np.testing.assert_allclose(got, gaps, rtol=1e-9, atol=1e-15)
    a, b = rng.standard_normal((2, 256, 8))
    b[40] = a[170]
    tracemalloc.start()
    tiles = distances._tiles(a, b, False, 256, 256)
    assert next(tiles)[2][170, 40] == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 256 * 256 * 8  # the tile's own buffer and little else


def test_spread_is_worked_out_once(spark, vectors):
    """The plan of observations has the spread as a number, however often it is read; it is that of the lazy row."""
    plan = SMALL.observations(spark, vectors)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan
    assert tuple(distances.known_spread(vectors).first()) == tuple(distances.distance_spread(vectors).first())
    assert tuple(distances.known_spread(vectors.where("img < 1")).first()) == (0, None)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_forms_of_distances_are_not_sent(spark):
    """Square and condensed forms and their comparison take no exchange beyond that of the vectors, and no join."""
    from pairfold.plans import queries

    for name in ("asymmetric_pairs", "square_view", "condensed_view", "gt_distances"):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert _exchanges(df) == 1 and "Join" not in df._jdf.queryExecution().executedPlan().toString(), name


def test_square_form_comes_in_runs(spark):
    """Both entries of every pair, those of one side of the diagonal tile after tile, so that ids stay the same from row to row."""
    from pairfold.plans import queries

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.square_view(spark, d).collect()]
    assert sorted(rows) == sorted(map(tuple, distances.square(queries.gt_distances(spark, d)).collect()))
    assert sum(a[0] != b[0] and a[1] != b[1] for a, b in zip(rows, rows[1:], strict=False)) < len(rows) / 100


def test_paired_forms_are_those_of_the_square(spark):
    """Missing, differing and null entries: a form made of pairs is the one that the square's rows give."""
    rows = spark.createDataFrame([(0, 1, 2.0, 2.0, True), (0, 2, 3.0, 4.0, True), (1, 2, None, None, True), (1, 3, 5.0, None, True), (2, 3, 6.0, 6.0, False)], "i int, j int, d double, m double, there boolean")
    entries = rows.select("i", "j", "d").union(rows.where("there").selectExpr("j", "i", "m"))
    form = distances.paired(rows, "d", rows["m"], rows["there"])
    assert sorted(map(str, form.collect())) == sorted(map(str, distances.mirrored(entries).collect()))
    want = {(0, 2), (2, 0), (1, 3), (3, 1), (2, 3)}
    assert {tuple(r) for r in distances.asymmetric_of(form).collect()} == want == {tuple(r) for r in distances.asymmetric(entries).collect()}
    with pytest.raises(Exception, match="not symmetric"):
        distances.condensed_of(form.where("i = 1 and j = 3")).collect()


def test_only_uneven_entries_become_rows(spark):
    """Mirrored entries that differ, are missing or have no number, of one and of several blocks: the entries that the form as rows gives."""
    rng = np.random.default_rng(8)
    ids, x = rng.permutation(40) * 3 - 50, rng.standard_normal((40, 3))
    x[7, 1] = math.nan
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "img long, vec array<double>")
    for per_block in (9, 100):
        rows = distances.pairs(vectors, per_block)
        total = rows["i"] + rows["j"]
        form = distances.paired(rows, "d", F.when(total % 5 == 0, rows["d"] * 2).when(total % 11 == 0, math.nan).otherwise(rows["d"]), total % 3 != 0)
        want = sorted(map(tuple, distances.asymmetric_of(form).collect()))
        mirror = lambda i, j, v: np.where((i + j) % 5 == 0, v * 2, np.where((i + j) % 11 == 0, np.float32(math.nan), v))
        assert sorted(map(tuple, distances.uneven_pairs(vectors, mirror, lambda i, j: (i + j) % 3 != 0, per_block).collect())) == want
    from pairfold.plans import queries

    plan = queries.asymmetric_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert " d#" not in plan and plan.count("Generate") == 1, "pairs leave the kernel with their distances"  # vectors are dealt out by one


def test_numbering(spark):
    ids = [5, 4096, -3, 10**12, 4095, 17, 4097]
    rows = distances.numbered(spark.createDataFrame([(i,) for i in ids], "img long")).collect()
    assert {r["img"]: r["place"] for r in rows} == {i: k for k, i in enumerate(sorted(ids))}


def test_trials_draw_without_replacement(spark, vectors):
    rows = ex.trial_selection(SMALL.experiments(spark), vectors).collect()
    trials = {}
    for r in rows:
        trials.setdefault((r["config"], r["rep"], r["subject"], r["trial"]), set()).add(r["img"])
    assert len(rows) == 8 * len(trials) and all(len(x) == 8 for x in trials.values())  # no image twice
    used = np.bincount([r["img"] for r in rows], minlength=N)
    assert used.min() > 0 and used.max() < 3 * len(rows) / N


def test_draws_are_keyed_by_parameters(spark, vectors):
    """The same parameters give the same draws at another place of another grid, and others give others."""
    other = Study(**{**SMALL.__dict__, "subjects_noise_df": (5, 7)})
    key = ["num_subjects", "subjects_noise_scale", "subjects_noise_df", "rep", "i", "j"]
    a, b = ({tuple(r[k] for k in key): r["dist_sum"] for r in s.observations(spark, vectors).join(s.grid(spark), "config").collect()} for s in (SMALL, other))
    shared = {k for k in a if k[2] == 5}
    assert shared == {k for k in b if k[2] == 5} and all(a[k] == b[k] or abs(a[k] - b[k]) < 1e-9 for k in shared)
    assert {k[3:] for k in a if k[2] == 1} != {k[3:] for k in a if k[2] == 5}


def test_trials_leave_images_out(spark, vectors):
    with pytest.raises(ValueError, match="leave images out"):
        ex.trial_selection(SMALL.experiments(spark), vectors.where("img < 8"))


def test_bad_sizes(spark):
    for n, d in ((0, 3), (3, 0)):
        with pytest.raises(ValueError):
            distances.make_embeddings(spark, n, d)


@pytest.mark.parametrize("bad", [(0, 1, 1, 0.0, 1), (1, 0, 1, 0.0, 1), (1, 1, 0, 0.0, 1), (1, 1, 1, -0.1, 1), (1, 1, 1, 0.0, 0)])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        ex.check_params(*bad)
    with pytest.raises(ValueError):
        ex.check_params(1, 1, 10, 0.0, 1, n_images=10)


def test_square_forms(spark):
    rows = spark.createDataFrame([(0, 1, 2.0), (0, 2, 3.0), (1, 2, None)], "i int, j int, d double")
    sq = distances.square(rows)
    assert sq.count() == 6
    assert sorted(map(tuple, distances.condensed(sq).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    odd = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.5), (1, 2, 1.0)], "i int, j int, d double")
    assert {tuple(r) for r in distances.asymmetric(odd).collect()} == {(0, 1), (1, 0), (1, 2)}
    with pytest.raises(Exception, match="not symmetric"):
        distances.condensed(odd).collect()


def test_coverage_identities(spark, vectors, observed):
    rows = metrics.coverage(observed, vectors).collect()
    assert len(rows) == 8
    exact = 4 * 5 * math.comb(8, 2) / math.comb(N, 2)
    for r in rows:
        assert r["num_images"] == N and r["num_pairs"] == math.comb(N, 2)
        assert abs(r["average_pair_obs"] - exact) < 1e-12
        assert r["num_connected_components"] >= 1 + round(N * (1 - r["img_coverage"] / 100))


def test_numbers_of_sparse_ids(spark):
    """Hashes over the whole range, a dense run with ids far off, repeated and null ids, one id, none."""
    rng = np.random.default_rng(3)
    far = [-(1 << 63), (1 << 63) - 1]
    for ids in (rng.integers(-(1 << 63), 1 << 63, 3000).tolist(), [*range(2000), *far], [5, 5, 7, None, 5], [9], [], far):
        got = distances.numbered(spark.createDataFrame([(i,) for i in ids], "img long")).collect()
        assert sorted((r["place"], r["img"]) for r in got) == list(enumerate(sorted(i for i in ids if i is not None)))


def test_noise_means(spark, vectors):
    spread = distances.distance_spread(vectors)
    sd = spread.first()["sd"]
    noises = ex.subject_noises(SMALL.experiments(spark), spread).groupBy("config", "rep").avg("noise").collect()
    scale = {r["config"]: r["subjects_noise_scale"] for r in SMALL.grid(spark).collect()}
    assert all(abs(r["avg(noise)"] - scale[r["config"]] * sd) < 1e-9 for r in noises)


def test_no_noise_gives_true_distances(spark, vectors, observed):
    true = {(r["i"], r["j"]): r["d"] for r in distances.pairs(vectors).collect()}
    silent = [r["config"] for r in SMALL.grid(spark).collect() if r["subjects_noise_scale"] == 0]
    means = metrics.mean_distances(observed.where(f"config in ({','.join(map(str, silent))})"))
    assert all(abs(r["mean_dist"] - true[r["i"], r["j"]]) < 1e-5 for r in means.collect())
    assert all(abs(r["r"] - 1) < 1e-9 for r in metrics.spearman(metrics.joint_pairs(means)).collect() if r["n"] > 2)


def test_fixture_coverage(spark):
    obs = spark.createDataFrame([(0, 0, 0, 1, 3.0, 2), (0, 0, 1, 2, 4.0, 1), (0, 0, 3, 4, None, 2)], "config int, rep int, i int, j int, dist_sum double, n_obs int")
    five = spark.range(5).withColumnRenamed("id", "img")
    r = metrics.coverage(obs, five).first()
    assert (r["average_pair_obs"], r["pair_coverage"], r["average_img_obs"], r["img_coverage"], r["num_connected_components"]) == (0.5, 30.0, 1.2, 100.0, 2)
    one = spark.createDataFrame([(0, 0), (7, 0)], "config int, rep int")
    got = {x["config"]: (x["n_components"], x["error"]) for x in mds.gate(mds.mask(obs), one, five).collect()}
    assert got == {0: (3, "The distance graph has 3 connected components."), 7: (5, "The distance graph has 5 connected components.")}


def test_rank_edges(spark):
    rows = [(0, 0, 1, k, 9, float(x), float(y)) for k, (x, y) in enumerate([(1, 2), (1, 3), (2, 5)])]
    rows += [(1, 0, 1, 0, 9, 1.0, 1.0), (2, 0, 1, 0, 9, 1.0, 4.0), (2, 0, 1, 1, 9, 1.0, 5.0)]
    joint = spark.createDataFrame(rows, "config int, rep1 int, rep2 int, i int, j int, x double, y double")
    got = {r["config"]: (r["n"], r["r"]) for r in metrics.spearman(joint).collect()}
    assert set(got) == {0, 2} and got[2] == (2, None)
    assert abs(got[0][1] - math.sqrt(0.75)) < 1e-12  # ranks 1.5, 1.5, 3 and 1, 2, 3


def listed(square):
    """The pairs i < j of a square form and their values."""
    i, j = np.triu_indices(len(square), 1)
    return i, j, square[i, j]


def smacof(d, w, *how, **more):
    """The solver on square forms."""
    i, j, values = listed(d)
    return mds.smacof(len(d), i, j, values, w[i, j], *how, **more)


def brute_smacof(d, w, ndim, max_iters, tol, x):
    """Majorization by the whole inverse on square forms, from a start."""
    n = len(d)
    w = np.where(d > 0, w, 0.0)
    delta = d * np.sqrt(n * (n - 1) / (w * d**2).sum())
    inverse = np.linalg.pinv(np.diag(w.sum(1)) - w)
    gaps = lambda x: np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    x = x * (w * delta * gaps(x)).sum() / (w * gaps(x) ** 2).sum()
    off = lambda x: (w * (delta - gaps(x)) ** 2).sum() / (n * (n - 1))
    for k in range(1, max_iters + 1):
        g = gaps(x)
        b = -np.divide(w * delta, g, out=np.zeros_like(g), where=g > 0)
        np.fill_diagonal(b, -(b.sum(1) - np.diag(b)))
        before, x = off(x), inverse @ (b @ x)
        if before - off(x) < tol:
            break
    return k, np.sqrt(off(x)), x


def brute_nonmetric(d, ndim, max_iters, tol, seed=42):
    """The non-metric start with all pairs."""
    n = len(d)
    i, j, values = listed(d)
    order = np.argsort(values, kind="stable")
    order = order[values[order] > 0]
    before, x = np.inf, np.random.default_rng(seed).standard_normal((n, ndim))
    for _ in range(max_iters):
        gaps = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
        wanted = gaps.copy()
        wanted[order] = mds.isotonic(gaps[order])
        wanted *= np.sqrt((gaps**2).sum() / (wanted**2).sum())
        stress = np.sqrt(((gaps - wanted) ** 2).sum() / (gaps**2).sum())
        if before - stress < tol:
            break
        before, b = stress, np.zeros((n, n))
        b[i, j] = -wanted / gaps
        b += b.T
        np.fill_diagonal(b, -b.sum(1))
        x = b @ x / n
    return x


def some_pairs(n, share, seed):
    """Noisy distances of points in space, a share of them observed, all points connected."""
    rng = np.random.default_rng(seed)
    y = rng.standard_normal((n, 4))
    d = np.sqrt(((y[:, None] - y) ** 2).sum(-1)) * np.exp(0.2 * rng.standard_normal((n, n)))
    w = np.triu(rng.random((n, n)) < share, 1).astype(float)
    w[np.arange(n - 1), np.arange(1, n)] = 1
    return np.triu(d, 1) + np.triu(d, 1).T, w + w.T


@pytest.mark.parametrize("share", [0.02, 0.2, 1.0])
def test_both_solvers_are_the_dense_one(share):
    d, w = some_pairs(120, share, 8)
    start = np.random.default_rng(1).standard_normal((120, 2))
    niter, stress, x = brute_smacof(d, w, 2, 60, 1e-9, start)
    for dense in (1000, 0):
        got = smacof(d, w, 2, 60, 1e-9, start, dense=dense)
        assert got[0] == niter and abs(got[1] - stress) < 1e-9 and np.abs(got[2] - x).max() < 1e-6


def test_sparse_start_is_the_dense_one():
    d, w = some_pairs(60, 0.3, 9)
    d = d * (w > 0)
    i, j, values = listed(d)
    assert np.abs(mds.nonmetric_start(60, i, j, values, 2, 25, 1e-6) - brute_nonmetric(d, 2, 25, 1e-6)).max() < 1e-9


def test_many_images_take_the_memory_of_their_pairs():
    """20,000 images of which 1 % of pairs were observed: a square form would be 3.2 GB."""
    n, rng = 20_000, np.random.default_rng(10)
    i, j = rng.integers(0, n, (2, 2_000_000))
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    y = rng.standard_normal((n, 2))
    d = mds.Pairs(n, i, j).gaps(y)
    tracemalloc.start()
    _, stress, x = mds.smacof(n, i, j, d, np.ones(len(d)), 2, 3, 0.0, y + 0.1 * rng.standard_normal(y.shape))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert stress < 0.1 and peak < 400e6


def test_smacof_recovers_a_configuration():
    x = np.random.default_rng(0).standard_normal((40, 3))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    w = np.ones_like(d) - np.eye(40)
    best = min(smacof(d, w, 3, seed=s)[1] for s in range(5, 9))
    assert best < 5e-3  # stress falls by less than the tolerance from there on
    niter, stress, _ = smacof(d, w, 2, seed=5)
    assert stress > 0.05 and niter > 1
    assert smacof(d, w, 3, start=x)[1] < 1e-6  # from the solution it stays there


def test_smacof_of_closed_forms():
    """A triangle of equal sides lies flat without stress; on a line, equal distances of three points have a known one."""
    d = np.ones((3, 3)) - np.eye(3)
    assert smacof(d, d, 2, tol=1e-12, seed=1)[1] < 1e-5
    # points at -a, 0, a: disparities 1, gaps a, a, 2a, best a = 2/3: raw stress 2 * (1/3)**2 + (1/3)**2 = 1/3 of 3 pairs
    assert abs(smacof(d, d, 1, tol=1e-12, seed=1)[1] - math.sqrt(1 / 9)) < 1e-6


def test_smacof_ends_where_stress_is_flat():
    rng = np.random.default_rng(2)
    d = np.sqrt(((y := rng.standard_normal((15, 4)))[:, None] - y) ** 2).sum(-1)
    w = np.triu(rng.random((15, 15)) < 0.7, 1).astype(float)
    w[np.arange(14), np.arange(1, 15)] = 1  # connected
    w += w.T
    _, stress, x = smacof(d, w, 2, max_iters=5000, tol=1e-14, seed=3)
    delta = np.where(w > 0, d, 0) * np.sqrt(15 * 14 / 2 / ((w * d**2).sum() / 2))

    def raw(x):
        gaps = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
        return (w * (delta - gaps) ** 2).sum() / 2 / (15 * 14 / 2)

    assert abs(raw(x) - stress**2) < 1e-9
    for i, k in ((0, 0), (7, 1), (14, 0)):
        step = np.zeros_like(x)
        step[i, k] = 1e-5
        assert abs(raw(x + step) - raw(x - step)) / 2e-5 < 1e-4


def test_isotonic():
    """Against the minimax form: the largest over starts of the smallest mean over ends."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 30):
        for v in (rng.standard_normal(n), rng.integers(0, 3, n).astype(float), np.arange(n, 0, -1.0)):
            want = [max(min(v[a : b + 1].mean() for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
            assert np.allclose(mds.isotonic(v), want)


def test_nonmetric_start(monkeypatch):
    x = np.random.default_rng(6).standard_normal((30, 2))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1)) ** 3  # only the order counts
    start = mds.nonmetric_start(30, *listed(d), 2, 50, 1e-6)
    gaps, upper = np.sqrt(((start[:, None] - start) ** 2).sum(-1)), np.triu_indices(30, 1)
    assert np.corrcoef(gaps[upper].argsort().argsort(), d[upper].argsort().argsort())[0, 1] > 0.9
    asked = []
    monkeypatch.setattr(mds, "nonmetric_start", lambda n, i, j, d, ndim, cap, tol: asked.append((cap, tol)) or 1 / 0)
    assert mds._start(30, *listed(d), 2, 1000, 1e-6) is None and mds._start(30, *listed(d), 2, 100, 0.1) is None  # so the start is random
    assert asked == [(50, 1e-6), (10, 1e-3)]


def test_scaling_sweep(spark):
    cloud = distances.make_embeddings(spark, 12, 3, seed=5)
    study = Study(num_subjects=(6,), trials_per_subject=(6,), images_per_trial=(6,), subjects_noise_scale=(0.0,), subjects_noise_df=(5,), reps=2)
    lone = Study(num_subjects=(1,), trials_per_subject=(1,), images_per_trial=(4,), subjects_noise_scale=(0.0,), subjects_noise_df=(5,), reps=1)
    from pairfold.plans.study import scaling_outcomes

    rows = scaling_outcomes(spark, cloud, study, max_dims=3).collect()
    assert len(rows) == 4 and all(r["error"] is None and len(r["confdist"]) == 66 for r in rows)
    assert all(r["stress"] < 0.01 for r in rows if r["ndim"] == 3)
    begun = mds.run_mds(mds.mask(study.observations(spark, cloud)), ex.mds_tasks(study.experiments(spark), 3).where("ndim = 3"), mds.gate(mds.mask(study.observations(spark, cloud)), study.experiments(spark), cloud))
    assert all(r["error"] is None and r["stress"] < 0.01 for r in begun.collect())
    stopped = scaling_outcomes(spark, cloud, lone, max_dims=2)
    assert [r["error"] for r in stopped.collect()] == ["The distance graph has 9 connected components."]
    assert [tuple(r) for r in mds.failure_counts(stopped, 500).collect()] == [("connected components", 1, 100.0)]


def _sweep_study(spark):
    cloud = distances.make_embeddings(spark, 12, 3, seed=5)
    study = Study(num_subjects=(6,), trials_per_subject=(6,), images_per_trial=(6,), subjects_noise_scale=(0.0,), subjects_noise_df=(5,), reps=2)
    return study.observations(spark, cloud), study.experiments(spark), cloud


def test_sweep_goes_on(spark, tmp_path, monkeypatch):
    """Tasks that the log has are not run again."""
    from pairfold.plans.study import sweep

    how = (str(tmp_path / "log"), *_sweep_study(spark))
    first = {(r["rep"], r["ndim"]): r["logged_at"] for r in sweep(spark, *how, 2).collect()}
    ran, run_mds = [], mds.run_mds
    monkeypatch.setattr(mds, "run_mds", lambda masked, tasks, *a, **b: ran.append(tasks.count()) or run_mds(masked, tasks, *a, **b))
    both = {(r["rep"], r["ndim"]): r["logged_at"] for r in sweep(spark, *how, 3).collect()}
    assert ran == [2] and len(both) == 4 and all(both[k] == t for k, t in first.items())
    assert not list((tmp_path / "log/_solved").iterdir())


def test_broken_sweep_keeps_what_was_solved(spark, tmp_path, monkeypatch):
    """The job fails at one task: the others' outcomes are in the log after the next sweep, which runs that one alone."""
    from pairfold.plans.study import sweep

    how = (str(tmp_path / "log"), *_sweep_study(spark))
    (tmp_path / "log/_solved/0-1-3.frames/in the way").mkdir(parents=True)  # so the executor can't put its record there
    with pytest.raises(Exception, match="0-1-3"):
        sweep(spark, *how, 3, claim_seconds=0)
    shutil.rmtree(tmp_path / "log/_solved/0-1-3.frames")
    left = sorted(p.name for p in (tmp_path / "log/_solved").glob("[0-9]*"))
    assert left and "0-1-3.frames" not in left
    (tmp_path / "log/_solved/0-0-2.frames").write_bytes(b"torn")  # whatever was there is run again
    ran, run_mds = [], mds.run_mds
    monkeypatch.setattr(mds, "run_mds", lambda masked, tasks, *a, **b: ran.extend(map(tuple, tasks.select("config", "rep", "ndim").collect())) or run_mds(masked, tasks, *a, **b))
    rows = sweep(spark, *how, 3, claim_seconds=0).collect()
    assert {(r["rep"], r["ndim"]) for r in rows} == {(a, b) for a in (0, 1) for b in (2, 3)} and all(r["error"] is None for r in rows)
    assert set(ran) == {(0, 0, 2), (0, 1, 3)} | {(0, a, b) for a in (0, 1) for b in (2, 3) if f"0-{a}-{b}.frames" not in left}


def test_sweep_leaves_claimed_tasks_and_ends_long_ones(spark, tmp_path):
    from pairfold.plans.study import sweep
    from pairfold.sources import frames

    log, *how = str(tmp_path / "log"), *_sweep_study(spark)
    assert frames.claim(f"{log}/_claims", "0-0-2", "another", 1e6)
    rows = sweep(spark, log, *how, 2, max_seconds=0.0).collect()
    assert [(r["rep"], r["error"]) for r in rows] == [(1, "TimeoutError: not at an end after 0 seconds")]
    assert [r["rep"] for r in sweep(spark, log, *how, 2, claim_seconds=0).where("error is null").collect()] == [0]


def test_status(spark):
    rows = [("The distance graph has 3 connected components.", None), ("singular matrix", None), (None, 500), (None, 73)]
    df = spark.createDataFrame(rows, "error string, niter int")
    assert [r[0] for r in df.select(mds.status(df.error, df.niter, 500)).collect()] == ["connected components", "singular matrix", "max_iters", "success"]


def test_stability_keeps_empty_configurations(spark):
    grid = SMALL.grid(spark)
    none = spark.createDataFrame([], "config int, rep1 int, rep2 int, n long, r double")
    rows = metrics.stability(none, grid).collect()
    assert len(rows) == 4 and all(r["r_mean"] is None for r in rows)
