"""Distributed ranks, array correlations and quantiles against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest

from pairfold.operators import ranks


def _comparisons(rng):
    few = [(k, float(v), float(w)) for k in (1, 2) for v, w in zip(rng.integers(0, 6, 1500), rng.normal(size=1500).round(2), strict=True)]
    one = [(3, 7.0, float(v)) for v in rng.normal(size=400)]
    return [*few, *one, (None, 1.0, 2.0), (None, 3.0, 1.0), (4, None, 1.0), (5, -0.0, 1.0), (5, 0.0, 2.0), (5, float("nan"), 3.0), (5, float("nan"), 3.0)]


@pytest.mark.parametrize("per_part", [64, 700, 1 << 20])
def test_ranks(spark, per_part):
    """Ties over many ranges, a constant side, repeated rows, null keys and values, zeros of both signs, NaN as the largest."""
    rows = spark.createDataFrame(_comparisons(np.random.default_rng(1)), "k int, x double, y double")
    got = ranks.ranked(rows, ["k"], ["x", "y"], per_part).toPandas()
    want = pd.DataFrame([r for r in _comparisons(np.random.default_rng(1)) if r[1] is not None], columns=["k", "x", "y"]).fillna({"k": -1, "x": np.inf})
    want["rx"], want["ry"] = (want.groupby("k")[c].rank() for c in ("x", "y"))
    got = got.fillna({"k": -1, "x": np.inf})
    for df in (got, want):
        df["x"] += 0.0
    columns = ["k", "x", "y", "rx", "ry"]
    assert (got[columns].sort_values(columns).to_numpy() == want[columns].sort_values(columns).to_numpy()).all()


def test_ranks_of_sorted_values(spark):
    rows = spark.range(20_000).selectExpr("0 AS k", "double(id) AS x")
    placed = ranks.ranked(rows, ["k"], ["x"], 1000)
    got = placed.selectExpr("max(abs(rx - x - 1))", "count(*)").first()
    assert tuple(got) == (0.0, 20_000)


def test_no_rows(spark):
    none = spark.createDataFrame([], "k int, x double, y double")
    assert ranks.spearman(none, ["k"]).count() == 0
    assert ranks.describe(none, "x").first()["count"] == 0 and ranks.describe(none, "x").first()["q50"] is None


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_array_correlations(spark, block):
    """Arrays of one length, of several, with nulls, constant, of one element, empty, null, alone."""
    rng = np.random.default_rng(2)
    same = [(1, r, rng.integers(0, 20, 100).astype(float).tolist()) for r in range(4)]
    uneven = [(2, 0, rng.normal(size=30).tolist()), (2, 1, rng.normal(size=20).tolist()), (3, 0, [1.0, None, 3.0, 2.0]), (3, 1, [2.0, 5.0, None, 9.0])]
    rest = [(4, 0, [1.0, 1.0, 1.0]), (4, 1, [1.0, 2.0, 3.0]), (5, 0, [1.0]), (5, 1, [2.0]), (6, 0, []), (6, 1, []), (7, 0, None), (7, 1, [1.0, 2.0]), (8, 5, [1.0, 2.0])]
    all_rows = [*same, *uneven, *rest]
    found = ranks.array_correlations(spark.createDataFrame(all_rows, "g int, rep int, a array<float>"), ["g"], "rep", "a", block)
    got = {(r["g"], r["rep1"], r["rep2"]): (r["n"], r["r"]) for r in found.collect()}
    want = {}
    for g, r1, a in all_rows:
        for h, r2, b in all_rows:
            if g == h and r1 < r2 and a and b:
                both = pd.DataFrame([(x, y) for x, y in zip(a, b, strict=False) if x is not None and y is not None], columns=["x", "y"]).astype(np.float32).rank()
                r = both["x"].corr(both["y"]) if len(both) > 1 and both["x"].nunique() > 1 and both["y"].nunique() > 1 else None
                want[g, r1, r2] = (len(both), r)
    assert set(got) == set(want)
    for k, (n, r) in want.items():
        assert got[k][0] == n and (got[k][1] is None if r is None else abs(got[k][1] - r) < 1e-6), k


@pytest.mark.parametrize("held", [3, 50, 1 << 16])
@pytest.mark.parametrize("make", [lambda g: g.normal(size=5000), lambda g: g.integers(0, 2, 4001), lambda g: 10.0 ** g.integers(-300, 300, 3000), lambda g: np.full(99, 4.0), lambda g: [1.5, 2.5], lambda g: [3.0]])
def test_quartiles(spark, held, make):
    """Few values, many of them equal, spread over all magnitudes, all the same, one or two; nulls don't count."""
    values = [float(v) for v in make(np.random.default_rng(4))]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    got = ranks.describe(rows, "v", held).first()
    assert got["count"] == len(values) and (got["min"], got["max"]) == (min(values), max(values))
    assert np.allclose([got["q25"], got["q50"], got["q75"]], np.quantile(values, [0.25, 0.5, 0.75]), rtol=1e-12)


def test_places_with_a_coarse_sketch(spark):
    """With quantiles so coarse that many steps are needed, the values are the same."""
    values = np.random.default_rng(5).normal(size=4000).round(2)
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    places = [0, 17, 1999, 2000, 3999]
    assert ranks.at_places(rows, "v", len(values), places, accuracy=20, held=5) == {p: np.sort(values)[p] for p in places}


def test_ranges_are_few(spark, monkeypatch):
    """However small the ranges asked for are, there are at most 256 until they are full, so the driver gets no more of more rows."""
    parts, saved = [], ranks.saved

    def seen(df, name):
        out = saved(df, name)
        if name == "ranges":
            parts.append(out.select("_part").distinct().count())
        return out

    monkeypatch.setattr(ranks, "saved", seen)
    rows = spark.range(1200).selectExpr("id", "id % 2 AS k", "(id * 7919) % 300 AS x")
    got = {r["id"]: r["rx"] for r in ranks.ranked(rows, ["k"], ["x"], 2).collect()}
    x = np.array([(i * 7919) % 300 for i in range(1200)])
    for k in (0, 1):
        own = x[k::2]
        want = [(own < v).sum() + ((own == v).sum() + 1) / 2 for v in own]
        assert [got[i] for i in range(k, 1200, 2)] == want
    assert parts and max(parts) <= ranks.RANGES
