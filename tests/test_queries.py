"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import pytest
from helpers import DATA, same_rows

from pairfold.plans import queries

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


def test_fit_has_every_task(spark):
    """An outcome for each task of the study over the images themselves, with the gate's errors as rows."""
    fit = {(r["config"], r["rep"], r["ndim"]): r["error"] for r in queries.QUERIES["mds_fit"](spark, SF).collect()}
    tasks = {(r["config"], r["rep"], r["ndim"]) for r in queries.QUERIES["mds_tasks"](spark, SF).collect()}
    gates = {(r["config"], r["rep"]): r["error"] for r in queries.QUERIES["mds_gate"](spark, SF).collect()}
    assert set(fit) == tasks and all(fit[k] == gates[k[:2]] for k in fit if gates[k[:2]])


def test_connected_study_is_scaled_to_the_end(spark):
    """Three repetitions, two numbers of dimensions: all end before their iterations do, and less stress with more dimensions."""
    n = queries.QUERIES["embedding_size"](spark, SF).first()["num_images"]
    rows = queries.QUERIES["mds_connected"](spark, SF).collect()
    assert sorted((r["rep"], r["ndim"]) for r in rows) == [(rep, k) for rep in range(3) for k in (2, 3)]
    assert all(r["error"] is None and r["pairs"] == n * (n - 1) // 2 and r["niter"] < 500 and r["needs_more_iters"] is False for r in rows)
    means = {k: sum(r["stress"] for r in rows if r["ndim"] == k) / 3 for k in (2, 3)}
    assert means[3] < means[2] < 0.5
    found = {r["ndim"]: r for r in queries.QUERIES["mds_connected_summary"](spark, SF).collect()}
    assert {k: (r["maps"], r["comparisons"]) for k, r in found.items()} == {2: (3, 3), 3: (3, 3)}
    assert all(abs(found[k]["stress_mean"] - means[k]) < 2e-4 and 0 < found[k]["r_mean"] < 1 for k in (2, 3))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 24
    assert set(e.oracle_sql()) <= set(e.queries())
