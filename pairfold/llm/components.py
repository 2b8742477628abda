"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.llm.common import attach, forget, save


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a < b; the result is saved."""
    if large:  # each larger neighbour of u goes to the smallest of u and its neighbours
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = pairs.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    else:  # u and its smaller neighbours go to the smallest
        pairs = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = pairs.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    low = save(low, "star")
    total = low.agg(F.sum("n")).first()[0] or 0
    joined = attach(pairs, low, "u", "n", total, F.col("v"))
    if large:
        out = joined.where("v > u").select(F.least("u", "low").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("low").alias("a"), F.col("v").alias("b")).union(low.select(F.col("low"), F.col("u")))
    out = save(out.where("a < b").distinct(), "edges")
    forget(low)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a long, b long) can reach, saved.

    Loops and repeated edges are ignored.  Neighbour lists are never gathered: a step needs the least neighbour alone,
    which is combined before the shuffle, and joins treat ids with very many neighbours apart.
    """
    now = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        mid = _step(now, large=True)
        new = _step(mid, large=False)
        forget(mid, now)
        now, before, seen = new, seen, mark(new)
        if seen == before:
            break
    out = save(now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select("a", "a").distinct()), "components")
    forget(now)
    return out
