"""Aggregates that treat missing values as null."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def sem(x: Column) -> Column:
    """Standard error of the mean with ddof 1; null for one value."""
    return F.stddev_samp(x) / F.sqrt(F.count(x).cast("double"))


def percent(indicator: Column) -> Column:
    return 100.0 * F.avg(indicator.cast("double"))


def average_rank(value: str, *partition: str) -> Column:
    """Rank with ties at their mean."""
    ordered = Window.partitionBy(*partition).orderBy(value)
    ties = Window.partitionBy(*partition, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
