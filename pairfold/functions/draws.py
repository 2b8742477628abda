"""Random draws as pure functions of their keys, so results don't depend on partitioning.

A key joins a seed, the purpose of the draw and the ids it belongs to; the first 32 bits of its md5 are the uniform.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, purpose: str, *parts: Column | str) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def uniform(key: Column) -> Column:
    """In (0, 1)."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def normal(key: Column) -> Column:
    """Standard normal by Box and Muller."""
    u, v = uniform(F.concat(key, F.lit("|u"))), uniform(F.concat(key, F.lit("|v")))
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(F.lit(2 * 3.141592653589793) * v)


def abs_student_t(key: Column, df: Column) -> Column:
    """Absolute value of a Student-t draw with an integer number of degrees of freedom."""
    squares = F.aggregate(F.sequence(F.lit(1), df.cast("int")), F.lit(0.0), lambda s, k: s + F.pow(normal(F.concat_ws("|", key, k.cast("string"))), 2.0))
    return F.abs(normal(F.concat_ws("|", key, F.lit("0")))) / F.sqrt(squares / df)
