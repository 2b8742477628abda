"""Ranks, rank correlations and quantiles of any number of rows: no task or buffer holds a whole comparison."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairfold.functions.stats import average_rank, pearson
from pairfold.session import saved

#: Rows that one window partition may have; comparisons of more are cut into ranges of about as many.
PER_PART = 1 << 20
#: Ranges that rows are cut into at most until these hold PER_PART rows each: finding their borders sends some rows of each to the driver.
RANGES = 256


def ranked(rows: DataFrame, keys: list[str], values: list[str], per_part: int = PER_PART) -> DataFrame:
    """Rows with the average rank ``r<value>`` of each of the values among the rows of the same keys.

    Rows that lack one of the values are left out; keys may be null.  Comparisons of at most ``per_part`` rows are one window
    partition each.  If there is a larger one, rows are sorted into ranges instead, see ``_by_ranges``.
    """
    for v in values:
        rows = rows.where(F.col(v).isNotNull())
    known = saved(rows, "compared")
    largest = known.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    for v in values:
        if largest <= per_part:
            known = known.withColumn(f"r{v}", average_rank(v, *keys))
        else:
            known = _by_ranges(known, keys, v, f"r{v}", per_part)
    return known


def _by_ranges(rows: DataFrame, keys: list[str], value: str, to: str, per_part: int) -> DataFrame:
    """Average ranks by ranges of (keys, value, turn), so that equal values, too, are spread over as many ranges as they need.

    Ranks are counted within a range alone.  What lies before a range, and how often its first and last value are in others,
    comes from one row a range and comparison: the least count before a value is that of the first range that has it.
    """
    n = rows.count()
    parts = min(-(-n // per_part), max(RANGES, -(-n // PER_PART)))
    turned = rows.withColumn("_turn", F.monotonically_increasing_id())  # the rows are a saved table, so a lost task has the same turns
    cut = turned.repartitionByRange(parts, *keys, value, "_turn").drop("_turn").withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part", *keys)
    less, same = F.rank().over(own.orderBy(value)) - 1, F.count(F.lit(1)).over(Window.partitionBy("_part", *keys, value))
    placed = saved(cut.withColumn("_less", less.cast("long")).withColumn("_same", same), "ranges")

    ends = placed.groupBy("_part", *keys).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.min_by("_same", value).alias("lo_n"), F.max(value).alias("hi"), F.max_by("_same", value).alias("hi_n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.struct(F.col("lo").alias("v"), F.col("before").alias("less"), F.col("lo_n").alias("same"))
    last = F.struct(F.col("hi").alias("v"), (F.col("before") + F.col("n") - F.col("hi_n")).alias("less"), F.col("hi_n").alias("same"))
    marks = F.when(F.col("lo") == F.col("hi"), F.array(first)).otherwise(F.array(first, last))
    border = ends.withColumn("before", before).select("_part", *keys, "before", F.explode(marks).alias("at")).select("_part", *keys, "before", "at.*")
    among = Window.partitionBy(*keys, "v")
    border = border.withColumn("all_less", F.min("less").over(among)).withColumn("all_same", F.sum("same").over(among))
    by_value = F.map_from_entries(F.collect_list(F.struct("v", F.struct("all_less", "all_same"))))  # one or two values
    starts = border.groupBy("_part", *keys).agg(F.first("before").alias("_before"), by_value.alias("_marks"))

    starts = starts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before", "_marks")
    on = placed["_part"] == starts["_p"]
    for i, k in enumerate(keys):
        on &= placed[k].eqNullSafe(starts[f"_k{i}"])
    mark = F.try_element_at("_marks", F.col(value))
    rank = F.coalesce(mark["all_less"], F.col("_before") + F.col("_less")) + (F.coalesce(mark["all_same"], F.col("_same")) + 1) / F.lit(2.0)
    return placed.join(starts, on).select(*rows.columns, rank.alias(to))


def spearman(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y", per_part: int = PER_PART) -> DataFrame:
    """(keys, n, r): rank correlations; r is null where a side is constant."""
    found = ranked(rows.select(*keys, x, y), keys, [x, y], per_part)
    return found.groupBy(*keys).agg(F.count("*").alias("n"), pearson(F.col(f"r{x}"), F.col(f"r{y}")).alias("r"))


def _array_ranks(block: int):
    def run(table: pa.Table) -> pa.Table:
        """The ranks of an array around their mean, in blocks."""
        names = table.column_names[:-1]
        out = {k: [] for k in [*names, "block", "ranks"]}
        for row in range(table.num_rows):
            array = table.column(len(names))[row].values.to_numpy(zero_copy_only=False)
            _, at, n = np.unique(array, return_inverse=True, return_counts=True)
            ranks = (np.cumsum(n) - (n - 1) / 2 - (len(array) + 1) / 2)[at]
            for k in range(0, len(array), block):
                for name in names:
                    out[name].append(table[name][row].as_py())
                out["block"].append(k // block)
                out["ranks"].append(ranks[k : k + block].astype("<f8").tobytes())
        kinds = [*(table.schema.field(k).type for k in names), pa.int32(), pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return run


def _block_sums(keys: list[str], rep: str):
    def run(table: pa.Table) -> pa.Table:
        """Sums of squares and products of one block for every two repetitions."""
        reps = table[rep].to_numpy()
        order = np.argsort(reps, kind="stable")
        ranks = np.stack([np.frombuffer(table["ranks"][int(k)].as_py(), "<f8") for k in order])
        products = ranks @ ranks.T
        a, b = np.triu_indices(len(order), 1)
        a, b = a[reps[order][a] < reps[order][b]], b[reps[order][a] < reps[order][b]]
        own = {k: pa.array([table[k][0].as_py()] * len(a), table.schema.field(k).type) for k in keys}
        kind = table.schema.field(rep).type
        sums = {"xx": products[a, a], "yy": products[b, b], "xy": products[a, b]}
        return pa.table(own | {"rep1": pa.array(reps[order][a], kind), "rep2": pa.array(reps[order][b], kind), "n": np.full(len(a), ranks.shape[1], np.int64)} | sums)

    return run


def array_correlations(rows: DataFrame, keys: list[str], rep: str, array: str, block: int = 1 << 16) -> DataFrame:
    """(keys, rep1, rep2, n, r): rank correlations of the arrays of every two repetitions with the same keys, rep1 < rep2.

    An array is ranked once, in a task of its own, and its ranks are compared block by block: a task holds one block of every
    repetition, and arrays are shuffled, not their elements.  That needs arrays of one length without nulls.  Where the arrays
    of some keys differ in length or have nulls, the elements that both have are rows and are ranked for each comparison.
    Empty arrays have no row, nor have null ones; r is null where a side is constant.  A repetition has one array.
    """
    own = saved(rows.select(*keys, rep, array).where(F.col(array).isNotNull()), "arrays")
    shape = own.groupBy(*keys).agg(F.min(F.size(array)).alias("least"), F.max(F.size(array)).alias("most"), F.max(F.exists(array, lambda v: v.isNull())).alias("gaps"))
    shape = saved(shape.select(*keys, ((F.col("least") != F.col("most")) | F.col("gaps")).alias("uneven")), "shapes")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    of_keys = ", ".join(f"{k} {kinds[k]}" for k in keys)

    even = own.join(shape.where("not uneven"), keys, "left_semi").select(*keys, rep, array)
    ranks = even.groupBy(*keys, rep).applyInArrow(_array_ranks(block), f"{of_keys}, {rep} {kinds[rep]}, block int, ranks binary")
    sums = ranks.groupBy(*keys, "block").applyInArrow(_block_sums(keys, rep), f"{of_keys}, rep1 {kinds[rep]}, rep2 {kinds[rep]}, n long, xx double, yy double, xy double")
    found = sums.groupBy(*keys, "rep1", "rep2").agg(*[F.sum(c).alias(c) for c in ("n", "xx", "yy", "xy")])
    found = found.select(*keys, "rep1", "rep2", "n", F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")).alias("r"))
    if shape.where("uneven").isEmpty():
        return found

    long = own.join(shape.where("uneven"), keys, "left_semi").select(*keys, rep, F.posexplode(array).alias("place", "v"))
    x = long.select(*keys, F.col(rep).alias("rep1"), "place", F.col("v").alias("x"))
    y = long.select(*keys, F.col(rep).alias("rep2"), "place", F.col("v").alias("y"))
    return found.unionByName(spearman(x.join(y, [*keys, "place"]).where("rep1 < rep2"), [*keys, "rep1", "rep2"]))


def at_places(values: DataFrame, column: str, n: int, places: list[int], accuracy: int = 10_000, held: int = 1 << 16) -> dict[int, float]:
    """The values at some places, from 0, of the ``n`` values of a table in ascending order; the column has no nulls.

    A place is between two values that are known to be before and after it.  While more than ``held`` values are between
    them, quantiles with an error of n / ``accuracy`` on both sides of the place are counted exactly and take their place,
    which leaves about 1 in ``accuracy`` / 4 values; then the rest is sorted.  Each step is two passes with bounded buffers.
    """
    found: dict[int, float] = {}
    spans = {p: (None, None, 0, n) for p in places}  # exclusive ends, values before, values between

    def inside(low, high):
        v = F.col(column)
        return (F.lit(True) if low is None else v > low) & (F.lit(True) if high is None else v < high)

    while spans:
        few = sorted({s for s in spans.values() if s[3] <= held}, key=str)
        many = sorted({s for s in spans.values() if s[3] > held}, key=str)
        asked = [F.sort_array(F.collect_list(F.when(inside(*s[:2]), F.col(column)))) for s in few]
        for s in many:
            off = 2 * s[3] / accuracy
            shares = sorted({min(1.0, max(0.0, (p - s[2] + side) / s[3])) for p, at in spans.items() if at == s for side in (-off, off)})
            asked.append(F.percentile_approx(F.when(inside(*s[:2]), F.col(column)), shares, accuracy))
        got = values.agg(*[a.alias(f"a{k}") for k, a in enumerate(asked)]).first()
        for k, s in enumerate(few):
            found |= {p: got[k][p - s[2]] for p, at in spans.items() if at == s}
        spans = {p: s for p, s in spans.items() if p not in found}
        if not many:
            break
        tried = sorted({v for k in range(len(few), len(asked)) for v in got[k]})
        counts = values.agg(*[F.count_if(c).alias(f"c{k}") for k, c in enumerate(c for v in tried for c in (F.col(column) < v, F.col(column) == v))]).first()
        known = [(v, counts[2 * k], counts[2 * k + 1]) for k, v in enumerate(tried)]
        for p, (low, high, before, between) in list(spans.items()):
            after = before + between
            for v, less, same in known:
                if less <= p < less + same:
                    found[p] = v
                    del spans[p]
                    break
                if less + same <= p and less + same > before:
                    low, before = v, less + same
                elif p < less < after:
                    high, after = v, less
            else:
                spans[p] = (low, high, before, after - before)
    return found


def describe(rows: DataFrame, column: str, held: int = 1 << 16) -> DataFrame:
    """One row: count, mean, std (ddof 1), min, exact quartiles, max; nulls don't count, and without values the rest is null."""
    spark = rows.sparkSession
    own = saved(rows.select(F.col(column).cast("double").alias("v")).where("v is not null"), "described")
    s = own.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")).first()
    quartiles = [None] * 3
    if s["n"]:
        marks = [(s["n"] - 1) * q for q in (0.25, 0.5, 0.75)]
        at = at_places(own, "v", s["n"], sorted({f(m) for m in marks for f in (math.floor, math.ceil)}), held=held)
        quartiles = [at[math.floor(m)] + (at[math.ceil(m)] - at[math.floor(m)]) * (m - math.floor(m)) for m in marks]
    return spark.createDataFrame([(s["n"], s["mean"], s["std"], s["min"], *quartiles, s["max"])], "count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
