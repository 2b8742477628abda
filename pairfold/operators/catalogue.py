"""Category counts, the category tree, Newick text and size histograms."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairfold.sources import images

# Panels of the size histogram, by category prefix.
PANELS = ("All Categories", "Animate", "Inanimate", "Animate/Animal", "Animate/Human", "Inanimate/Handmade", "Inanimate/Natural")


def as_counts(dataset: str | DataFrame, spark: SparkSession | None = None, order: str | None = None) -> DataFrame:
    """(cats, n): images of each category path.

    ``dataset`` is a folder or a table with ``cats`` or with columns cat1..catN, where null parts are left out and rows
    without categories are skipped.  Where gaps make paths equal that were not, ``order`` names a column whose smallest
    value decides which of them is counted; without it they are counted together.
    """
    if isinstance(dataset, str):
        dataset = images.catalogue(images.scan(spark, dataset))
    if "cats" not in dataset.columns:
        names = sorted((c for c in dataset.columns if c.startswith("cat") and c[3:].isdigit()), key=lambda c: int(c[3:]))
        dataset = dataset.withColumn("cats", F.array(*names))
    rows = dataset.select(F.col("cats").alias("raw"), F.array_compact("cats").alias("cats"), *([F.col(order).alias("o")] if order else [])).where(F.size("cats") > 0)
    if not order:
        return rows.groupBy("cats").agg(F.count("*").alias("n"))
    by_raw = rows.groupBy("raw", "cats").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    first = Window.partitionBy("cats").orderBy("o")
    return by_raw.withColumn("turn", F.row_number().over(first)).where("turn = 1").select("cats", "n")


def tree_edges(counts: DataFrame) -> DataFrame:
    """(parent, child) paths; children of the root are those first levels that have children themselves."""
    inner = counts.where(F.size("cats") > 1).select(F.explode(F.sequence(F.lit(1), F.size("cats") - 1)).alias("i"), "cats")
    edges = inner.select(F.slice("cats", F.lit(1), F.col("i")).alias("parent"), F.slice("cats", F.lit(1), F.col("i") + 1).alias("child")).distinct()
    top = edges.where(F.size("parent") == 1).select(F.array().cast("array<string>").alias("parent"), F.col("parent").alias("child")).distinct()
    return edges.unionByName(top)


def tree_nodes(counts: DataFrame, update_internal_counts: bool = True) -> DataFrame:
    """(node, depth, n): every path in the tree with its own images and those of all paths below; the root is empty.

    Paths of one level without children are in no edge, so they are neither nodes nor part of the root's total.  Without
    ``update_internal_counts`` only counted paths are nodes and have their own count.
    """
    deep = counts.where(F.size("cats") > 1)
    tops = deep.select(F.col("cats")[0].alias("top")).distinct()
    rows = counts.join(tops, counts["cats"][0] == tops["top"], "left_semi")
    if not update_internal_counts:
        return rows.select(F.col("cats").alias("node"), F.size("cats").alias("depth"), "n")
    up = rows.select(F.explode(F.sequence(F.lit(0), F.size("cats"))).alias("depth"), "cats", "n")
    up = up.select(F.when(F.col("depth") == 0, F.array().cast("array<string>")).otherwise(F.slice("cats", F.lit(1), F.col("depth"))).alias("node"), "depth", "n")
    return up.groupBy("node", "depth").agg(F.sum("n").alias("n"))


def as_tree(dataset: str | DataFrame, spark: SparkSession | None = None, order: str | None = None, update_internal_counts: bool = True) -> DataFrame:
    """(node, depth, n) of a folder or a table, which :func:`as_counts` takes."""
    return tree_nodes(as_counts(dataset, spark, order), update_internal_counts)


def newick(counts: DataFrame) -> DataFrame:
    """One row (newick): the tree with labels '<name>-<count>', children by name, the root named ROOT.

    An apostrophe within a name is doubled.

    The tree is folded from its deepest level up, one aggregation a level, so there are as many as the tree is deep.
    """
    nodes = tree_nodes(counts)
    depth = nodes.agg(F.max("depth")).first()[0]
    if depth is None:
        return counts.sparkSession.createDataFrame([("'ROOT-0';",)], "newick string")
    label = lambda name: F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("-"), F.col("n").cast("string"), F.lit("'"))
    below = None
    for level in range(depth, -1, -1):
        here = nodes.where(F.col("depth") == level)
        name = F.element_at("node", -1) if level else F.lit("ROOT")
        text = label(name)
        if below is not None:
            here = here.join(below, here["node"] == below["parent"], "left")
            text = F.when(F.col("kids").isNull(), text).otherwise(F.concat(F.lit("("), F.array_join(F.transform("kids", lambda k: k["text"]), ","), F.lit(")"), text))
        here = here.select("node", (F.element_at("node", -1) if level else F.lit("ROOT")).alias("name"), text.alias("text"))
        if level == 0:
            return here.select(F.concat("text", F.lit(";")).alias("newick"))
        below = here.groupBy(F.slice("node", F.lit(1), F.lit(level - 1)).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("kids"))
    raise AssertionError("unreachable")


def write_newick(counts: DataFrame, path: str) -> None:
    newick(counts).write.mode("overwrite").text(path)


_NEWICK = re.compile(r"'(?:[^']|'')*'|[(),;]|[^(),;']+")


def _tree(text: str) -> list[list]:
    """[node, parent, name] of a Newick text; nodes are numbered as they end, parents after their children."""
    rows: list[list] = []
    levels: list[list[int]] = [[]]  # nodes that wait for their parent, at each depth
    below: list[int] = []  # children of the node that comes next

    def end(name: str) -> None:
        nonlocal below
        for k in below:
            rows[k][1] = len(rows)
        levels[-1].append(len(rows))
        rows.append([len(rows), None, name])
        below = []

    before = ""
    for token in _NEWICK.findall(text):
        if token in "),;" and before == ")":
            end("")  # an inner node without a label
        if token == ";":
            break
        if token == "(":
            levels.append([])
        elif token == ")":
            below = levels.pop()
        elif token != ",":
            end(token[1:-1].replace("''", "'") if token[0] == "'" else token)
        before = token
    return rows


def parse_newick(texts: DataFrame, column: str = "newick") -> DataFrame:
    """(tree, node, parent, name) of each text's tree, whose inner nodes have labels; ``tree`` is unique to a text."""

    def run(batches):
        for batch in batches:
            rows = [[tree, *r] for tree, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True) for r in _tree(text or "")]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["tree", "node", "parent", "name"])

    return texts.select(F.monotonically_increasing_id().alias("tree"), column).mapInArrow(run, "tree long, node long, parent long, name string")


def with_prefix(counts: DataFrame, prefix: str) -> DataFrame:
    """The counted paths that begin with a spec such as "Animate/Animal", which is taken in lower case."""
    parts = F.split(F.lower(F.lit(prefix)), "/")
    return counts.where(F.slice("cats", F.lit(1), F.size(parts)) == parts)


def size_histogram(counts: DataFrame, panels: tuple[str, ...] = PANELS) -> DataFrame:
    """(panel, size, categories): how many categories have each size; "All Categories" has them all.

    One pass: each path is given to the panels whose prefix it has.
    """
    hits = [F.when(F.lit(p == "All Categories") | (F.slice("cats", F.lit(1), F.lit(p.count("/") + 1)) == F.split(F.lower(F.lit(p)), "/")), F.lit(p)) for p in panels]
    rows = counts.select(F.explode(F.array_compact(F.array(*hits))).alias("panel"), F.col("n").alias("size"))
    return rows.groupBy("panel", "size").agg(F.count("*").alias("categories"))


def largest_size(counts: DataFrame) -> DataFrame:
    """One row (bins): the largest size and one more."""
    return counts.agg((F.max("n") + 1).alias("bins"))
