"""Image folders as a catalogue table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfold.functions import paths
from pairfold.session import spread
from pairfold.sources.image_files import SCHEMA, ImageFiles, file_system, look

CATALOGUE = ["cats", "instance", "height", "width", "n_channels", "has_alpha", "extension", "path"]


def png_header(content: Column) -> dict[str, Column]:
    """Height, width and channels from the first bytes of a PNG; nulls for other contents.

    Grey images have one channel, which is one dimension too few for the catalogue; grey with alpha counts as four, as
    decoders widen it, and a palette as three.
    """
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")
    ok = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    kind = number(26, 1)
    channels = F.when(kind == 0, 1).when(kind.isin(2, 3), 3).when(kind.isin(4, 6), 4)
    return {"width": F.when(ok, number(17, 4)), "height": F.when(ok, number(21, 4)), "n_channels": F.when(ok, channels)}


def files_of(spark: SparkSession, uri: str, extensions: list[str], check: str = "structure") -> DataFrame:
    """All image files under a folder, as the data source ``image_files`` has them; each folder is listed once, and its files are dealt to all tasks."""
    spark.dataSource.register(ImageFiles)
    names = spark.read.format("image_files").options(path=uri, extensions=",".join(extensions), check="none").load().select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(uri)
        for b in batches:
            yield from look(fs, base, (f"{base.rstrip('/')}/{path}" for path in b["path"].to_pylist()), check == "whole")

    return names.repartition(spread(spark), "path").mapInArrow(run, SCHEMA)


def scan(spark: SparkSession, folder: str, extensions: str | list[str] = "png", check: str = "structure") -> DataFrame:
    """(path, height, width, n_channels) of all image files under a folder, of any of the extensions (matched as they are).

    PNG and JPEG files are read by ranges, by ``image_files``: nulls for a file that is no complete image of one of these
    formats, or with ``check="whole"`` whose pixel data is damaged.  In stores that Arrow has no file system for, Spark's
    own readers read whole files: a PNG then counts by its header, other formats by the image source, and names that
    begin with "_" or "." are passed over.
    """
    names = [extensions] if isinstance(extensions, str) else list(extensions)
    if not names:
        raise ValueError("extensions must name at least one extension")
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (fs.exists(base) and fs.getFileStatus(base).isDirectory()):
        raise ValueError(f"{folder} is not a directory")
    root = fs.makeQualified(base).toString().rstrip("/") + "/"
    try:
        file_system(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return _read_whole(spark, folder, root, names)
    return files_of(spark, root, names, check).select("path", "height", "width", "n_channels")


def _read_whole(spark: SparkSession, folder: str, root: str, names: list[str]) -> DataFrame:
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    rel = lambda c: paths.relative(plain(F.col(c)), F.lit(plain_root)).alias("path")
    plain_root = re.sub("^file:/+", "file:/", root)
    load = lambda kind, glob: spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    parts = []
    if "png" in names:
        parts.append(load("binaryFile", "*.png").select(rel("path"), *[c.alias(k) for k, c in png_header(F.col("content")).items()]))
    others = [x for x in names if x != "png"]
    if others:
        glob = f"*.{{{','.join(others)}}}"
        image = load("image", glob).select("image.*").where("height >= 0")
        seen = image.select(F.url_decode(F.regexp_replace("origin", r"\+", "%2B")).alias("origin"), "height", "width", F.col("nChannels").alias("n_channels"))
        seen = seen.select(rel("origin"), "height", "width", "n_channels")
        parts.append(load("binaryFile", glob).select(rel("path")).join(seen, "path", "left"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("path", "height", "width", "n_channels")


def judged(images: DataFrame) -> DataFrame:
    """The rows with the ``reason`` why the catalogue leaves them out, null for those that it has."""
    rel = F.col("path")
    reason = (
        F.when(rel.isNull(), "outside the base folder")
        .when(~F.coalesce(paths.stem(rel).rlike("[0-9]$"), F.lit(False)), "name does not end with a digit")
        .when(paths.instance(rel).isNull(), "no instance number")
        .when(F.col("height").isNull() | (F.col("height") < 0) | F.col("n_channels").isNull(), "not readable")
        .when(F.col("n_channels") < 2, "not three-dimensional")
    )
    return images.withColumn("reason", reason)


def catalogue(images: DataFrame) -> DataFrame:
    """Valid rows of (path relative to the base, height, width, n_channels) with categories, instance and extension."""
    rel = F.col("path")
    return judged(images).where("reason is null").select(
        paths.categories(rel).alias("cats"), paths.instance(rel).alias("instance"), "height", "width", "n_channels",
        (F.col("n_channels") == 4).alias("has_alpha"), paths.extension(rel).alias("extension"), "path",
    )


def rejects(images: DataFrame) -> DataFrame:
    """(path, reason) of the rows that the catalogue leaves out; each row is judged on its own."""
    return judged(images).where("reason is not null").select("path", "reason")


def wide(rows: DataFrame, depth: int) -> DataFrame:
    """The catalogue with columns cat1..catN for the categories, missing ones null."""
    return rows.select(*[F.get("cats", F.lit(i)).alias(f"cat{i + 1}") for i in range(depth)], *CATALOGUE[1:])


def as_frame(spark: SparkSession, folder: str, extensions: str | list[str] = "png") -> DataFrame:
    """The catalogue of an image folder, with as many category columns as its deepest path has."""
    rows = catalogue(scan(spark, folder, extensions))
    depth = rows.agg(F.max(F.size("cats"))).first()[0] or 0
    return wide(rows, depth)
