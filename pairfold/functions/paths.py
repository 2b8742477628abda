"""Image paths: relative parts, stem, extension, categories, instance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def relative(path: Column, base: Column) -> Column:
    """The path below ``base`` without a leading slash; null if it isn't below."""
    inside = F.startswith(path, base)
    return F.when(inside, F.regexp_replace(F.substring(path, F.length(base) + 1, F.length(path)), "^/+", ""))


def file_name(rel: Column) -> Column:
    return F.element_at(F.split(rel, "/"), -1)


def stem(rel: Column) -> Column:
    """File name without its extension, stripped; a name's leading dots begin no extension."""
    return strip(F.regexp_extract(file_name(rel), r"^(\.*[^.]*(?:\..*?)??)(\.[^.]*)?$", 1))


def extension(rel: Column) -> Column:
    """From the last dot on; empty without one."""
    return F.regexp_extract(file_name(rel), r"^(\.*[^.]*(?:\..*?)??)(\.[^.]*)?$", 2)


def categories(rel: Column) -> Column:
    """Directories, stripped, then the stem without digits and with "_" for spaces."""
    parts = F.split(rel, "/")
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), strip)
    return F.concat(folders, F.array(F.replace(F.regexp_replace(stem(rel), "[0-9]", ""), F.lit(" "), F.lit("_"))))


def instance(rel: Column) -> Column:
    """All digits of the stem as one number; null without digits or beyond a long."""
    return F.regexp_replace(stem(rel), "[^0-9]", "").try_cast("bigint")
