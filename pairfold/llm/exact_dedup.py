"""Exact deduplication by Grace hashing, with complete contents compared in open-addressing tables.

Every input task first folds its own copies in a bounded table, so a text that makes up a third of the corpus crosses the
shuffle once per task.  What is left is partitioned by content hash into buckets (the shuffle's files are the spill files).
Each bucket is read as a stream into an open-addressing table that compares whole contents.  Once a table has reached its
budget it takes no new content: rows of contents that it already holds are still folded in, and all others go to an
overflow table in the shared folder, which the next round partitions again by another hash into more buckets.  Rounds end
when nothing overflows; each resolves at least one budget's worth of contents per bucket.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.llm.common import attach, blocks, forget, free_name, save

_RECORD = "digest binary, content binary, keep_id long, copies long"


class OpenTable:
    """Linear-probing table from contents to (largest id, number of copies); refuses new contents beyond ``budget`` bytes."""

    def __init__(self, budget: int) -> None:
        self.budget, self.bytes, self.full = budget, 0, False
        self.slots: list[int] = [-1] * 64
        self.entries: list[list] = []  # hash, digest, content, keep_id, copies

    def _find(self, h: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            entry = self.entries[e]
            if entry[0] == h and entry[2] == content:
                break
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: bytes, keep_id: int | None, copies: int) -> bool:
        h = int.from_bytes(digest[8:16], "little")  # not the bytes that chose the bucket
        at = self._find(h, content)
        if (e := self.slots[at]) >= 0:
            entry = self.entries[e]
            if keep_id is not None and (entry[3] is None or keep_id > entry[3]):
                entry[3] = keep_id
            entry[4] += copies
            return True
        if self.full or (self.entries and self.bytes + len(content) > self.budget):
            self.full = True
            return False
        self.slots[at] = len(self.entries)
        self.entries.append([h, digest, content, keep_id, copies])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for i, x in enumerate(self.entries):
                self.slots[self._find(x[0], x[2])] = i
        return True


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    d, c, k, n = zip(*rows, strict=True)
    return pa.record_batch([pa.array(d, pa.binary()), pa.array(c, pa.binary()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["digest", "content", "keep_id", "copies"])


def _chunks(rows, limit: int = 8 << 20):
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r[1] or b"") + 64
        if size >= limit:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


def _fold(budget: int):
    """Folds the copies within a task; contents that no longer fit the table pass through."""

    def run(batches):
        table = OpenTable(budget)

        def passed():
            for ids, contents in blocks(batches, ["id", "content"]):
                for i, content in zip(ids, contents, strict=True):
                    digest = hashlib.sha256(content).digest()
                    if not table.add(digest, content, i, 1):
                        yield digest, content, i, 1

        yield from _chunks(passed())
        yield from _chunks((e[1], e[2], e[3], e[4]) for e in table.entries)

    return run


def _resolve(budget: int):
    """Resolves a bucket: classes without their content, and rows of contents that did not fit with it."""

    def run(batches):
        table = OpenTable(budget)

        def over():
            for row in blocks(batches, ["digest", "content", "keep_id", "copies"]):
                for digest, content, keep, n in zip(*row, strict=True):
                    if not table.add(digest, content, keep, n):
                        yield digest, content, keep, n

        yield from _chunks(over())
        yield from _chunks((e[1], None, e[3], e[4]) for e in table.entries)

    return run


def content_classes(rows: DataFrame, budget: int = 48 << 20) -> tuple[DataFrame, list[DataFrame]]:
    """Classes (digest, keep_id, copies) of equal contents of ``rows`` (id long, content binary), and the saved tables behind them."""
    spark = rows.sparkSession
    level, saved, done = 0, [], None
    todo = rows.mapInArrow(_fold(budget), _RECORD)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        dealt = todo.repartition("digest") if level == 0 else todo.repartition(buckets << level, F.xxhash64("digest", F.lit(level)))
        out = save(dealt.mapInArrow(_resolve(budget), _RECORD), f"grace-{level}")
        saved.append(out)
        classes = out.where("content is null").select("digest", "keep_id", "copies")
        done = classes if done is None else done.union(classes)
        todo = out.where("content is not null")
        if todo.select("keep_id").isEmpty():
            return done, saved
        level += 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 48 << 20) -> DataFrame:
    """One row per row of ``docs``: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical in UTF-8; of equal texts, the row with the largest id stays.  A null text counts as
    empty, so null and empty texts are one group.  A null id never wins over another; where all ids of a group are null,
    keep_id is null and its rows stay.  A row repeated with the id that stays counts in group_size and stays too, since
    rows are told apart by id alone.  An empty table gives an empty result.  Other columns of ``docs`` are not read.
    ``budget`` bounds the bytes of content in a table; a single longer content still fits, alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    classes, behind = content_classes(rows.select("id", F.col("text").cast("binary").alias("content")), budget)
    total = classes.agg(F.sum("copies")).first()[0] or 0
    repeated = save(classes.where("copies > 1").select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", F.col("copies").alias("group_size")), "repeated")
    forget(*behind)
    own = rows.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    out = attach(own, repeated, "text_sha256", "group_size", total, F.col("id"))
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 48 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns as they came.

    As :func:`exact_dedup`, but of rows that repeat both the id and the text of the one that stays, one is left.  Rows of
    one id with other texts are judged by their own.  A row with a null id goes if its text has a row with an id, else one
    row of its text stays.  An empty table stays empty.
    """
    i, sha = free_name(docs, "_id"), free_name(docs, "_sha")
    of_copies = exact_dedup(docs.select(id_col, text_col), id_col, text_col, budget).where("group_size > 1")
    marked = save(of_copies.select(F.col(id_col).alias(i), F.col("text_sha256").alias(sha), "kept"), "marked")
    gone = marked.where("not kept").select(i, sha).distinct()
    twice = save(marked.where("kept").groupBy(i, sha).count().where("count > 1").select(i, sha), "twice")
    same = docs[id_col].cast("long").eqNullSafe(F.col(i)) & (F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256) == F.col(sha))
    if twice.isEmpty():
        return docs.join(gone, same, "left_anti")
    return docs.join(gone.union(twice), same, "left_anti").union(docs.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))
