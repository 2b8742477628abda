"""Best-fit packing: documents in falling order of length, each into the open sequence that has the least room for it.

Lengths are whole numbers of at most ``full``, so the packing depends only on how many pieces have each length.  That table
of at most ``full`` numbers goes to the driver, whatever the corpus, and is packed there: a segment tree over the room that
is left (0..full) finds the tightest open sequence in logarithmic time, for all documents of a length that go the same way
at once.  If the tightest room for length s is r, the sequence that takes one keeps being the tightest until r % s is left,
so every sequence with r left takes r // s of them; that gives exactly what one document after the other would give.

The outcome is a list of rules: so many documents of a length, by their number among those of that length, go to so many
sequences, at a place.  A task looks its pieces up in the rules by their numbers; no two pieces ever have to meet.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairfold.llm.common import blocks, save
from pairfold.llm.packing import _LETTERS, _SEPARATORS, _SHOWN, Cache

_SPACE = r" \t\n\r\f\v"
#: ASCII signs.
_SIGNS = r"!-/:-@\[-`{-~"
_PLAIN = rf"{_LETTERS}0-9{_SIGNS}{_SPACE}"
#: The splitter of the byte-level tokenizer for texts of plain characters; another character is a piece of its own.
_PIECE = re.compile(rf" ?[{_LETTERS}]++|'(?:[sdmt]|re|ve|ll)| ?[{_SIGNS}]++| ?[0-9]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]++|[^{_PLAIN}]")
_ODD = re.compile(rf"[^{_PLAIN}]").search
#: No piece goes on from other characters to white space, so chunks that begin with their white space are split alike alone.
_CHUNK = re.compile(r"\s*\S+|\s+")


class ByteTokenizer:
    """Token ids by the tokenizers library, which is asked once for pieces that a bounded cache holds.

    That is exact for a byte-level tokenizer without a normalizer.  Texts of plain characters (white space, ASCII, Latin
    letters of one code point) are split here, and their pieces go to the tokenizer's model in its byte alphabet.  Texts
    with any other character are cut into chunks before white space, and the library encodes those that have one.  It also
    encodes, whole, texts with the string of a special token or with information separators.
    """

    def __init__(self, path: str, budget: int = 96 << 20) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.pieces, self.chunks = Cache(budget, self._piece_ids), Cache(budget // 4, self._chunk_ids)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece_ids(self, piece: str) -> bytes:
        """Ids of a plain piece; KeyError for another."""
        if piece.isascii() and (word := piece.removeprefix(" ")).isprintable() and " " not in word:
            shown = piece if word is piece else f"Ġ{word}"
        elif _ODD(piece):
            raise KeyError(piece)
        else:
            shown = piece.encode().decode("latin-1").translate(_SHOWN)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk_ids(self, chunk: str) -> bytes:
        return self._ids(chunk) if _ODD(chunk) else b"".join(map(self.pieces.__getitem__, _PIECE.findall(chunk)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return self._ids(text)
        try:
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))
        except KeyError:  # it has other characters
            pass
        if _SEPARATORS.search(text):
            return self._ids(text)
        return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))


@lru_cache(2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


class RoomTree:
    """Segment tree over rooms 0..full: how many open sequences have each, and the least room of at least some size."""

    def __init__(self, full: int) -> None:
        self.width = 1 << full.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, n: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The least room >= ``size`` that an open sequence has."""
        at = size + self.width
        while not self.count[at]:
            while at & 1:  # the last of its parent: go on with what follows that
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.width:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.width


def plan_bins(counts: dict[int, int], full: int) -> list[tuple[int, int, int, int, int]]:
    """Rules (length, first, sequence, each, offset) of the best-fit decreasing packing of ``counts`` pieces of each length.

    The pieces of a length from number ``first`` to the next rule's go to sequences from ``sequence`` on, ``each`` to a
    sequence, behind one another from ``offset``.  There are at most two rules more for each length than open runs of
    sequences, of which a length adds two: at most 2 * full**2, whatever the counts.
    """
    tree, runs, rules, opened = RoomTree(full), [[] for _ in range(full + 1)], [], 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            runs[room].append((first, n))
            tree.add(room, n)

    for size in sorted(counts, reverse=True):
        if not 0 < size <= full:
            raise ValueError(f"no sequence of {full} holds a piece of {size}")
        done, total = 0, counts[size]
        while done < total:
            room = tree.tightest(size)
            if room is None:
                room = full
                first, n = opened, -(-(total - done) // (full // size))
                opened += n
            else:
                first, n = runs[room].pop()
                tree.add(room, -n)
            each = room // size
            whole = min(n, (total - done) // each)
            if whole:
                rules.append((size, done, first, each, full - room))
                done += whole * each
                leave(room - each * size, first, whole)
            if whole < n and done < total:
                rest = total - done
                rules.append((size, done, first + whole, rest, full - room))
                done = total
                leave(room - rest * size, first + whole, 1)
                whole += 1
            leave(room, first + whole, n - whole)
    return rules


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, turn long"
OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array(c, pa.int32() if k == "int" else pa.int64()) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def cut(docs: DataFrame, path: str, end_id: int, full: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of all documents, each numbered among those of its length that its task has (``task``, ``turn``)."""

    def run(batches):
        from pyspark import TaskContext

        t, task = tokenizer(path), TaskContext.get().partitionId()
        seen, rows, end = [0] * (full + 1), [], struct.pack("<I", end_id)
        for ids, texts in blocks(batches, ["id", "text"], 2 << 20):
            for i, text in zip(ids, texts, strict=True):
                own = memoryview(t.encode(text) + end)
                n, start, piece = len(own) // 4, 0, 0
                while start < n:
                    length = (n - start - 1) % full + 1  # what is left over comes first
                    rows.append((i, piece, start, length, zlib.crc32(own[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            if len(rows) >= 20_000:
                yield _batch(rows, PIECES)
                rows = []
        if rows:
            yield _batch(rows, PIECES)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, PIECES)


def best_fit(docs: DataFrame, path: str, end_id: int = 2, full: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document's ids are those that a tokenizer of the file at ``path`` gives without adding special tokens (the string of
    one in a text is that token, as the library has it) and then ``end_id``; a null or empty text has that one alone.
    Documents of more than ``full`` ids are cut into pieces of ``full``, of which the first may be shorter.  Pieces of a
    sequence leave no gap, and sequences are numbered from 0.  Their number is that of best-fit decreasing over all pieces
    at once, so it doesn't depend on how the input is split into tasks; which of two pieces of one length is where does.
    Rows with repeated or null ids are packed each on their own, other columns are not read, and an empty table gives none.

    Pieces are saved once, with their number among those of their length within a task.  Adding how many earlier tasks have
    makes it a number among all, by one look-up keyed by (task, length), so no length is a hot key.
    """
    pieces = save(cut(docs, path, end_id, full, id_col, text_col), "pieces")
    counted = save(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    base, at = np.zeros(full + 2, np.int64), 0
    for size in sorted(totals):
        base[size] = at  # pieces of smaller lengths
        at += totals[size]
    rules = np.array(sorted(plan_bins(totals, full)), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast((base, rules, base[rules[:, 0]] + rules[:, 1]))

    def place(batches):
        base, rules, firsts = shared.value
        for b in batches:
            size, number = b["length"].to_numpy(), b["number"].to_numpy()
            rule = np.searchsorted(firsts, base[size] + number, "right") - 1
            _, first, sequence, each, offset = rules[rule].T
            turn = number - first
            found = [pa.array(sequence + turn // np.maximum(each, 1)), pa.array(offset + turn % np.maximum(each, 1) * size)]
            yield pa.record_batch([*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), *found], [x.split()[0] for x in OUT.split(", ")])

    numbered = pieces.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("turn") + F.col("before")).alias("number"))
    return numbered.mapInArrow(place, OUT)
