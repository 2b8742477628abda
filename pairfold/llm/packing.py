"""Order-preserving packing: a dynamic program chooses window cuts at document or sentence ends.

Within sentences of more than 1/64 of a sequence it may cut too, at a higher penalty, so text without sentences packs as well.

Documents follow each other as they are read; a sequence is a window of their tokens.  The cost of a set of cuts is the
padding of its sequences (none where the length is a power of two, else what is missing to the full length) plus a
penalty for every cut that truncates a document.  Over the possible cuts c[0] < c[1] < ..., the best cost up to c[i] is

    best[i] = penalty[i] + min( min over j of best[j] + full - (c[i] - c[j]),  best[j] where c[i] - c[j] is a power of two )

with j over the cuts at most ``full`` tokens before.  The first minimum is that of best[j] + c[j] over a sliding window,
which a monotone queue gives in constant amortised time; the second is at most a dozen look-ups.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.llm.common import blocks

#: Letters whose lower case is one letter and which no mark joins, of ASCII, Latin-1 and Latin Extended-A.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: ASCII signs but for the apostrophe, which may start a contraction.
_SIGNS = r"!-&(-/:-@\[-`{-~"
#: A chunk between white space that holds any other character.
_ODD_CHUNK = re.compile(rf"((?<!\S)[{_LETTERS}{_SIGNS}0-9]*+[^\s{_LETTERS}{_SIGNS}0-9]\S*+)")
#: Runs of letters, runs of signs, single digits, and whatever else is no white space.
_PIECE = re.compile(rf"[{_LETTERS}]+|[{_SIGNS}]+|[0-9]|[^\s{_LETTERS}{_SIGNS}0-9]|[\x1c-\x1f]")
_PLAIN_START = re.compile(rf"[{_LETTERS}{_SIGNS}0-9]").match
#: The byte alphabet: bytes that are visible in Latin-1 stand for themselves, the others for code points from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_SHOWN = {b: 256 + i for i, b in enumerate(_HIDDEN)}
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Bytes that a cached string and its ids take beside their contents, about.
_ENTRY_BYTES = 200
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Cache(dict):
    """Ids of strings in two generations of at most about ``budget`` bytes each; the older one goes when the newer is full."""

    def __init__(self, budget: int, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.budget, self.encode, self.old, self.size = budget, encode, {}, 0

    def __missing__(self, string: str) -> bytes:
        ids = self.old.get(string)
        if ids is None:
            ids = self.encode(string)
        self.size += len(string) + len(ids) + _ENTRY_BYTES
        if self.size > self.budget:
            self.old, self.size = dict(self), 0
            self.clear()
        self[string] = ids
        return ids


class WordTokenizer:
    """Token ids by the tokenizers library, which is asked once for words and chunks that a bounded cache holds.

    That is exact for a tokenizer that splits at white space and whose normalizer treats characters on their own, NFC
    apart, which never joins across white space.  Its splitter makes runs of letters, runs of signs and single digits
    pieces of their own, so in stretches of plain letters, signs other than an apostrophe and digits, pieces go straight to
    the tokenizer's model, in its byte alphabet.  Chunks between white space with any other character are encoded as they
    are.  Texts with the string of a special token, which the library looks for before all else, and with information
    separators, which Python alone takes for white space, are encoded as a whole.
    """

    def __init__(self, path: str, budget: int = 64 << 20) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.pieces, self.chunks = Cache(budget, self._piece_ids), Cache(budget // 4, self._ids)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a sentence
        for token, i in vocab.items():
            if token.endswith("</w>") and set(token[:-4]) & set(".!?") and not any(c.isalnum() for c in token[:-4]):
                self.ends[i] = True

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece_ids(self, piece: str) -> bytes:
        """Ids of a plain piece; KeyError for another."""
        if not _PLAIN_START(piece):
            raise KeyError(piece)
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return self._ids(text)
        pieces, chunks = self.pieces.__getitem__, self.chunks.__getitem__
        try:
            return b"".join(map(pieces, _PIECE.findall(text.lower())))
        except KeyError:  # it has other characters
            pass
        if _SEPARATORS.search(text):
            return self._ids(text)
        parts = _ODD_CHUNK.split(text)
        out = [*map(pieces, _PIECE.findall(parts[0].lower()))]
        for odd, plain in zip(parts[1::2], parts[2::2], strict=True):
            out += [chunks(odd), *map(pieces, _PIECE.findall(plain.lower()))]
        return b"".join(out)


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def choose_cuts(cuts, penalties, full: int) -> list[int]:
    """The cuts of least cost, from ``cuts[0]`` (a cut already) to ``cuts[-1]``; neighbours are at most ``full`` apart."""
    n, place = len(cuts), np.asarray(cuts, np.int64)
    numbers = np.full(int(place[-1] - place[0]) + 1, -1, np.int64)  # of the cut at each position
    numbers[place - place[0]] = np.arange(n)
    whole_to, whole_from = [], []  # pairs of cuts that are a power of two apart
    for p in (1 << k for k in range(full.bit_length()) if 1 << k <= full):
        at = np.flatnonzero(place - place[0] >= p)
        source = numbers[place[at] - place[0] - p]
        whole_to.append(at[source >= 0])
        whole_from.append(source[source >= 0])
    order = np.argsort(np.concatenate(whole_to), kind="stable")
    whole_to = [*np.concatenate(whole_to)[order].tolist(), n]
    whole_from = np.concatenate(whole_from)[order].tolist()
    best, back, w = [0.0] * n, [0] * n, 0
    queue = deque([(cuts[0], 0, cuts[0])])  # best[j] + cuts[j], j, cuts[j]: values rise from left to right
    for i in range(1, n):
        c = cuts[i]
        low = c - full
        while queue[0][2] < low:
            queue.popleft()
        value, j, _ = queue[0]
        value += full - c
        while whole_to[w] == i:
            k = whole_from[w]
            w += 1
            if best[k] < value:
                value, j = best[k], k
        value += penalties[i]
        best[i], back[i] = value, j
        value += c
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i, c))
    out, i = [], n - 1
    while i:
        out.append(cuts[i])
        i = back[i]
    return out[::-1]


class Packer:
    """Packs a stream of documents; a block of at least ``block`` tokens is cut at once, but for its last sequence."""

    def __init__(self, ends: np.ndarray, end_id: int, full: int, sentence_penalty: float, word_penalty: float, block: int, base: int) -> None:
        self.ends, self.end_id, self.full, self.block = ends, end_id, full, block
        self.sentence_penalty, self.word_penalty = sentence_penalty, word_penalty
        self.next_id = base
        self.docs: list[list] = []  # doc_id, ids, the first id that is not packed yet
        self.size = 0

    def add(self, doc_id, ids: bytes):
        tokens = np.append(np.frombuffer(ids, "<u4"), np.uint32(self.end_id)).astype("<u4")
        self.docs.append([doc_id, tokens, 0])
        self.size += len(tokens)
        if self.size >= self.block:
            yield from self._pack(last=False)

    def finish(self):
        if self.size:
            yield from self._pack(last=True)

    def _possible(self):
        """Cuts and their penalties: document and sentence ends, and places within sentences of over 1/64 of a sequence."""
        places, costs, at = [np.zeros(1, np.int64)], [np.zeros(1)], 0
        for _, tokens, start in self.docs:
            left = tokens[start:]
            inner = np.flatnonzero(self.ends[left[:-1]]) + 1
            inner = inner[inner < len(left)]
            places += [inner + at, [at + len(left)]]
            costs += [np.full(len(inner), self.sentence_penalty), [0.0]]
            at += len(left)
        place, cost = np.concatenate(places), np.concatenate(costs)
        step = max(1, self.full // 64)
        more = (np.diff(place) - 1) // step  # cuts within longer stretches, as many steps after what goes before
        if more.any():
            gap = np.repeat(np.arange(len(more)), more)
            turn = np.arange(len(gap)) - np.repeat(np.cumsum(more) - more, more) + 1
            place, cost = np.append(place, place[gap] + step * turn), np.append(cost, np.full(len(gap), self.word_penalty))
            order = np.argsort(place, kind="stable")
            place, cost = place[order], cost[order]
        return place.tolist(), cost.tolist()

    def _pack(self, last: bool):
        cuts = choose_cuts(*self._possible(), self.full)
        if last:
            cuts = cuts[:-1] + self._tail(cuts[-2] if len(cuts) > 1 else 0, cuts[-1])
        elif len(cuts) > 1:
            cuts.pop()  # what comes next may share the last sequence
        yield from self._emit(cuts)

    def _tail(self, a: int, b: int) -> list[int]:
        """The last sequence of a stream, as sequences of powers of two where that costs less than its padding."""
        n = b - a
        parts = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
        if (len(parts) - 1) * self.word_penalty >= self.full - n:
            return [b]
        return (a + np.cumsum(parts)).tolist()

    def _emit(self, cuts: list[int]):
        at, begin = 0, 0
        docs = deque(self.docs)
        for cut in cuts:
            while at < cut:
                doc_id, tokens, start = docs[0]
                n = min(len(tokens) - start, cut - at)
                yield doc_id, start, n, zlib.crc32(tokens[start : start + n].tobytes()), len(tokens), self.next_id, at - begin
                at += n
                if start + n == len(tokens):
                    docs.popleft()
                else:
                    docs[0] = [doc_id, tokens, start + n]
            begin = cut
            self.next_id += 1
        self.docs = list(docs)
        self.size -= cuts[-1] if cuts else 0


def pack(docs: DataFrame, path: str, end_id: int = 2, full: int = 4096, id_col: str = "doc_id", text_col: str = "text", sentence_penalty: float = 8.0, word_penalty: float = 64.0, block: int = 1 << 20) -> DataFrame:
    """One row per piece of a document: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are those that a tokenizer of the file at ``path`` gives without adding special tokens (the string of
    one in a text is that token, as the library has it) and then ``end_id``; a null or empty text has that one alone.  Each id lies in exactly one piece, pieces of a sequence leave no gap, and no
    sequence is longer than ``full``.  Documents keep the order in which a task reads them; rows with repeated or null ids
    are packed each on their own.  An empty table gives no pieces.  Only the last sequence of a task can't be filled from
    what follows; it is split into lengths of powers of two where that is cheaper.  sequence_id is unique in a result; it
    depends on how the input is split into tasks.  A task holds at most about ``block`` tokens and one document.
    """

    def run(batches):
        from pyspark import TaskContext

        t = tokenizer(path)
        packer = Packer(t.ends, end_id, full, sentence_penalty, word_penalty, block, TaskContext.get().partitionId() << 33)

        def pieces():
            for ids, texts in blocks(batches, ["id", "text"], 2 << 20):
                for i, text in zip(ids, texts, strict=True):
                    yield from packer.add(i, t.encode(text))
            yield from packer.finish()

        rows = []
        for row in pieces():
            rows.append(row)
            if len(rows) >= 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])
