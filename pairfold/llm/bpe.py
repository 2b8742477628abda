"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece is encoded by merging, again and again, the leftmost pair of neighbours of lowest rank.  A segment tree over the
piece's byte positions holds the rank of the pair that begins at each live position; its root is the lowest rank, a walk
down to the left finds the leftmost pair that has it, and a merge changes three leaves.  So a piece of n bytes takes
O(n log n) steps, however long it is.  Pieces of at most 64 bytes, which nearly all are, take the same steps side by side:
their trees are the rows of one numpy matrix, and each round merges one pair in every row that still has one.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.llm.common import blocks

_NONE = 1 << 40
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Longer pieces are not kept: they are unlikely to come again.
_KEPT_CHARS = 1024
#: What an entry of the cache takes beside its key and its value.
_ENTRY_BYTES = 100

#: Code points of the texts that ``_SIMPLE`` below splits as the full pattern does: ASCII without the information
#: separators, and the letters of Latin-1 and Latin Extended-A.
_OTHER = regex.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ſ]")
_L, _S = "A-Za-zÀ-ÖØ-öø-ſ", r"\t-\r "


class Encoder:
    """Encodes texts by a rank file; ``pattern`` splits a text into pieces that are encoded separately.

    Pieces are kept in two generations of at most ``budget`` bytes each, and one block's pieces more; the older one goes when
    the newer is full.
    """

    def __init__(self, path: str, pattern: str, budget: int = 64 << 20) -> None:
        import re

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split_any = regex.compile(pattern).findall
        simple = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}0-9]").replace(r"\p{L}", f"[{_L}]").replace(r"\p{N}", "[0-9]").replace(r"\s", f"[{_S}]").replace(r"\S", f"[^{_S}]")
        self.split_simple = None if r"\p" in simple else re.compile(simple).findall
        self.budget, self.size, self.new, self.old = budget, 0, {}, {}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self._pair_table()

    def pieces(self, text: str) -> list[str]:
        return self.split_any(text) if self.split_simple is None or _OTHER.search(text) else self.split_simple(text)

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of a piece, by the segment tree."""
        get, n = self.ranks.get, len(piece)
        if (whole := get(piece)) is not None:
            return [whole]
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = get(piece[i : i + 2], _NONE)
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b
        after, before = list(range(1, n + 2)), list(range(-1, n))  # the live neighbours of each live position
        while (low := tree[1]) != _NONE:
            k = 1
            while k < size:
                k *= 2
                if tree[k] != low:
                    k += 1
            at = k - size
            gone = after[at]
            end = after[at] = after[gone]
            if end <= n:
                before[end] = at
            changed = [(gone, _NONE), (at, get(piece[at : after[end]], _NONE) if end < n else _NONE)]
            if (left := before[at]) >= 0:
                changed.append((left, get(piece[left:end], _NONE)))
            for i, rank in changed:
                k = size + i
                tree[k] = rank
                k >>= 1
                while k:
                    a, b = tree[2 * k], tree[2 * k + 1]
                    low = a if a <= b else b
                    if tree[k] == low:
                        break
                    tree[k] = low
                    k >>= 1
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[piece[at : after[at]]])
            at = after[at]
        return ids

    def _rank_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that two tokens make together; _NONE where they make none."""
        key = left * len(self.tokens) + right
        at = (key.astype(np.uint64) * _SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), _NONE, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            held = self.pair_keys[at[todo]]
            same = held == key[todo]
            out[todo[same]] = self.pair_ranks[at[todo[same]]]
            todo = todo[~same & (held >= 0)]
            at[todo] = (at[todo] + 1) & (len(self.pair_keys) - 1)
        return out

    def _pair_table(self) -> None:
        """Open-addressing table from pairs of token ids to the rank of what they make."""
        keys, ranks, n = [], [], len(self.tokens)
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.pair_keys, self.pair_ranks = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        key, rank = np.array(keys, np.int64), np.array(ranks, np.int64)
        at = (key.astype(np.uint64) * _SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.pair_keys[at[todo]] < 0]
            self.pair_keys[at[free]], self.pair_ranks[at[free]] = key[free], rank[free]  # of several, one wins a slot
            todo = todo[self.pair_keys[at[todo]] != key[todo]]
            at[todo] = (at[todo] + 1) & (len(self.pair_keys) - 1)

    def _merge_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        """As ``merge`` for many pieces of 2 to ``size`` bytes at once: one segment tree for each row of a matrix."""
        m, top = len(pieces), 2 * size
        n = np.fromiter(map(len, pieces), np.int64, m)
        token = self.byte_ids[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8)]  # by row * size + position
        live = (np.arange(size) < n[:, None]).ravel()
        after = np.tile(np.arange(1, size + 2), (m, 1)).ravel()  # by row * (size + 1) + position, as is before
        before = np.tile(np.arange(-1, size), (m, 1)).ravel()
        tree = np.full((m, top), _NONE, np.int64)
        pairs = np.flatnonzero(live & np.append(live[1:], False) & (np.arange(m * size) % size < size - 1))
        tree[pairs // size, size + pairs % size] = self._rank_pairs(token[pairs], token[pairs + 1])
        k = size
        while k > 1:
            k >>= 1
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        tree = tree.ravel()
        rows = np.flatnonzero(tree[1::top] != _NONE)
        while len(rows):
            base, low = rows * top, tree[rows * top + 1]
            k = np.ones(len(rows), np.int64)
            for _ in range(size.bit_length() - 1):
                k *= 2
                k += tree[base + k] != low
            at = k - size
            near = rows * (size + 1)
            gone = after[near + at]
            end, left = after[near + gone], before[near + at]
            after[near + at] = end
            before[near + end] = at
            token[rows * size + at] = low
            live[rows * size + gone] = False
            tree[base + size + gone] = _NONE
            tree[base + size + at] = _NONE
            some = np.flatnonzero(end < n[rows])
            tree[(base + size + at)[some]] = self._rank_pairs(low[some], token[(rows * size + end)[some]])
            some = np.flatnonzero(left >= 0)
            tree[(base + size + left)[some]] = self._rank_pairs(token[(rows * size + left)[some]], low[some])
            paths = [size + gone, size + at, size + np.where(left >= 0, left, at)]
            for _ in range(size.bit_length() - 1):
                for i in range(3):
                    paths[i] = paths[i] >> 1
                    child = base + 2 * paths[i]
                    tree[base + paths[i]] = np.minimum(tree[child], tree[child + 1])
            rows = rows[tree[base + 1] != _NONE]
        ids = token[live].astype("<u4").tobytes()
        ends = np.cumsum(live.reshape(m, size).sum(1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, pieces) -> None:
        """Encodes pieces that the cache lacks."""
        by_size: dict[int, list] = {}
        for p in pieces:
            if (known := self.old.get(p)) is not None:
                self.new[p] = known
                continue
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.new[p] = whole.to_bytes(4, "little")
            elif len(raw) > 64:
                self.new[p] = np.array(self.merge(raw), "<u4").tobytes()
            else:
                by_size.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((p, raw))
        for size, some in by_size.items():
            for i in range(0, len(some), 4096):
                part = some[i : i + 4096]
                self.new.update(zip([p for p, _ in part], self._merge_rows([r for _, r in part], size), strict=True))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Token ids of texts as little-endian unsigned 32-bit integers."""
        if self.size >= self.budget:
            self.old, self.new, self.size = self.new, {}, 0
        get, out, pending, missing = self.new.get, [], [], set()
        for text in texts:
            pieces = self.pieces(text)
            found = list(map(get, pieces))
            if None in found:
                missing.update(p for p, x in zip(pieces, found, strict=True) if x is None)
                pending.append((len(out), pieces))
                out.append(None)
            else:
                out.append(b"".join(found))
        self._learn(missing)
        for i, pieces in pending:
            out[i] = b"".join(map(self.new.__getitem__, pieces))
        for p in missing:
            if len(p) > _KEPT_CHARS:
                del self.new[p]
            else:
                self.size += sys.getsizeof(p) + sys.getsizeof(self.new[p]) + _ENTRY_BYTES
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder, with its cache of pieces, for all tasks of a Python worker."""
    return Encoder(path, pattern)


def _encoded(batches, path, pattern):
    encode = encoder(path, pattern).encode_many
    for ids, texts in blocks(batches, ["id", "text"], 2 << 20):
        yield ids, encode(texts)


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): token ids of each whole text, little-endian unsigned 32-bit.

    A null text counts as empty; an empty text has no ids.  Rows with repeated or null ids each give a row.  The file of
    ranks is read on the executors from ``path``, which each must have.
    """

    def run(batches):
        for ids, tokens in _encoded(batches, path, pattern):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(tokens, pa.binary())], ["id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, decoded binary) of a table of ids; null ids decode to no bytes."""

    def run(batches):
        decode = encoder(path, pattern).decode
        for ids, tokens in blocks(batches, ["id", "ids"]):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([decode(t or b"") for t in tokens], pa.binary())], ["id", "decoded"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), "ids")
    return rows.mapInArrow(run, "id long, decoded binary").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: (id_col, n_tokens, ids_sha256, decoded_sha256).

    One row per row of ``docs``, repeated rows and null ids too.  A null text counts as empty; an empty text has no ids, and
    both hashes are those of no bytes.  Texts are encoded whole, however long.  An empty table gives none; other columns are
    not read.
    """

    def run(batches):
        decode = encoder(path, pattern).decode
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for ids, tokens in _encoded(batches, path, pattern):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(t) // 4 for t in tokens], pa.int64()), pa.array(list(map(sha, tokens))), pa.array([sha(decode(t)) for t in tokens])], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
