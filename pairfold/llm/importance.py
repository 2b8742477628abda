"""Importance resampling: documents whose n-grams are likelier in a target table are drawn more often.

Features are all runs of one and two consecutive words, hashed by CRC-32 into buckets.  The first pass counts buckets, a
vector for each task by ``np.bincount`` that ``treeReduce`` merges; the gains of all buckets, a vector of a fixed length,
are broadcast, and the second pass sums them for each document, by ``np.bincount`` again, with gains as weights.  Gumbel
noise drawn from the id makes the highest scores a sample without replacement.

Words are found and hashed as bytes of many texts at once: one step of the CRC for the j-th bytes of all words that have one.
A CRC is linear, so that of two words joined by a space follows from theirs: the first one's state is moved past the other's
bytes by four look-ups.  No word or pair of words is ever a string.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairfold.llm.common import blocks, save

#: Lower-cased bytes, and whether they belong to words: ASCII digits and letters, and all bytes beyond ASCII.
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Longer words are hashed one by one.
_LONG = 64
_ONES, _BYTE = np.uint32(0xFFFFFFFF), np.uint32(0xFF)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A CRC's table, and moves[n, k, b]: what byte k (0: lowest) of a state, if it is b, adds to the state n zero bytes later."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    moves = np.zeros((_LONG + 1, 4, 256), np.uint32)
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for n in range(_LONG + 1):
            moves[n, k] = state
            state = state >> np.uint32(8) ^ table[state & _BYTE]
    return table, moves


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all features of some texts, the number of the text that each belongs to, and the words of each text."""
    table, moves = _tables()
    coded = [t.encode() for t in texts]
    low = _LOW[np.frombuffer(b"\n".join([b"", *coded, b""]), np.uint8)]
    edges = np.flatnonzero(np.diff(_IN_WORD[low])) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(c) + 1 for c in coded])
    of = np.searchsorted(ends, start - 1, "right")
    state, order = np.full(len(start), _ONES), np.argsort(-size, kind="stable")
    falling = size[order]
    held, left = start[order], int(np.searchsorted(-falling, -_LONG, "right")) if len(start) else 0
    raw, at = state[left:], held[left:]
    alive = np.searchsorted(-falling[left:], -np.arange(1, _LONG + 1), "right")  # how many words have a j-th byte
    for j, n in enumerate(alive.tolist()):
        if not n:
            break
        raw[:n] = raw[:n] >> np.uint32(8) ^ table[(raw[:n] ^ low[at[:n] + j]) & _BYTE]
    own = np.empty_like(state)
    own[order] = state
    for i in order[:left]:
        own[i] = zlib.crc32(low[start[i] : start[i] + size[i]]) ^ 0xFFFFFFFF
    second = np.flatnonzero(of[1:] == of[:-1]) + 1  # words with one before them in their text
    first, past = own[second - 1], size[second]
    first = first >> np.uint32(8) ^ table[(first ^ np.uint32(32)) & _BYTE] ^ _ONES
    short, pairs = np.minimum(past, _LONG), own[second]
    for k in range(4):
        pairs = pairs ^ moves[short, k, first >> np.uint32(8 * k) & _BYTE]
    for at in np.flatnonzero(past > _LONG):
        i = second[at]
        pairs[at] = zlib.crc32(low[start[i] : start[i] + size[i]], int(first[at])) ^ 0xFFFFFFFF
    return np.concatenate([own, pairs]) ^ _ONES, np.concatenate([of, of[second]]), np.bincount(of, minlength=len(texts))


def bucket_counts(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How many features all texts of a table have in each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for (texts,) in blocks(batches, ["text"], 1 << 20):
            total += np.bincount(features(texts)[0] % buckets, minlength=buckets)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["total"])

    rdd = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "total binary").rdd
    if not rdd.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return rdd.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(lambda a, b: a + b)


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, with one count more in every bucket."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _noise(seed: int, i: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of each row."""
    buckets, shared = len(gains), docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        gain = shared.value
        for ids, texts in blocks(batches, ["id", "text"], 1 << 20):
            hashes, of, n_words = features(texts)
            n = np.bincount(of, minlength=len(texts))
            total = np.bincount(of, weights=gain[hashes % buckets], minlength=len(texts)).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            score = weight + np.array([_noise(seed, i) for i in ids], np.int64)
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in (n, n_words, weight, score))], ["doc_id", "n_features", "n_words", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; ``rank`` counts what is drawn from 1, null for the others.

    ``percent`` (rounded down) of the rows with at least ``least_words`` words are drawn, those of the highest scores; ties go
    to the smaller id, and rows alike in both to fewer features, then to the smaller weight.  ``weight`` is the floored mean
    of the gains of a text's features (0 without any), and ``score`` adds Gumbel noise that depends on ``seed`` and the id (a
    null id counts as empty text, and comes first in ties).  A null text has no features; if the target has none, gains only
    say what is rare in ``docs``.  Rows with repeated ids are drawn each on their own; an empty table gives no rows; other
    columns are not read.

    Scores are whole numbers within the logs of 64-bit counts and of 32-bit noise, so there are at most some 250,000: how many rows lie above each is a
    table of that size, added up in one task, and within one score rows are numbered by a window.  Noise spreads the rows:
    a score has at most 0.04 % of the rows of any one weight.
    """
    gains = gains_of(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = save(weigh(docs, gains, seed, id_col, text_col), "weights")
    able = rows.where(F.col("n_words") >= least_words)
    scores = able.groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    starts = scores.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    drawn = able.count() * percent // 100
    turn = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight"))
    numbered = able.withColumn("turn", turn).join(F.broadcast(starts), "score").withColumn("rank", (F.col("above") + F.col("turn")).cast("long"))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*rest.columns).unionByName(rest)
    return out.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank")
