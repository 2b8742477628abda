"""Language identification with string kernels.

A text is the sets of its letter n-grams of length 1 to 3 (a blended spectrum; presence, not counts), hashed into fixed
spaces.  The kernel of two texts is the mean over the lengths of the cosine of their sets.  Nystroem landmarks, a few texts
of each language, turn it into features; kernel ridge regression on those learns one scorer for each language against the
rest.  Scoring a batch is two matrix products: presence by landmarks, and kernel values by weights.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.llm.common import blocks

#: Bits of the space into which n-grams of each length are hashed.
_BITS = (10, 12, 14)
_SIZES = [1 << b for b in _BITS]
_STARTS = np.cumsum([0, *_SIZES])
UNKNOWN = "und"
#: Rows of a presence matrix, 21,504 single-precision numbers each.
_ROWS = 256


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            out[c] = ord(low) if len(low := s.lower()) == 1 else c
    return out


def grams(text: str) -> list[np.ndarray] | None:
    """Hashed n-grams of each length, with repeats; None for a text without letters."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[raw]
    if not (c != 32).any():
        return None
    c = np.concatenate([np.full(1, 32, np.uint32), c, np.full(2, 32, np.uint32)])
    out, h = [], np.zeros(len(c), np.uint32)
    for n, bits in enumerate(_BITS):
        h = (h[: len(c) - n] ^ c[n:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append(((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.int64))
    return out


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """0/1 matrix of n-grams by text, and which texts have letters."""
    out, some = np.zeros((len(texts), _STARTS[-1]), np.float32), np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        if t and (found := grams(t)) is not None:
            some[i] = True
            for start, g in zip(_STARTS, found, strict=False):
                out[i, start + g] = 1
    return out, some


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows whose inner products are the kernel, in place."""
    for a, b in zip(_STARTS[:-1], _STARTS[1:], strict=True):
        matrix[:, a:b] /= np.sqrt(np.maximum(matrix[:, a:b].sum(1, keepdims=True), 1) * len(_BITS))
    return matrix


class Model:
    """Landmarks (scaled presence rows), weights from kernel values to scores in -1..1, and the languages in order."""

    def __init__(self, rows: np.ndarray, labels: list[str], landmarks: int, ridge: float) -> None:
        self.languages = sorted(set(labels))
        y = np.array([self.languages.index(x) for x in labels], np.int64)
        if not len(y):
            self.landmarks, self.weights, self.bias = np.zeros((0, _STARTS[-1]), np.float32), np.zeros((0, 0), np.float32), np.zeros(0)
            self.seen, self.strangest = np.zeros(_STARTS[-1], np.float32), 0.0
            return
        turn = np.zeros(len(y), np.int64)  # a text's number among those of its language
        for k in range(len(self.languages)):
            turn[y == k] = np.arange((y == k).sum())
        halves = [rows[turn % 2 == i] > 0 for i in (0, 1)]
        seen = [h.any(0).astype(np.float32) for h in halves]
        #: N-grams that the examples have, and the lowest familiarity of an example with the other half of them.
        self.seen = np.maximum(*seen)
        self.strangest = min((float(self.familiarity(h, s).min()) for h, s in zip(halves, seen[::-1], strict=True) if len(h)), default=0.0)
        self.landmarks = rows[np.lexsort((y, turn))[: max(landmarks, len(self.languages))]]
        values, vectors = np.linalg.eigh((self.landmarks @ self.landmarks.T).astype(np.float64))
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = (rows @ self.landmarks.T).astype(np.float64) @ root
        target = np.where(y[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        share = 1 / np.bincount(y)[y]  # each language weighs the same
        mean, aim = (features * share[:, None]).sum(0) / share.sum(), (target * share[:, None]).sum(0) / share.sum()
        x = features - mean
        w = np.linalg.solve((x * share[:, None]).T @ x + ridge * np.eye(x.shape[1]), (x * share[:, None]).T @ (target - aim))
        self.weights = (root @ w).astype(np.float32)
        self.bias = aim - mean @ w

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.landmarks.T @ self.weights + self.bias

    def familiarity(self, rows: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        """Of each presence row, the share of n-grams of two letters and more that the examples have."""
        seen = self.seen if seen is None else seen
        return rows[:, _STARTS[1] :] @ seen[_STARTS[1] :] / np.maximum(rows[:, _STARTS[1] :].sum(1), 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], np.ndarray]:
        """Language, score and familiarity of each text."""
        rows, some = presence(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), np.zeros(len(texts))
        familiar = self.familiarity(rows)
        scores = self.scores(scaled(rows))
        best = scores.argmax(1)
        top = np.clip((scores[np.arange(len(texts)), best] + 1) / 2, 0, 1)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.where(some, top, 0.0).tolist(), familiar


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, landmarks: int = 64, ridge: float = 1e-3, most_languages: int = 256) -> Model:
    """Fit a model on at most ``per_language`` rows of each language, those with the smallest hashes of their ids.

    That bound is a parameter since a classifier of a few languages is settled by some hundred texts; rows without a
    language or without letters are no examples.  A pass counts the languages; another draws a share of each that holds
    the bound with room to spare, as packed presence bits of whole texts (some KB a row), of which the excess is left out.  A model learns ``most_languages`` languages at most, those with the most
    rows, so a column of free text where languages should be can't fill the driver.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    shares = counts.select("lang", F.least(F.lit(1.0), (1.5 * per_language + 20) / F.col("count")).alias("_share"))
    place = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.withColumn("place", place).join(F.broadcast(shares), "lang").where(F.col("place") < F.col("_share"))

    def bits(batches):
        for place, texts, langs in blocks(batches, ["place", "text", "lang"], 1 << 20):
            for a in range(0, len(texts), _ROWS):
                matrix, some = presence(texts[a : a + _ROWS])
                packed = [p.tobytes() for p in np.packbits(matrix[some].astype(bool), axis=1)]
                keep = np.flatnonzero(some) + a
                yield pa.record_batch([pa.array([place[i] for i in keep], pa.float64()), pa.array([langs[i] for i in keep], pa.string()), pa.array(packed, pa.binary())], ["place", "lang", "bits"])

    found = sorted(drawn.select("place", "text", "lang").mapInArrow(bits, "place double, lang string, bits binary").collect(), key=lambda r: (r["lang"], r["place"], r["bits"]))
    taken, used = [], {}
    for r in found:
        if used.setdefault(r["lang"], 0) < per_language:
            used[r["lang"]] += 1
            taken.append(r)
    matrix = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=_STARTS[-1]) for r in taken], np.float32).reshape(len(taken), _STARTS[-1])
    return Model(scaled(matrix), [r["lang"] for r in taken], landmarks, ridge)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 20) -> DataFrame:
    """(id_col, lang_pred, score) of each row's whole text.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned.  The score
    is the best language's, moved from -1..1 to 0..1 and cut there; ties go to the first language by name.  Repeated rows
    and null ids each give a row; other columns are not read.
    """

    def run(batches):
        for ids, texts in blocks(batches, ["id", "text"], block):
            for a in range(0, len(ids), _ROWS):
                langs, scores = model.predict(texts[a : a + _ROWS])
                yield pa.record_batch([pa.array(ids[a : a + _ROWS], pa.int64()), pa.array(langs), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", part: int = 3, rest: int = 1):
    """Whether crc32 of the id as text leaves ``rest`` when divided by ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % part == rest, F.lit(False))


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least_familiar: float = 0.6) -> DataFrame:
    """The rows of ``docs`` in a language that was learned, with all columns as they came.

    One-versus-rest scores can't tell: short texts and texts of two learned languages score as low as texts of none.  What
    does is the share of a text's n-grams of two and three letters that the examples have: a row goes if that is below
    ``least_familiar`` times the lowest share that an example has in common with the other half of the examples, so few
    examples reject little.  Labelled rows of the test tables have 0.88 at least; Chinese, Greek and Russian have under 0.45.

    Each row is judged by its own text, so rows with one id may part, and a null or repeated id changes nothing.  A null text and
    one without letters go whatever ``least_familiar`` is.  If nothing was learned (no row with a language), nothing can be rejected by
    its language, so every text with a letter stays.  An empty table stays empty.
    """
    schema = docs.schema
    known, least = bool(model.languages), least_familiar * model.strangest

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, _ROWS):
                part = b.slice(a, _ROWS)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                if known:
                    langs, _, familiar = model.judge(texts)
                    keep = [x != UNKNOWN and s >= least for x, s in zip(langs, familiar, strict=True)]
                else:
                    keep = [bool(t) and any(c.isalpha() for c in t) for t in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
