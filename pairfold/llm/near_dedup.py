"""Near-duplicate groups by MinHash: banded candidates, sequential Bayesian pruning, exact verification.

Documents with the same words are one class.  Class representatives get MinHash signatures, whose bands put them into
buckets.  In each bucket, members are first paired with one centre, the smallest id, so a group of m near copies gives m - 1
candidates instead of m * (m - 1) / 2.  A candidate's signatures are compared batch by batch: with m of n hashes equal and a uniform
prior, the posterior probability that the similarity reaches the threshold is that of at most m successes in n + 1 trials;
below the chosen miss probability the pair is dropped.  Survivors are verified on their full shingle sets.  Verified links
give components.  Pairs within a component can't change the result, so what is left are members of a bucket outside its
largest component.  They find their partners among all members of such buckets by their rarest shingles: two sets with the
similarity asked for share at least o shingles, so with each set's shingles in order of rising frequency, the first that
both have is among the first n - o + 1 of either.  Those that meet so are pairs only if their parity sketches, of which
every shingle that one set alone has turns one bit, differ in no more bits than the sets may differ in shingles.  Both
filters are exact.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairfold.llm.common import attach, blocks, forget, free_name, save
from pairfold.llm.components import components

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Most rounds in which buckets with members outside their largest component get another centre.
ROUNDS = 6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, in UTF-8 (bytes.split and bytes.lower know ASCII alone)."""
    return text.encode().lower().split()


def shingle_set(tokens: list[bytes], k: int) -> set:
    """Distinct k-word shingles; with fewer words, the whole sequence as one; none without words."""
    if len(tokens) < k:
        return {tuple(tokens)} if tokens else set()
    return set(zip(*(tokens[i:] for i in range(k)), strict=False))


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of words: a polynomial over their bytes, mixed."""
    buf = np.frombuffer(b"\n".join(tokens) + b"\n", np.uint8)
    gap = np.flatnonzero(buf == 10)
    start = np.append(0, gap[:-1] + 1)
    size = gap - start + 1
    power = _powers(int(size.max()))
    place = np.arange(len(buf)) - np.repeat(start, size)
    return _mix(np.add.reduceat((buf.astype(np.uint64) + np.uint64(1)) * power[place], start))


@lru_cache(8)
def _powers_upto(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.uint64(1), np.full(n - 1, 0xD6E8FEB86659FD93, np.uint64)))


def _powers(n: int) -> np.ndarray:
    return _powers_upto(1 << max(6, (n - 1).bit_length()))


def shingle_hashes(tokens: list[bytes], k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingle set, sorted."""
    if not tokens:
        return np.zeros(0, np.uint64)
    w = word_hashes(tokens)
    n = max(1, len(w) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(w))):
        out = _mix(out ^ w[i : i + n])
    return np.unique(out)


#: Columns of a set's parity sketch.
_PARITIES = [f"odd{i}" for i in range(16)]


def parity(hashes: np.ndarray) -> np.ndarray:
    """1024 bits: whether each has an odd number of the set's hashes.  A shingle that only one of two sets has turns one bit, so
    their difference has at least as many shingles as the sketches have different bits."""
    odd = np.bincount((hashes & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Sketcher:
    """MinHash signatures of bands * rows 32-bit values, by affine permutations of the shingles' high halves."""

    def __init__(self, k: int, bands: int, rows: int, seed: int = 1) -> None:
        self.k, self.bands, self.rows = k, bands, rows
        draw = np.random.default_rng(seed)
        n = bands * rows
        self.a = (draw.integers(0, 1 << 31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = draw.integers(0, 1 << 32, n, dtype=np.uint32)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        x, out = (hashes >> np.uint64(32)).astype(np.uint32), None
        for i in range(0, len(x), 1024):
            low = (self.a[:, None] * x[None, i : i + 1024] + self.b[:, None]).min(1)
            out = low if out is None else np.minimum(out, low)
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key for each row and band."""
        s = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), s.shape[:2])
        for i in range(self.rows):
            key = _mix(key ^ s[:, :, i])
        return key.view(np.int64)


def sketch(docs: DataFrame, sketcher: Sketcher, id_col: str, text_col: str) -> DataFrame:
    """(id, digest of the word sequence, n_shingles, signature) of each row; null digest and signature without words."""

    def run(batches):
        for ids, texts in blocks(batches, ["id", "text"], 2 << 20):
            digests, sizes, signatures = [], [], []
            for t in texts:
                tokens = words(t)
                hashes = shingle_hashes(tokens, sketcher.k)
                sizes.append(len(hashes))
                digests.append(hashlib.blake2b(b" ".join(tokens), digest_size=16).digest() if tokens else None)
                signatures.append(sketcher.signature(hashes).tobytes() if len(hashes) else None)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())], ["id", "digest", "n_shingles", "signature"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, digest binary, n_shingles long, signature binary")


def fewest_matches(threshold: float, miss: float, batch: int, total: int) -> list[tuple[int, int]]:
    """(n, least m) after each batch: with fewer equal hashes of n, the posterior of reaching the threshold is under ``miss``."""
    out = []
    for n in range(batch, total + 1, batch):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def prune(pairs: DataFrame, sketches: DataFrame, threshold: float, miss: float, batch: int, total: int) -> DataFrame:
    """The candidates (a, b) whose signatures do not rule them out."""
    limits = fewest_matches(threshold, miss, batch, total)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in (2, 3))
            alive, same = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for n, least in limits:
                same = same + (left[alive, n - batch : n] == right[alive, n - batch : n]).sum(1)
                alive, same = alive[same >= least], same[same >= least]
            yield b.select([0, 1]).take(pa.array(alive))

    s = sketches.select("id", "signature")
    both = pairs.join(s.withColumnsRenamed({"id": "a", "signature": "sa"}), "a").join(s.withColumnsRenamed({"id": "b", "signature": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def set_sizes(left: list[bytes], right: list[bytes], k: int) -> tuple[int, int, int]:
    """Sizes of two word sequences' shingle sets and of their intersection.

    Sets of tuples take some hundred bytes a word; in longer texts, words and then shingles get numbers instead, which
    takes a few dozen, so texts of any length fit one pair at a time.
    """
    if min(len(left), len(right)) < k or len(left) + len(right) < 1 << 13:
        x, y = shingle_set(left, k), shingle_set(right, k)
        return len(x), len(y), len(x & y)
    number = {w: i for i, w in enumerate({*left, *right})}
    w = np.fromiter(map(number.__getitem__, left + right), np.int64, len(left) + len(right))
    now = w
    for i in range(1, k):  # numbers of the sequences of i + 1 words; those that straddle the texts are left out below
        now = now[:-1] * len(number) + w[i:]
        now = np.unique(now, return_inverse=True)[1]
    x, y = np.unique(now[: len(left) - k + 1]), np.unique(now[len(left) :])
    return len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets; texts: (id, text)."""

    def run(batches):
        last = None, []  # a centre's pairs often follow each other

        for a, b, ta, tb in blocks(batches, ["a", "b", "ta", "tb"], 2 << 20):
            ok = []
            for i, x, y in zip(a, ta, tb, strict=True):
                if last[0] != (i, x):
                    last = (i, x), words(x)
                nx, ny, both = set_sizes(last[1], words(y), k)
                ok.append(100 * both >= percent * (nx + ny - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep)], ["a", "b"])

    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 30, rows: int = 4, miss: float = 1e-9, batch: int = 20) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_shingles, component_id, kept).

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct ``shingle``-word shingles;
    component_id is the smallest id reachable by links.  With fewer words than a shingle, the whole sequence is the only
    one, so such texts link only with texts of the same words.  Longer texts that repeat one word have the same set whatever
    their length.  Null, empty and blank texts have n_shingles 0 and link with nothing.  Rows with the same id are the same
    document: links of each count for all.  A row with a null id takes no part in links, has a null component_id and stays.
    An empty table gives an empty result.  Other columns are not read.  A pair at the threshold is missed by all bands with
    probability (1 - t ** rows) ** bands (1.4e-7 at 0.8), and pruned with at most ``miss`` after each batch; nothing is capped.
    """
    threshold, sketcher = percent / 100, Sketcher(shingle, bands, rows)
    done = save(sketch(docs, sketcher, id_col, text_col), "sketch")
    classes = save(done.where("digest is not null and id is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("id")), "classes")
    total = done.count()
    reps = save(done.where("signature is not null").join(classes.select("id"), "id", "left_semi").select("id", "signature", F.col("n_shingles").alias("size")), "reps")

    def keys(batches):
        for b in batches:
            if b.num_rows:
                ids = np.array(b.column(0).to_pylist(), np.int64)
                found = sketcher.band_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1))
                yield pa.record_batch([pa.array(found.ravel()), pa.array(np.repeat(ids, sketcher.bands))], ["key", "id"])

    in_band = reps.select("id", "signature").mapInArrow(keys, "key long, id long")
    buckets = save(in_band.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("centre")).where("n > 1"), "buckets")
    members = save(attach(in_band, buckets, "key", "n", total * bands, F.col("id")).where("centre is not null").select("key", "id", "centre"), "members")
    stars = save(members.where("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = save(texts.join(members.select("id").distinct(), "id", "left_semi"), "texts")

    def links(pairs: DataFrame) -> DataFrame:
        likely = save(prune(pairs, reps, threshold, miss, batch, bands * rows), "likely")
        out = save(verify(likely, texts, shingle, percent), "links")
        forget(likely)
        return out

    linked = first = links(stars)
    of, compared, turns, asked, found = components(linked), stars, [], 1, 1
    while found * 50 >= asked and len(turns) < ROUNDS * 2:
        fresh = _next_stars(members, of, compared, len(turns) // 2)
        more = links(fresh)
        turns += [fresh, more]
        asked, found, compared = fresh.count(), more.count(), compared.union(fresh)
        if not found:
            break
        linked, parts = linked.union(more), of
        of = components(linked)
        forget(parts)
    rest = _across(members, of, reps, texts, compared, shingle, percent)
    if rest is not None:
        more = links(rest)
        if not more.isEmpty():
            parts, of = of, components(linked.union(more))
            forget(parts)
        forget(rest, more)
    forget(members, buckets, stars, texts, first, *turns)

    merged = classes.join(of, "id", "left").select("digest", "n", F.coalesce("component", "id").alias("component"), "id")
    merged = save(merged.where("n > 1 or component != id").select("digest", "n", "component"), "merged")
    forget(classes, reps, of)
    out = attach(done.select("id", "digest", "n_shingles"), merged, "digest", "n", total, F.col("id"))
    part = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", part.alias("component_id"), F.col("id").eqNullSafe(part).alias("kept"))


def _placed(members: DataFrame, of: DataFrame) -> DataFrame:
    return members.select("key", "id").join(of, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))


def _next_stars(members: DataFrame, of: DataFrame, compared: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b), not compared yet, of each bucket's members outside its largest component with one drawn member of that."""
    placed = _placed(members, of)
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64(F.lit(turn), "key", "id")).alias("centre"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max_by(F.struct("component", "centre"), "n").alias("at")).where("parts > 1")
    mixed = save(mixed.select("key", "n", F.col("at.component").alias("largest"), F.col("at.centre").alias("centre")), "mixed")
    total = mixed.agg(F.sum("n")).first()[0] or 0
    met = attach(placed, mixed, "key", "n", total, F.col("id")).where("component != largest")
    pairs = met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    out = save(pairs.join(compared, ["a", "b"], "left_anti"), "stars")
    forget(mixed)
    return out


def _across(members: DataFrame, of: DataFrame, reps: DataFrame, texts: DataFrame, compared: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Pairs in different components that may reach the threshold and are not compared yet; None if no bucket is mixed."""
    placed = _placed(members, of)
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = save(sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max_by("component", "n").alias("largest")).where("parts > 1"), "mixed")
    if mixed.isEmpty():
        return None
    total = mixed.agg(F.sum("n")).first()[0]
    inside = attach(placed, mixed.select("key", "n", "largest"), "key", "n", total, F.col("id")).where("largest is not null")
    inside = inside.groupBy("id", "component").agg(F.max(F.col("component") != F.col("largest")).alias("outer"))
    inside = scored = save(inside.join(reps.select("id", "size"), "id"), "inside")

    def shingles(batches):
        for ids, found in blocks(batches, ["id", "text"], 1 << 20):
            hashes = [shingle_hashes(words(t), k).view(np.int64) for t in found]
            n = np.array([len(h) for h in hashes])
            yield pa.record_batch([pa.array(np.concatenate(hashes)), pa.array(np.repeat(np.array(ids), n), pa.int64())], ["shingle", "id"])

    def parities(batches):
        for ids, found in blocks(batches, ["id", "text"], 1 << 20):
            odd = np.array([parity(shingle_hashes(words(t), k)) for t in found])
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c) for c in np.ascontiguousarray(odd.T))], ["id", *_PARITIES])

    inner = inside.join(texts, "id").select("id", "text")
    rows = save(inner.mapInArrow(shingles, "shingle long, id long"), "shingles")
    odd = save(inner.mapInArrow(parities, ", ".join(["id long", *(f"{c} long" for c in _PARITIES)])), "parities")
    inside = inside.join(odd, "id")
    often = save(rows.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1"), "often")
    shared = attach(rows, often, "shingle", "often", rows.count(), F.col("id")).where("often is not null")
    shared = save(shared, "shared")
    own = Window.partitionBy("id")
    order = shared.withColumns({"own": F.count("*").over(own), "turn": F.row_number().over(own.orderBy("often", "shingle"))})
    order = order.join(inside, "id").withColumn("place", F.col("size") - F.col("own") + F.col("turn") - 1)
    first = save(order.where(f"place <= size - ceil({percent} * size / 100)").select("shingle", "id", "size", "component", "outer", "place", *_PARITIES), "first")
    probes = first.where("outer").select("shingle", F.col("id").alias("x"), F.col("size").alias("nx"), F.col("component").alias("cx"), F.col("place").alias("px"), *[F.col(c).alias(f"x_{c}") for c in _PARITIES])
    least = f"ceil({percent} * (nx + size) / {100 + percent})"
    differ = " + ".join(f"bit_count({c} ^ x_{c})" for c in _PARITIES)
    both = probes.join(first.drop("outer"), "shingle").where(f"cx != component and least(nx - px, size - place) >= {least} and {differ} <= nx + size - 2 * {least}")
    pairs = both.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
    out = save(pairs.join(compared, ["a", "b"], "left_anti"), "rest")
    forget(mixed, scored, rows, odd, often, shared, first)
    return out


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that :func:`near_dedup` keeps, with all columns as they came."""
    name = free_name(docs, "_gone")
    gone = near_dedup(docs, id_col, text_col, **how).where(~F.col("kept")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")
