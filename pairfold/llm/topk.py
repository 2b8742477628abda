"""Exact top-k inner products by pivot-table elimination.

Candidates are dealt into chunks.  A chunk's pivots are some of its own vectors, each the one farthest from those before, and
its table holds every candidate's distance to every pivot.  A query's distances to the pivots then bound its distance to
each candidate from below: by the largest difference of the two distances to a pivot, and, as vectors are Euclidean, by all
pivots at once, which is tighter.  Distances to the pivots and norms give the inner products with the pivots and so the
coordinates in the space that the pivots span; what is left of a vector outside it is a length, and two such remainders are
at best parallel.  With the norms, the largest lower bound of the distance is an upper bound of the inner product.  A query
evaluates candidates in the order of that bound and stops once no bound left reaches its k-th best score.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairfold.llm.common import save

#: Bytes of vectors in a chunk at most.
_CHUNK_BYTES = 64 << 20
#: Rows of a chunk that are worth a task of their own.
_LEAST_ROWS = 1 << 14


def farthest_first(vectors: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` different vectors, each the farthest from those chosen before."""
    if not len(vectors):
        return vectors
    chosen, far = [0], ((vectors - vectors[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(vectors)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
    return vectors[chosen]


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _floored(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * 1024.0)


class PivotTable:
    """Candidates with their distances to pivots; gives upper bounds of inner products with queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: int, sample: int) -> None:
        self.ids, self.vectors = ids, vectors
        self.pivots = farthest_first(vectors[:sample], min(pivots, max(1, 3 * vectors.shape[1] // 4)))
        self.squares = (self.pivots**2).sum(1)
        values, axes = np.linalg.eigh(self.pivots @ self.pivots.T)
        some = values > 1e-6 * max(values[-1], 1e-300)
        self.to_axes = axes[:, some] / np.sqrt(values[some])
        self.distances = pivot_distances(vectors, self.pivots)
        self.norms = (vectors**2).sum(1)
        self.places, self.rest = self._spanned(self.norms, self.distances)

    def _spanned(self, norms: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates in the space of the pivots, and the length of what is outside it, from norms and distances."""
        places = (norms[:, None] + self.squares - distances**2) / 2 @ self.to_axes
        return places, np.sqrt(np.maximum(norms - (places**2).sum(1), 0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query, an upper bound of its inner product with each candidate; rounding is allowed for."""
        norms = (queries**2).sum(1)
        places, rest = self._spanned(norms, pivot_distances(queries, self.pivots))
        slack = 1e-7 * np.sqrt(norms)[:, None] * np.sqrt(self.norms.max(initial=0.0)) + 1e-6
        return places @ self.places.T + rest[:, None] * self.rest + slack


class Search:
    """The k best candidates of a chunk for each query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, pivots: int = 48, sample: int = 2048, step: int = 256) -> None:
        self.ids, self.vectors, self.k, self.step = ids, vectors, k, step
        self.largest = np.abs(vectors).max(initial=0.0)
        self.pivots, self.sample, self.table = pivots, sample, None
        self.asked = self.evaluated = 0

    def best(self, query_ids: np.ndarray, queries: np.ndarray):
        """(ids, scores) for each query, the best first, ties by smaller ids."""
        if self.largest * np.abs(queries).max(initial=0.0) * queries.shape[1] >= 2.0**53:  # not exact in doubles: integers of any size
            whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
            own = whole(self.vectors)
            for i, q in zip(query_ids, whole(queries), strict=True):
                other = self.ids != i
                yield self._merge((np.zeros(0, np.int64), np.zeros(0, object)), self.ids[other], own[other] @ q)
            return
        self.table = self.table or PivotTable(self.ids, self.vectors, self.pivots, self.sample)
        for a in range(0, len(queries), 64):
            part = queries[a : a + 64]
            for i, q, upper in zip(query_ids[a : a + 64], part, self.table.bounds(part), strict=True):
                yield self._one(i, q, upper)

    def _one(self, query_id: int, query: np.ndarray, upper: np.ndarray):
        found = np.zeros(0, np.int64), np.zeros(0)
        upper = np.where(self.ids == query_id, -np.inf, upper)
        left, n = len(upper), min(len(upper), max(self.k, 16))
        self.asked += left
        tried = np.zeros(left, bool)
        while left:  # the next ones in the order of bounds, twice as many each time
            order = np.argpartition(-upper, n - 1)[:n] if n < len(upper) else np.arange(len(upper))
            order = order[~tried[order]]
            order = order[np.argsort(-upper[order], kind="stable")]
            for a in range(0, len(order), self.step):
                part = order[a : a + self.step]
                if upper[part[0]] == -np.inf or len(found[1]) == self.k and upper[part[0]] < found[1][-1] - 0.5:
                    return found
                part = part[upper[part] > -np.inf]
                self.evaluated += len(part)
                found = self._merge(found, self.ids[part], self.vectors[part] @ query)
            tried[order] = True
            left -= len(order)
            n = min(len(upper), 4 * n)
        return found

    def _merge(self, found, ids: np.ndarray, scores: np.ndarray):
        all_ids, all_scores = np.append(found[0], ids), np.append(found[1], scores)
        order = np.argsort(all_ids, kind="stable")
        order = order[np.argsort(-all_scores[order], kind="stable")][: self.k]
        return all_ids[order], all_scores[order]


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 10, pivots: int = 48, sample: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding", chunk_bytes: int = _CHUNK_BYTES, least_rows: int = _LEAST_ROWS) -> DataFrame:
    """Each query's k best rows of ``embeddings``: (query_id long, rank int, vec_id long, score long).

    Components become floor(1024 * x), x as double; the score is the integer inner product, ties go to smaller ids, and
    rows with the query's own id are no candidates.  Vectors that are null, empty, or hold null or non-finite components
    take no part, nor do rows with a null id; vectors of another length than a query's are no candidates for it.  A
    candidate row that occurs twice counts twice, and so does a query's.  Scores beyond a long are cut to its range, and
    those beyond 38 digits tie.  No queries or no candidates give no rows.

    One plan whatever the number of queries: candidates are dealt into chunks of at most ``chunk_bytes``, and all queries go to
    each chunk, whose task holds it and lets them pass by.  Nothing is broadcast or collected but the number of rows and
    the largest length.  What chunks find, k rows a query, is merged by query.  Each chunk draws ``pivots`` pivots, three
    quarters of the dimensions at most, from ``sample`` of its rows; they affect the work alone, never the result.

    Rows are numbered once, in tables saved to the shared folder, so a task that runs again after a lost executor deals
    them as before, whatever order the input's own tasks give them in.
    """
    number = F.monotonically_increasing_id()
    candidates, asked = (save(_valid(df, id_col, vec_col).withColumn("number", number), name) for df, name in ((embeddings, "candidates"), (queries, "asked")))
    rows, longest = candidates.agg(F.count("*"), F.max(F.size("v"))).first()
    tasks = embeddings.sparkSession.sparkContext.defaultParallelism
    each = max(1, min(chunk_bytes // (8 * (longest or 1)), max(least_rows, -(-rows // (4 * tasks)))))
    chunks = max(1, -(-rows // each))
    own = candidates.select(F.pmod("number", F.lit(chunks)).cast("int").alias("chunk"), F.lit(None).cast("long").alias("query"), "id", "v")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.col("number").alias("query"), "id", "v")
    dealt = own.union(every).repartition(chunks, "chunk").sortWithinPartitions("chunk", F.col("query").asc_nulls_first())
    done = dealt.mapInArrow(_pass(k, pivots, sample), "query long, query_id long, vec_id long, score decimal(38,0)")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = done.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    low, high = F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return ranked.select("query_id", "rank", "vec_id", F.least(F.greatest("score", low), high).cast("long").alias("score"))


def _valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return out.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def _by_length(batch: pa.RecordBatch):
    """(numbers of queries, ids, vectors) for each length of vectors in a batch."""
    v = batch.column(3)
    sizes = np.diff(v.offsets.to_numpy())
    for size in np.unique(sizes):
        at = pa.array(np.flatnonzero(sizes == size))
        part = batch.take(at)
        vectors = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        yield part.column(1), part.column(2).to_numpy(zero_copy_only=False), _floored(vectors)


def _pass(k: int, pivots: int, sample: int):
    limit = 10**38 - 1

    def run(batches):
        chunk, held, searches = None, {}, {}  # candidates by length: lists of arrays, and then what searches them
        for whole in batches:
            numbers = whole.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), whole.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if numbers[a] != chunk:
                    chunk, held, searches = numbers[a], {}, {}
                part = whole.slice(a, b - a)
                n = part.column(1).null_count  # candidates come first
                for _, ids, vectors in _by_length(part.slice(0, n)):
                    held.setdefault(vectors.shape[1], []).append((ids, vectors))
                for start in range(n, part.num_rows, 1024):
                    for query, ids, vectors in _by_length(part.slice(start, 1024)):
                        size = vectors.shape[1]
                        if size in held:
                            searches[size] = Search(np.concatenate([i for i, _ in held[size]]), np.concatenate([v for _, v in held.pop(size)]), k, pivots, sample)
                        if size in searches:
                            yield from _found(query.to_pylist(), ids, searches[size].best(ids, vectors))

    def _found(query: list[int], ids: np.ndarray, best):
        columns: tuple[list, list, list, list] = ([], [], [], [])
        for number, own, (found, scores) in zip(query, ids.tolist(), best, strict=True):
            exact = [Decimal(max(-limit, min(limit, int(s)))) for s in scores]
            for column, more in zip(columns, ([number] * len(found), [own] * len(found), found.tolist(), exact), strict=True):
                column.extend(more)
        yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.decimal128(38, 0))], ["query", "query_id", "vec_id", "score"])

    return run
