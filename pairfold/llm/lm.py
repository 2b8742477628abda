"""A gated recurrent language model with a class-factored softmax, in numpy.

Counts of all words of the training texts give the base model and the vocabulary: the most frequent words are head words,
in classes of similar frequency; all others are tail words, classed by their length; the end of a text is a class of its
own.  The network reads a text word by word and gives the next word's class, and within a head class the word.  Within a
tail class a word has its share of the class's counts, so every word, unseen ones too, has a probability.

Documents lie end to end in lanes that a batch reads side by side, in windows of some steps; the state is carried from
window to window until a document ends, so each is scored whole.  Training goes back through one window (truncated
backpropagation) by the same lanes: every task trains on its own texts, and the tasks' weights are averaged by words seen,
for some rounds that share out the texts.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.llm.common import blocks, save

#: Tail classes: by length in bytes, two lengths to a class, the longest together.
TAILS = 8
#: Rows of a window whose softmax over classes is done at once.
_ROWS = 1024

#: Shares of the learning rate for the offsets, which begin as the corpus's own frequencies.
_PACE = {"bc": np.float32(0.1), "bo": np.float32(0.02)}


def words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, in UTF-8."""
    return text.encode().lower().split()


def tail_class(word: bytes) -> int:
    return min((len(word) - 1) // 2, TAILS - 1)


def _sigmoid(x: np.ndarray) -> None:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5


def _softmax(raw: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of (choice, row) moved so that their exponentials neither overflow nor vanish, those, and their sums by row.

    One maximum for all rows does, and is much faster, unless some row is so far below it that nothing of it is left.
    """
    ones = np.ones(len(raw), np.float32)
    raw += offset[:, None]
    raw -= raw.max()
    exp = np.exp(raw)
    norm = ones @ exp
    if norm.min() < 1e-20:
        raw -= raw.max(0)
        exp = np.exp(raw)
        norm = ones @ exp
    return raw, exp, norm


class Vocabulary:
    """Head words with their training counts, and what the counts of all words sum to.

    ``known`` words have counts at hand; of those the first ``classes * members`` by count are head words.  A token is its
    head word's number, or S + tail class, or S + TAILS for the end of a text.
    """

    def __init__(self, known: list[tuple[bytes, int]], tails: list[tuple[int, int]], total: int, distinct: int, docs: int, classes: int, members: int) -> None:
        self.total, self.distinct, self.docs = total, distinct, docs  # of training tokens; docs is the count of ends
        self.classes, self.members = classes, members
        ordered = sorted(known, key=lambda x: (-x[1], x[0]))
        self.words = {w: i for i, (w, _) in enumerate(ordered)}
        self.counts = np.array([c for _, c in ordered], np.float64)
        self.heads = int(min(classes * members, (self.counts > 0).sum()))
        self.size = classes * members
        self.tokens = np.array([i if i < self.heads else self.size + tail_class(w) for i, (w, _) in enumerate(ordered)], np.int64)
        # tails: counts and words of each tail class among all words, head words included; those are taken out again
        self.tail_counts, self.tail_words = (np.array([t[k] for t in tails], np.float64) for k in (0, 1))
        for w, c in ordered[: self.heads]:
            self.tail_counts[tail_class(w)] -= c
            self.tail_words[tail_class(w)] -= 1
        self.tail_cost = np.log10(self.tail_counts + 0.1 * (self.tail_words + 1))
        self.base_cost = math.log10(total + 0.1 * (distinct + 1))

    def encode(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Numbers of known words (-1: not at hand), tokens with the end, and the words not at hand."""
        at = np.fromiter(map(self.words.get, tokens, itertools.repeat(-1)), np.int64, len(tokens))
        out = np.empty(len(at) + 1, np.int64)
        out[:-1] = self.tokens[at] if len(self.tokens) else -1
        out[-1] = self.size + TAILS
        away = [tokens[i] for i in np.flatnonzero(at < 0).tolist()]
        out[:-1][at < 0] = [self.size + tail_class(w) for w in away]
        return at, out, away


class Network:
    """Parameters of the recurrent network, its passes over a window, and Adam."""

    def __init__(self, vocabulary: Vocabulary, hidden: int = 16, seed: int = 7) -> None:
        v, h = vocabulary, hidden
        self.size, self.classes, self.members, self.hidden = v.size, v.classes, v.members, h
        draw = np.random.default_rng(seed)
        normal = lambda *shape, by=0.1: (by * draw.standard_normal(shape)).astype(np.float32)
        groups = v.classes + TAILS + 1
        head = np.zeros(v.size)
        head[: v.heads] = v.counts[: v.heads]
        mass = np.concatenate([head.reshape(v.classes, v.members).sum(1), v.tail_counts, [v.docs]]) + 0.1
        inner = np.where(np.arange(v.size) < v.heads, np.log(head + 0.1), -30.0).reshape(v.classes, v.members)
        self.p = {
            "wx": normal(v.size + TAILS + 1, 3 * h), "u": normal(h, 3 * h, by=0.3), "b": np.zeros(3 * h, np.float32),
            "wc": normal(h, groups), "bc": np.log(mass / mass.sum()).astype(np.float32),
            "wo": normal(v.classes, h, v.members), "bo": inner.astype(np.float32),
        }
        self.group = np.concatenate([np.repeat(np.arange(v.classes), v.members), v.classes + np.arange(TAILS + 1)]).astype(np.int16)
        self.moments, self.steps = None, 0

    def window(self, tokens: np.ndarray, keep: np.ndarray, valid: np.ndarray, state: np.ndarray, rate: float = 0.0):
        """Natural log probabilities (of classes, and of head words within) of a window (step, lane), and the state after it.

        ``keep`` is 0 where a text begins; with a ``rate`` the parameters take a training step.
        """
        p, h, (steps, lanes) = self.p, self.hidden, tokens.shape
        kind = p["u"].dtype
        # by gate (update, reset, new), so that what a step works on lies together
        before, gates = np.empty((steps, lanes, h), kind), np.empty((3, steps, lanes, h), kind)
        for own, table in zip(gates, self._by_gate(p["wx"] + p["b"]), strict=True):
            np.take(table, tokens, axis=0, out=own, mode="clip")
        u, added = self._by_gate(p["u"]), np.empty((2, lanes, h), kind)
        inner = np.empty((steps, lanes, h), kind)  # what the state adds to the new gate
        for t in range(steps):
            hp = np.multiply(state, keep[t][:, None], out=before[t])
            zr, n = gates[:2, t], gates[2, t]
            zr += np.matmul(hp, u[:2], out=added)
            _sigmoid(zr)
            n += np.multiply(zr[1], np.matmul(hp, u[2], out=inner[t]), out=added[1])
            np.tanh(n, out=n)
            state = hp - n
            state *= zr[0]
            state += n
        flat, said, seen = before.reshape(-1, h), tokens.ravel(), valid.ravel()
        group = self.group[said]
        out = np.empty(len(said), kind)
        if rate:
            weigh = seen * np.float32(1 / max(1, seen.sum()))
            grads, back = {k: np.zeros_like(p[k]) for k in ("wc", "bc", "wo", "bo")}, np.empty_like(flat)
        for a in range(0, len(said), _ROWS):  # as many rows as caches hold
            x, at, g = flat[a : a + _ROWS], slice(a, a + _ROWS), group[a : a + _ROWS]
            raw, exp, norm = _softmax(p["wc"].T @ x.T, p["bc"])
            own = g, np.arange(len(g))
            out[at] = raw[own] - np.log(norm)
            if rate:
                exp *= weigh[at] / norm
                exp[own] -= weigh[at]
                grads["wc"] += x.T @ exp.T
                grads["bc"] += exp @ np.ones(len(g), np.float32)
                np.matmul(exp.T, p["wc"].T, out=back[at])
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(self.classes + 1)).tolist()
        order = order[: edges[-1]]  # head words, class by class
        x, member, inside = np.take(flat, order, axis=0), said[order] % self.members, np.empty(len(order), kind)
        rows = np.arange(len(order))
        if rate:
            weigh, inner_back = weigh[order], np.empty_like(x)
        for c in range(self.classes):
            a, b = edges[c], edges[c + 1]
            if a == b:
                continue
            raw, exp, norm = _softmax(p["wo"][c].T @ x[a:b].T, p["bo"][c])
            own = member[a:b], rows[: b - a]
            inside[a:b] = raw[own] - np.log(norm)
            if rate:
                exp *= weigh[a:b] / norm
                exp[own] -= weigh[a:b]
                np.matmul(x[a:b].T, exp.T, out=grads["wo"][c])
                grads["bo"][c] = exp @ np.ones(b - a, np.float32)
                np.matmul(exp.T, p["wo"][c].T, out=inner_back[a:b])
        out[order] += inside
        if rate:
            back[order] += inner_back
            self._backward(tokens, keep, before, gates, inner, back.reshape(steps, lanes, h), grads, rate)
        return out.reshape(steps, lanes), state

    def _by_gate(self, x: np.ndarray) -> np.ndarray:
        """(3, rows, hidden) of a matrix whose columns are those of the three gates."""
        return np.ascontiguousarray(x.reshape(len(x), 3, self.hidden).swapaxes(0, 1))

    def _backward(self, tokens, keep, before, gates, inner, back, grads, rate: float) -> None:
        p, h, (steps, lanes) = self.p, self.hidden, tokens.shape
        z, r, n = gates
        # by what the state's error is multiplied on its way into each gate: all steps at once
        by = np.empty_like(gates)
        np.multiply(1 - z, 1 - n * n, out=by[2])
        np.multiply(by[2] * inner, r * (1 - r), out=by[1])
        np.multiply(before - n, z * (1 - z), out=by[0])
        ut, dh = self._by_gate(p["u"]).swapaxes(1, 2).copy(), np.zeros((lanes, h), back.dtype)
        into_inner, part = np.empty_like(inner), np.empty_like(dh)
        back *= keep[:, :, None]
        z = z * keep[:, :, None]
        for t in range(steps - 1, -1, -1):
            g, s = by[:, t], into_inner[t]
            g *= dh
            now = np.multiply(dh, z[t])
            np.multiply(g[2], r[t], out=s)
            np.matmul(g[0], ut[0], out=dh)
            dh += np.matmul(g[1], ut[1], out=part)
            dh += np.matmul(s, ut[2], out=part)
            dh *= keep[t][:, None]
            dh += now
            dh += back[t]
        state = before.reshape(-1, h).T
        grads["u"] = np.concatenate([state @ g.reshape(-1, h) for g in (by[0], by[1], into_inner)], axis=1)
        flat, said = np.concatenate(by.reshape(3, -1, h), axis=1), tokens.ravel()
        grads["b"] = np.ones(len(flat), flat.dtype) @ flat
        order = np.argsort(said, kind="stable")
        starts = np.flatnonzero(np.diff(said[order], prepend=-1))
        grads["wx"] = np.zeros_like(p["wx"])
        grads["wx"][said[order][starts]] = np.add.reduceat(np.take(flat, order, axis=0), starts)
        self._adam(grads, rate)

    def _adam(self, grads, rate: float, b1: float = 0.9, b2: float = 0.99) -> None:
        if self.moments is None:
            self.moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in self.p.items()}
        self.steps += 1
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        size = np.float32(rate * math.sqrt(1 - b2**self.steps) / (1 - b1**self.steps))
        for k, g in grads.items():
            m, v = self.moments[k]
            g = g * scale
            m += np.float32(1 - b1) * (g - m)
            v += np.float32(1 - b2) * (g * g - v)
            self.p[k] -= size * _PACE.get(k, np.float32(1)) * m / (np.sqrt(v) + np.float32(1e-8))

    def pack(self) -> bytes:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype("<f4").tobytes()

    def unpack(self, raw: bytes) -> Network:
        flat, at = np.frombuffer(raw, "<f4"), 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return self


def lanes_of(sizes: list[int], lanes: int) -> list[list[int]]:
    """Documents by lane, the longest first to the lane that has least; lanes come out longest first."""
    heap = [(0, k) for k in range(min(lanes, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (n + sizes[i], k))
    return sorted(out, key=lambda x: -sum(sizes[i] for i in x))


def read(network: Network, docs: list[np.ndarray], lanes: int, steps: int, rate: float = 0.0) -> np.ndarray:
    """Natural log probability of each document (class and head word terms); with a ``rate``, training on the way."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    plan = lanes_of([len(d) for d in docs], lanes)
    order = [i for lane in plan for i in lane]
    sizes = np.array([len(docs[i]) for i in order])
    tokens, owner = np.concatenate([docs[i] for i in order]), np.repeat(order, sizes)
    keep = np.ones(len(tokens), np.float32)
    keep[np.cumsum(sizes) - sizes] = 0
    lengths = np.array([sum(len(docs[i]) for i in lane) for lane in plan])
    starts = np.cumsum(lengths) - lengths
    state = np.zeros((len(plan), network.hidden), np.float32)
    a = 0
    while a < lengths[0]:  # lanes are ordered by length
        live = int((lengths > a).sum())
        span = steps * max(1, lanes // live)  # where few lanes are left, longer windows: as many tokens, less done step by step
        step = np.arange(a, min(a + span, int(lengths[0])))[:, None]
        a += span
        valid = step < lengths[:live]
        at = np.where(valid, starts[:live] + step, 0)
        logs, state = network.window(tokens[at], keep[at], valid, state[:live], rate)
        out += np.bincount(owner[at[valid]], logs[valid], minlength=len(docs))
    return out


def word_counts(rows: DataFrame, held: int = 500_000) -> DataFrame:
    """(word, c, every): counts of words in training texts and in all; tasks add up theirs first, in bounded tables."""

    def run(batches):
        seen: list[Counter] = [Counter(), Counter()]

        def flush():
            keys = list(seen[0].keys() | seen[1].keys())
            for a in range(0, len(keys), 50_000):
                part = keys[a : a + 50_000]
                own, rest = ([s[w] for w in part] for s in seen)
                yield pa.record_batch([pa.array(part, pa.binary()), pa.array(own, pa.int64()), pa.array([x + y for x, y in zip(own, rest, strict=True)], pa.int64())], ["word", "c", "every"])
            seen[0].clear()
            seen[1].clear()

        for held_out, texts in blocks(batches, ["held_out", "text"], 2 << 20):
            for out, text in zip(held_out, texts, strict=True):
                seen[out].update(words(text))
            if len(seen[0]) + len(seen[1]) > held:
                yield from flush()
        yield from flush()

    counted = rows.select("held_out", "text").mapInArrow(run, "word binary, c long, every long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every"))


def vocabulary(counts: DataFrame, docs: int, known: int, classes: int, members: int) -> Vocabulary:
    """The vocabulary of a counts table; at most ``known`` words, the most frequent, come to the driver."""
    level = F.floor(16 * F.log2("every")).cast("int")
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # some hundred
    least, taken = None, 0
    for b in bins:
        if taken + b["n"] > known:
            break
        least, taken = b["level"], taken + b["n"]
    top = [] if least is None else counts.where(level >= least).select("word", "c").collect()
    size = F.least(F.floor((F.octet_length("word") - 1) / 2), F.lit(TAILS - 1)).cast("int")
    tails = {r["k"]: (r["c"], r["n"]) for r in counts.where("c > 0").groupBy(size.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    total, distinct = sum(c for c, _ in tails.values()) + docs, sum(n for _, n in tails.values()) + (docs > 0)
    return Vocabulary([(bytes(r["word"]), r["c"]) for r in top], [tails.get(k, (0, 0)) for k in range(TAILS)], total, distinct, docs, classes, members)


def _train_round(rows: DataFrame, vocab, start: bytes, hidden: int, lanes: int, steps: int, rate: float, block: int, shards: int) -> bytes:
    """One pass over the encoded texts (shard, place, tokens), each shard from the same weights; their mean by tokens seen.

    A shard's texts come in the order of their places and are read as they come, in blocks, so a task holds one block.
    """

    def run(batches):
        v = vocab.value
        net, own, seen, docs, held = None, None, 0, [], 0
        for numbers, texts in blocks(batches, ["shard", "tokens"]):
            for k, tokens in zip(numbers, texts, strict=True):
                if k != own or held >= block:
                    if net:
                        read(net, docs, lanes, steps, rate)
                    seen, docs, held = seen + held, [], 0
                if k != own:
                    if net:
                        yield pa.record_batch([pa.array([float(seen)]), pa.array([net.pack()], pa.binary())], ["seen", "weights"])
                    net, own, seen = Network(v, hidden).unpack(start), k, 0
                docs.append(np.frombuffer(tokens, "<u2").astype(np.int64))
                held += len(docs[-1])
        if net:
            read(net, docs, lanes, steps, rate)
            yield pa.record_batch([pa.array([float(seen + held)]), pa.array([net.pack()], pa.binary())], ["seen", "weights"])

    def add(batches):
        total, seen = 0.0, 0.0
        for b in batches:
            for n, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total, seen = total + np.frombuffer(w, "<f4") * np.float64(n), seen + n
        if seen:
            yield pa.record_batch([pa.array([seen]), pa.array([(total / seen).astype("<f4").tobytes()], pa.binary())], ["seen", "weights"])

    parts = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.select("shard", "place", "id", "tokens").repartitionById(shards, "shard").sortWithinPartitions("shard", "place", "id", "tokens")
    trained = dealt.select("shard", "tokens").mapInArrow(run, "seen double, weights binary")
    found = trained.repartition(parts).mapInArrow(add, "seen double, weights binary").collect()  # bounded by the root of the shuffle partitions
    seen = sum(r["seen"] for r in found)
    return start if not seen else sum(np.frombuffer(r["weights"], "<f4") * (r["seen"] / seen) for r in found).astype("<f4").tobytes()


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", known: int = 200_000, classes: int = 32, members: int = 64, hidden: int = 16, rounds: int = 2, rate: float = 0.03, train_lanes: int = 256, train_steps: int = 32, lanes: int = 256, steps: int = 64, block: int = 1 << 22, shard: int = 1 << 22) -> DataFrame:
    """One row per row of ``docs``: (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score).

    ``held_out`` is a boolean column; all other rows are learned from, whole and each in one of ``rounds`` rounds.  Tokens
    are a text's words and one end; a null or empty text is an end alone.  n_known counts tokens seen in training, and
    base_score is the log10 probability by add-0.1 counts of all training tokens; score is the network's.  With nothing to
    learn from, all counts are 0.  Repeated rows and null ids each give a row; an empty table gives none.

    A round's texts are dealt by a hash of id and text into shards of about ``shard`` tokens, in which they have a fixed order.
    A shard is trained by one task from the round's weights, and the shards' weights are averaged, so the scores are the same,
    to rounding, whatever the input's partitions are; more input means more shards, not larger ones.

    The most frequent ``known`` words go to every task with their counts, a bound that does not depend on the input; the
    counts of all other words are looked up by a join.
    """
    if classes * members + TAILS >= 1 << 16:
        raise ValueError("tokens are kept in 16 bits: classes * members must be smaller")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = save(word_counts(rows), "words")
    ends = rows.where(~F.col("held_out")).count()
    vocab = spark.sparkContext.broadcast(vocabulary(counts, ends, known, classes, members))

    def encode(batches):
        """What the words at hand tell of each text, its tokens, and its other words."""
        from pyspark import TaskContext

        v, row = vocab.value, TaskContext.get().partitionId() << 33
        end_count = math.log10(v.docs + 0.1)
        for ids, outs, texts in blocks(batches, ["id", "held_out", "text"], 2 << 20):
            out = []
            for i, held, text in zip(ids, outs, texts, strict=True):
                at, said, away = v.encode(words(text))
                c = v.counts[at[at >= 0]]
                in_tail = said[:-1] >= v.size
                shares = np.log10(v.counts[at[in_tail & (at >= 0)]] + 0.1).sum() - v.tail_cost[said[:-1][in_tail] - v.size].sum()
                more = Counter(away)
                base = float(np.log10(c + 0.1).sum() + end_count - v.base_cost * len(said))
                out.append((row, i, held, len(said), int((c > 0).sum()) + (v.docs > 0), base, float(shares), said.astype("<u2").tobytes(), list(more.keys()), list(more.values())))
                row += 1
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["row", "id", "held_out", "n_tokens", "n_known", "base", "shares", "tokens", "words", "times"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
    schema = "row long, id long, held_out boolean, n_tokens long, n_known long, base double, shares double, tokens binary, words array<binary>, times array<int>"
    encoded = save(rows.mapInArrow(encode, schema), "encoded")
    weights = Network(vocab.value, hidden).pack()
    place, shards = F.xxhash64("id", "tokens"), max(1, round(vocab.value.total / rounds / shard))
    texts = encoded.where(~F.col("held_out")).select("id", "tokens", place.alias("place"), F.pmod(place, F.lit(rounds)).alias("turn"), F.pmod(F.shiftright(place, 16), F.lit(shards)).cast("int").alias("shard"))
    for k in range(rounds):
        weights = _train_round(texts.where(F.col("turn") == k), vocab, weights, hidden, train_lanes, train_steps, rate, block, shards)

    def score(batches):
        net = Network(vocab.value, hidden).unpack(weights)
        held: list[tuple] = []
        tokens, size = [], 0

        def scored():
            logs = read(net, tokens, lanes, steps) / math.log(10) + [x for _, x in held]
            return pa.record_batch([pa.array([r for r, _ in held], pa.int64()), pa.array(logs)], ["row", "score"])

        for found, shares, texts in blocks(batches, ["row", "shares", "tokens"]):
            held += zip(found, shares, strict=True)
            tokens += [np.frombuffer(t, "<u2").astype(np.int64) for t in texts]
            size += sum(len(t) // 2 for t in texts)
            if size >= block:
                yield scored()
                held, tokens, size = [], [], 0
        if held:
            yield scored()

    scored = encoded.select("row", "shares", "tokens").mapInArrow(score, "row long, score double")
    tail = encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    found = tail.join(counts.where("c > 0").select("word", "c"), "word", "left")
    extra = found.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("logs"))
    out = encoded.drop("tokens", "words", "times").join(scored, "row").join(extra, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.value.total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def held_out_part(id_col: str = "doc_id", part: int = 10, rest: int = 0):
    """Whether crc32 of the id as text leaves ``rest`` when divided by ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % part == rest, F.lit(False))


