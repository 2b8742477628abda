import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, same_rows
from pyspark.sql import functions as F

from pairfold.llm import langid, lm, queries, topk

SF = f"{DATA}/sf0.001"


# --- language identification --------------------------------------------------------------------------------------------


def _sets(text):
    return [set(g.tolist()) for g in langid.grams(text)]


def test_kernel_is_the_mean_cosine_of_presence_sets():
    texts = ["The cat and the dog", "Der Hund und die Katze", "the the the", "ß"]
    rows, some = langid.presence(texts)
    k = langid.scaled(rows)
    k = k @ k.T
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            want = np.mean([len(x & y) / math.sqrt(len(x) * len(y)) for x, y in zip(_sets(a), _sets(b), strict=True)])
            assert abs(k[i, j] - want) < 1e-5
    assert some.all() and langid.grams("12 !?") is None


def test_ridge_regression_is_exact_with_all_texts_as_landmarks():
    """With every text a landmark, Nystroem features span the kernel, and centred ridge regression has a closed form."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "and", "house"] if k % 2 else ["der", "und", "haus"]) for _ in range(6)) + f" {rng.choice('abcdefgh')}x" for k in range(12)]
    labels = ["en" if k % 2 else "de" for k in range(12)]
    rows = langid.scaled(langid.presence(texts)[0])
    m = langid.Model(rows, labels, 12, 0.01)
    k = (rows @ rows.T).astype(float)
    share = np.full(12, 1 / 6)
    y = np.where(np.array(labels)[:, None] == np.array(m.languages), 1.0, -1.0)
    centre = np.eye(12) - np.full((12, 12), 1 / 12)
    alpha = np.linalg.solve(centre @ k @ centre * share[0] + 0.01 * np.eye(12), y - y.mean(0)) * share[0]
    want = centre @ k @ centre @ alpha + y.mean(0)
    assert np.abs(m.scores(rows) - want).max() < 0.02
    assert m.predict(texts)[0] == labels


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    out = queries.QUERIES["op6_language_id"](spark, f"{DATA}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r["lang_pred"] == r["lang"] for r in out if r["held_out"]]
    assert sum(held) / len(held) > 0.99


def test_query_rows_by_brute_force(spark):
    """Every prediction of the query from sets of n-grams, with the examples drawn by hand."""
    import xxhash

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    place = lambda i: signed(xxhash.xxh64(b"langid", seed=xxhash.xxh64(str(i).encode(), seed=42).intdigest()).intdigest()) % (1 << 40)
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in docs}
    examples = sorted((r for r in docs if r["lang"] is not None and not held[r["doc_id"]] and r["text"] and langid.grams(r["text"])), key=lambda r: (r["lang"], place(r["doc_id"])))
    assert max(Counter(r["lang"] for r in examples).values()) <= 400  # so all of them are
    model = langid.Model(langid.scaled(langid.presence([r["text"] for r in examples])[0]), [r["lang"] for r in examples], 64, 1e-3)
    turns, order = Counter(), []
    for i, r in enumerate(examples):
        order.append((turns[r["lang"]], r["lang"], i))
        turns[r["lang"]] += 1
    landmarks = [_sets(examples[i]["text"]) for *_, i in sorted(order)[:64]]
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_language_id"](spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        row = got[r["doc_id"]]
        assert row["held_out"] == held[r["doc_id"]]
        if not r["text"] or langid.grams(r["text"]) is None:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        own = _sets(r["text"])
        kernel = np.array([np.mean([len(x & y) / math.sqrt(len(x) * len(y)) for x, y in zip(own, other, strict=True)]) for other in landmarks])
        scores = kernel @ model.weights + model.bias
        assert row["lang_pred"] == model.languages[int(scores.argmax())]
        assert abs(row["score"] - min(1, max(0, (scores.max() + 1) / 2))) < 1e-3


def test_language_edges(spark, documents):
    docs = documents([(1, "the cat and the dog of the house", "en"), (2, "der hund und die katze und das haus", "de"), (3, None, "en"), (4, "12 !", "de"), (5, "the house", None), (None, "und der", None), (1, "the cat and the dog of the house", "en")])
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == 7 and {(r["doc_id"], r["lang_pred"]) for r in got} == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "en"), (None, "de")}
    kept = langid.keep_known(docs, model)
    assert kept.count() == 5 and kept.columns == docs.columns
    nothing = langid.train(docs.where("false"))
    assert sorted(r["text"] for r in langid.keep_known(docs, nothing).collect()) == sorted(r["text"] for r in kept.collect())
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).count() == 0
    assert langid.identify(documents([(1, "the house " * 50_000)]), model).first()["lang_pred"] == "en"


def test_unlearned_languages_are_rejected(spark):
    """Labelled documents stay; scripts that no example has go."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    other = [(-1, "这是一个中文文本，用来测试语言识别。"), (-2, "Это русский текст для проверки определения языка."), (-3, "αυτό είναι ένα ελληνικό κείμενο"), (-4, "12 ?")]
    both = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(*r, None) for r in other], "doc_id long, text string, lang string"))
    kept = langid.keep_known(both, langid.train(both))
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.where("lang is not null").select("doc_id").collect()}


# --- language model -----------------------------------------------------------------------------------------------------


def _vocabulary(texts, known=10**6, classes=4, members=3):
    seen = Counter(w for t in texts for w in lm.words(t))
    tails = [(sum(c for w, c in seen.items() if lm.tail_class(w) == k), sum(lm.tail_class(w) == k for w in seen)) for k in range(lm.TAILS)]
    return seen, lm.Vocabulary(list(seen.items())[:known], tails, sum(seen.values()) + len(texts), len(seen) + 1, len(texts), classes, members)


TEXTS = ["the cat sat on the mat", "the dog ate the cat", "a cat a dog a mat", "remarkable extraordinarily long words appear once"]


def test_probabilities_sum_to_one():
    """Over all words, a new word of each length and the end, after the same history."""
    seen, v = _vocabulary(TEXTS)
    net = lm.Network(v, hidden=4)
    history = v.encode([b"the", b"cat"])[1][:-1]
    new = [b"q" * n for n in (1, 3, 5, 7, 9, 11, 13, 40)]
    total = 0.0
    for w in [*seen, *new, None]:
        at, said, _ = v.encode([w] if w else [])
        token = said[:1]
        one = lm.read(net, [np.concatenate([history, token])], 4, 3)[0] - lm.read(net, [history], 4, 3)[0]
        if w and token[0] >= v.size:
            one += math.log(seen.get(w, 0) + 0.1) - v.tail_cost[token[0] - v.size] * math.log(10)
        total += math.exp(one)
    assert abs(total - 1) < 1e-4


def test_gradients():
    _, v = _vocabulary(TEXTS)
    docs = [v.encode(lm.words(t))[1] for t in TEXTS]
    steps, lanes = 7, 4
    tokens, valid = np.zeros((steps, lanes), np.int64), np.zeros((steps, lanes), bool)
    for j, d in enumerate(docs):
        n = min(len(d), steps)
        tokens[:n, j], valid[:n, j] = d[:n], True
    keep = np.ones((steps, lanes), np.float32)
    keep[0] = 0
    net = lm.Network(v, hidden=3)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    loss = lambda: -net.window(tokens, keep, valid, np.zeros((lanes, 3)))[0][valid].mean()
    caught = {}
    net._adam = lambda grads, rate: caught.update(grads)
    net.window(tokens, keep, valid, np.zeros((lanes, 3)), rate=1.0)
    rng = np.random.default_rng(0)
    for k, x in net.p.items():
        flat = x.reshape(-1)
        for i in rng.choice(flat.size, min(6, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-4 - caught[k].reshape(-1)[i]) < 2e-4, k


def test_windows_and_lanes_do_not_change_scores():
    _, v = _vocabulary(TEXTS)
    net = lm.Network(v, hidden=5)
    docs = [v.encode(lm.words(t * 5))[1] for t in TEXTS] + [v.encode([])[1]]
    want = [lm.read(net, [d], 1, 1000)[0] for d in docs]
    for lanes, steps in ((1, 2), (2, 3), (8, 64)):
        assert np.abs(lm.read(net, docs, lanes, steps) - want).max() < 1e-3


def _base(rows):
    seen, docs = Counter(), 0
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            seen.update(lm.words(t or ""))
            docs += 1
    if docs:
        seen["end"] = docs
    total, distinct = sum(seen.values()), len(seen)
    out = {}
    for i, t in rows:
        w = [*lm.words(t or ""), "end"]
        out[i] = (len(w), sum(seen[x] > 0 for x in w), total, sum(math.log10((seen[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w))
    return out


@pytest.mark.parametrize("known", [200_000, 2000])
def test_base_scores_by_brute_force(spark, known):
    """With few words at hand, most counts come through the join."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = _base([(r["doc_id"], r["text"]) for r in docs.collect()])
    rows = lm.score_documents(docs, lm.held_out_part(), known=known, rounds=1).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, some, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, some, total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["score"] < 0 and math.isfinite(r["score"])


def _slow_score(net, v, seen, text):
    """log10 probability of a text, word by word, by the formulas of a gated recurrent unit and a class-factored softmax."""
    p, h = {k: x.astype(float) for k, x in net.p.items()}, net.hidden
    sigmoid, softmax = lambda x: 1 / (1 + np.exp(-x)), lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    heads = {w: i for i, (w, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: v.heads])}
    state, total = np.zeros(h), 0.0
    for w in [*lm.words(text), None]:
        groups = softmax(state @ p["wc"] + p["bc"])
        if w is None:
            token, chance = v.size + lm.TAILS, groups[-1]
        elif w in heads:
            token = heads[w]
            c, m = divmod(token, v.members)
            chance = groups[c] * softmax(state @ p["wo"][c] + p["bo"][c])[m]
        else:
            k = lm.tail_class(w)
            token = v.size + k
            rest = [x for x in seen if lm.tail_class(x) == k and x not in heads]
            chance = groups[v.classes + k] * (seen.get(w, 0) + 0.1) / (sum(seen[x] for x in rest) + 0.1 * (len(rest) + 1))
        total += math.log10(chance)
        gates, inner = p["wx"][token] + p["b"], state @ p["u"]
        z, r = sigmoid(gates[:h] + inner[:h]), sigmoid(gates[h : 2 * h] + inner[h : 2 * h])
        new = np.tanh(gates[2 * h :] + r * inner[2 * h :])
        state = z * state + (1 - z) * new
    return total


@pytest.mark.parametrize("known", [200_000, 100])
def test_scores_by_brute_force(spark, documents, monkeypatch, known):
    """The score column of a network whose weights are known: those of a short training on the same texts."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 900").orderBy("doc_id").limit(25).collect()]
    rows = list(enumerate([*texts, "", None, "neverseen andneitherthis", texts[0]]))
    seen, docs = Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            seen.update(lm.words(t or ""))
            docs += 1
    at_hand = sorted(seen.items(), key=lambda x: (-x[1], x[0]))
    tails = [(sum(c for w, c in seen.items() if lm.tail_class(w) == k), sum(lm.tail_class(w) == k for w in seen)) for k in range(lm.TAILS)]
    v = lm.Vocabulary(at_hand, tails, sum(seen.values()) + docs, len(seen) + 1, docs, 4, 5)
    net = lm.Network(v, 6)
    lm.read(net, [v.encode(lm.words(t or ""))[1] for _, t in rows], 4, 8, 0.05)
    monkeypatch.setattr(lm, "_train_round", lambda *a, raw=net.pack(): raw)
    got = lm.score_documents(documents(rows), lm.held_out_part(), known=known, classes=4, members=5, hidden=6, rounds=1).collect()
    assert len(got) == len(rows)
    for r in got:
        want = _slow_score(net, v, seen, rows[r["doc_id"]][1] or "")
        assert abs(r["score"] - want) < 1e-3 * max(1, abs(want))


def test_softmax_of_distant_rows():
    raw = np.array([[0, 1, 2], [-300, -301, -299], [200, 0, 0]], np.float32)
    offset = np.array([0.5, 0, -1], np.float32)
    moved, exp, norm = lm._softmax(raw.T - offset[:, None], offset)  # a column for each row
    want = np.exp(raw - raw.max(1, keepdims=True))
    assert np.allclose((exp / norm).T, want / want.sum(1, keepdims=True), atol=1e-6) and np.isfinite(moved - np.log(norm)).all()


def test_repeated_and_null_ids_are_scored_each(spark, documents):
    got = lm.score_documents(documents([(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (None, None)]), lm.held_out_part(), rounds=1).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 2), ("1", 3), ("1", 3), ("None", 1), ("None", 3)]
    assert len({round(r["score"], 4) for r in got if r["n_tokens"] == 3}) == 1


def test_training_beats_counts_on_held_out_texts(spark):
    rows = queries.QUERIES["op7_lm_score"](spark, f"{DATA}/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


@pytest.mark.parametrize("shard", [1 << 22, 3000])
def test_scores_do_not_depend_on_partitions(spark, shard):
    """One shard a round or several, texts in other partitions and another order, with repeated rows and null ids among them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id < 9").selectExpr("CAST(NULL AS LONG) AS doc_id", "text"))
    found = [sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.score_documents(docs.repartition(n), lm.held_out_part(), shard=shard).collect()) for n in (1, 6, 64)]
    for other in found[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in found[0]]
        assert max(abs(x[2] - y[2]) / abs(y[2]) for x, y in zip(other, found[0], strict=True)) < 1e-4


def test_model_edges(spark, documents):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "A b"), (4, "a b"), (5, "word " * 30_000)]
    got = {r["doc_id"]: r for r in lm.score_documents(documents(rows), lm.held_out_part(), rounds=1).collect()}
    want = _base(rows)
    assert {i: (r["n_tokens"], r["n_known"], r["train_tokens"]) for i, r in got.items()} == {i: w[:3] for i, w in want.items()}
    assert all(abs(r["base_score"] - want[i][3]) < 1e-6 * abs(want[i][3]) + 1e-9 for i, r in got.items())
    nobody = lm.score_documents(documents([(1, "a b")]), F.lit(True), rounds=1).first()
    assert (nobody["train_tokens"], nobody["n_known"], abs(nobody["base_score"]) < 1e-9, math.isfinite(nobody["score"])) == (0, 0, True, True)
    assert lm.score_documents(documents([]).where("false"), lm.held_out_part(), rounds=1).count() == 0


# --- top-k --------------------------------------------------------------------------------------------------------------


def _search(rows, queries_, k):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for q, v in [(i, [math.floor(1024 * x) for x in v]) for i, v in queries_ if i is not None and ok(v)]:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(6).round(2).tolist()) for k in range(300)]
    rows += [(400 + k, rows[k][1]) for k in range(40)] + [(500, [0.0] * 6), (501, [0.0] * 6)]  # ties
    rows += [(600, None), (601, []), (602, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (603, [math.nan] * 6), (604, [math.inf] * 6), (None, [1.0] * 6), (605, [1.0, 2.0]), (606, [3.0, 1.0]), (607, [9.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    asked = [r for r in rows if r[0] is not None and (r[0] % 7 == 0 or r[0] >= 500)]
    for least, size in ((1 << 14, 64 << 20), (1, 37 * 48)):
        got = topk.top_k(df, df.where("vec_id % 7 = 0 or vec_id >= 500"), k=5, least_rows=least, chunk_bytes=size)
        assert sorted(map(tuple, got.collect())) == _search(rows, asked, 5)
    assert topk.top_k(df, df.where("false")).count() == 0
    assert topk.top_k(df.where("false"), df.where("vec_id = 7")).count() == 0


def test_huge_components(spark):
    rows = [(0, [1e15, -2e14]), (1, [3e12, 1.5]), (2, [-1e15, 1e15]), (3, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, df).collect())) == _search(rows, rows, 10)


def test_elimination_saves_work():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16)) * 3000
    vectors = np.floor(np.concatenate([c + 60 * rng.standard_normal((400, 16)) for c in centres]))
    s = topk.Search(np.arange(len(vectors)), vectors, 10)
    list(s.best(np.arange(20) * 400, vectors[::400]))
    assert s.evaluated < 0.1 * s.asked


def test_elimination_on_the_test_vectors(spark):
    """These are spread evenly over a sphere, the hardest case: bounds by single pivots leave nine of ten candidates there."""
    rows = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), topk._floored(np.array([r["embedding"] for r in rows], float))
    s = topk.Search(ids, vectors, 10)
    asked = np.flatnonzero(ids % 100 == 0)
    list(s.best(ids[asked], vectors[asked]))
    assert s.evaluated < 0.35 * s.asked


def test_bounds_hold():
    """Bounds are no lower than the scores and no higher than what single pivots and norms allow."""
    rng = np.random.default_rng(8)
    for d in (1, 2, 16, 64):
        vectors = np.floor(rng.standard_normal((300, d)) * 1000 * rng.random((300, 1)))
        t = topk.PivotTable(np.arange(300), vectors, 48, 128)
        upper, scores = t.bounds(vectors), vectors @ vectors.T
        assert (upper >= scores).all()
        lower = np.abs(t.distances[:, None] - t.distances[None]).max(2)
        single = (t.norms[:, None] + t.norms - lower**2) / 2
        assert (upper <= single + 1e-6 * np.abs(single).max() + 1).all()


def test_plan_does_not_grow_with_queries(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(300)], "vec_id long, embedding array<double>")
    plans = [topk.top_k(df, df.where(w))._jdf.queryExecution().executedPlan().toString().count("\n") for w in ("vec_id = 0", "true")]
    assert abs(plans[0] - plans[1]) <= 2


def test_top_k_numbers_rows_once(spark):
    """Of an input in no fixed order, tasks that run again must deal rows as before, so the plan itself numbers nothing."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 200")
    shuffled = df.repartition(7)
    found = topk.top_k(shuffled, shuffled.where("vec_id % 20 = 0"), k=3, least_rows=16)
    assert "monotonically" not in found._jdf.queryExecution().executedPlan().toString()
    key = lambda r: tuple(r)
    assert sorted(found.collect(), key=key) == sorted(topk.top_k(df, df.where("vec_id % 20 = 0"), k=3).collect(), key=key)


def test_top_k_equals_sql(spark):
    same_rows(queries.QUERIES["op8_top_k"](spark, SF), queries.SQL["op8_top_k"], SF)
