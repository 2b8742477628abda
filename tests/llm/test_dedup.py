import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import DATA, same_rows

from pairfold.llm import queries
from pairfold.llm.components import components
from pairfold.llm.exact_dedup import drop_copies, exact_dedup
from pairfold.llm.near_dedup import Sketcher, fewest_matches, keep_one_each, near_dedup, parity, set_sizes, shingle_hashes, shingle_set, words

SF = f"{DATA}/sf0.001"
ROWS = [(1, "a b c d"), (2, None), (3, ""), (4, "a b c d"), (5, "A b c d"), (6, " \t"), (7, "x" * 300_000), (8, "x" * 300_000), (None, "a b c d"), (9, "hot")] + [(100 + k, "hot") for k in range(50)]


def _exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [48 << 20, 1])
def test_exact_against_brute_force(spark, documents, budget):
    """A budget of one byte lets one content into each table, so buckets overflow again and again."""
    assert sorted(map(tuple, exact_dedup(documents(ROWS), budget=budget).collect()), key=str) == _exact(ROWS)


def test_exact_edges(spark, documents):
    assert exact_dedup(documents([]).where("false")).count() == 0
    twice = documents([(1, "a"), (1, "a"), (2, "b"), (1, "c")])
    assert [r["kept"] for r in exact_dedup(twice).collect()] == [True] * 4
    assert sorted((r["doc_id"], r["text"]) for r in drop_copies(twice).collect()) == [(1, "a"), (1, "c"), (2, "b")]
    kept = drop_copies(documents(ROWS))
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 8, 149}
    assert kept.columns == documents(ROWS).columns


def test_drop_copies_judges_each_text(spark, documents):
    """A row goes for its own text: another text of its id stays."""
    kept = drop_copies(documents([(5, "A"), (5, "B"), (9, "B"), (None, "B"), (None, "C")]))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == [(5, "A"), (9, "B"), (None, "C")]


def test_drop_copies_with_null_ids(spark, documents):
    got = drop_copies(documents([(5, "a"), (9, "a"), (5, "b"), (None, "a"), (None, "z"), (None, "z"), (None, None), (3, "")])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == [(3, ""), (5, "b"), (9, "a"), (None, "z")]


def test_exact_equals_sql(spark):
    same_rows(queries.QUERIES["op9_exact_dedup"](spark, SF), queries.SQL["op9_exact_dedup"], SF)


def _near(rows, k, percent):
    """Components by comparing all pairs."""
    sets = [(i, tuple(words(t or "")), shingle_set(words(t or ""), k)) for i, t in rows]
    root = {i: i for i, *_ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _, x) in enumerate(sets):
        for j, _, y in sets[:a]:
            if i is not None and j is not None and x and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted([(i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, _, s in sets], key=str)


def _family(rng, base, n, changes, start):
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        out.append((start + k, " ".join(w)))
    return out


def test_near_against_brute_force(spark, documents):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = [(k, " ".join(text(rng.choice([3, 8, 40, 120])))) for k in range(60)]
    rows += _family(rng, text(150), 80, 9, 1000) + _family(rng, text(60), 20, 2, 2000) + _family(rng, text(300), 25, 30, 3000)
    chain = text(200)
    for k in range(12):  # each links with the next alone
        chain = chain[: 12 * k] + text(12) + chain[12 * k + 12 :]
        rows.append((4000 + k, " ".join(chain)))
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, " One  TWO "), (5004, "one"), (5005, " \n"), (None, "one two"), (5006, "a b c"), (5007, "a b c")]
    rows += [(5100 + k, rows[70][1].upper()) for k in range(30)]
    for k, percent in ((3, 85), (5, 80)):
        got = near_dedup(documents(rows), shingle=k, percent=percent)
        assert sorted(map(tuple, got.collect()), key=str) == _near(rows, k, percent)


def test_near_copies_of_one_text_meet_few(spark, monkeypatch):
    """Near copies about the threshold from each other, half of them not linked with the first: further centres take in most of
    them before pairs are made from common shingles, which would be nearly all pairs of the group."""
    from pairfold.llm import near_dedup as near

    rng = np.random.default_rng(11)
    base, texts = [f"w{i}" for i in range(320)], []
    for m in range(240):
        own = list(base)
        for at in rng.choice(320, 5 if m < 120 else 1, replace=False):
            own[at] = f"x{m}y{at}"
        texts.append(" ".join(own))
    sets = [near.shingle_set(near.words(t), 5) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    met, save = [], near.save

    def counted(df, name):
        out = save(df, name)
        if name == "rest":
            met.append(out.count())
        return out

    monkeypatch.setattr(near, "save", counted)
    rows = near.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["component_id"] for r in sorted(rows, key=lambda r: r["doc_id"])] == root
    assert sum(met) < 2 * len(texts), met


def test_near_links_repeated_words(spark, documents):
    """Texts of several lengths whose only shingle is one word over and over are the same set; shorter ones are not."""
    rows = [(10 * n + k, " ".join([w] * n)) for n in (1, 2, 3, 4, 5, 6, 9, 40, 5000) for k, w in enumerate(("ha", "HO"))]
    rows += [(7, "ha ha ha ho"), (8, "ha ho ha ho ha ho"), (9, "ho ha ho ha"), (3, "ha ha"), (None, "ha ha ha ha"), (2, "ho " * 4)]
    for k, percent in ((3, 85), (5, 80)):
        got = near_dedup(documents(rows), shingle=k, percent=percent)
        assert sorted(map(tuple, got.collect()), key=str) == _near(rows, k, percent)
    assert {r["doc_id"] for r in keep_one_each(documents([(1, "ha ha ha ha ha"), (2, "ha " * 7), (3, "ha ha")])).collect()} == {1, 3}


def test_near_edges(spark, documents):
    assert near_dedup(documents([]).where("false")).count() == 0
    blank = near_dedup(documents([(1, None), (2, " "), (None, None)]))
    assert sorted(map(tuple, blank.collect()), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = documents([(1, long), (2, long + " more"), (3, "other words that stand alone here")])
    assert {r["doc_id"] for r in keep_one_each(rows).collect()} == {1, 3}


def test_near_equals_sql(spark):
    same_rows(queries.QUERIES["op3_near_dedup"](spark, SF), queries.SQL["op3_near_dedup"], SF)


@pytest.mark.parametrize("k", [3, 5])
def test_set_sizes_by_numbers(k):
    """Long texts are compared by numbered shingles, short ones by sets; both are exact."""
    rng = random.Random(k)
    for n in (2, k, 50, 6000):
        a = [f"w{rng.randrange(40)}".encode() for _ in range(n)]
        b = a[: n // 2] + [f"w{rng.randrange(60)}".encode() for _ in range(n // 2)]
        x, y = shingle_set(a, k), shingle_set(b, k)
        assert set_sizes(a, b, k) == (len(x), len(y), len(x & y))


def test_parity_bounds_the_difference():
    rng = random.Random(3)
    for n in (1, 30, 300, 3000):
        x = {rng.getrandbits(64) for _ in range(n)}
        y = set(list(x)[: n - n // 5]) | {rng.getrandbits(64) for _ in range(n // 3)}
        a, b = (parity(np.array(sorted(s), np.uint64)) for s in (x, y))
        assert sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) <= len(x ^ y)


def test_hashes_count_shingles():
    for text in ("a b c a b c a", "one", "one two", "ä ö ü ä", "x " * 500 + "y"):
        assert len(shingle_hashes(words(text), 3)) == len(shingle_set(words(text), 3))


def test_posterior_limits():
    limits = dict(fewest_matches(0.85, 1e-9, 20, 120))
    assert all(0 < limits[n] < 0.85 * n for n in (60, 120))
    assert limits[120] / 120 > limits[40] / 40  # more hashes, sharper bounds


def test_signatures_estimate_similarity():
    s = Sketcher(3, 24, 5)
    base = [f"w{k}" for k in range(400)]
    other = base[:300] + [f"v{k}" for k in range(100)]
    a, b = (shingle_set([x.encode() for x in t], 3) for t in (base, other))
    x, y = (s.signature(shingle_hashes([w.encode() for w in t], 3)) for t in (base, other))
    assert abs((x == y).mean() - len(a & b) / len(a | b)) < 0.15


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 12), (20, 20), (12, 10), (7, 30), (30, 8)] + [(50, k) for k in range(51, 90)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10, 7: 7, 8: 7, 30: 7} | {k: 50 for k in range(50, 90)}
