"""Conversation repair, best-fit packing and importance resampling against brute force."""

import bisect
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import DATA, same_rows

from pairfold.llm import best_fit as bf
from pairfold.llm import importance, queries, repair

SF = f"{DATA}/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, copy int, kind string"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_importance"])
def test_equals_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


# --- conversations ----------------------------------------------------------------------------------------------------

GRAMMAR = re.compile("(s?(ua)+)?")


def brute_edits(letters):
    """Least (cost, edits) over all sequences of edits with up to two insertions at each place."""
    best = None

    def go(i, out, cost, done):
        nonlocal best
        for n in range(3):
            for extra in map("".join, itertools.product("ua", repeat=n)):
                o, c, d = out + extra, cost + 5 * n, done + "I" * n
                if best is not None and c > best[0]:
                    continue
                if i == len(letters):
                    if GRAMMAR.fullmatch(o) and (best is None or (c, d) < best):
                        best = c, d
                    continue
                go(i + 1, o, c + 2, d + "D")
                if letters[i] != "x":
                    more = 5 * letters[i].isupper()
                    go(i + 1, o + letters[i].lower(), c + more, d + "K")
                    for r in "ua":
                        go(i + 1, o + r, c + more + 1, d + "R")

    go(0, "", 0, "")
    return best


def test_edits_are_the_cheapest():
    rng = random.Random(5)
    some = ["", "x", "s", "S", "u", "A", "o"] + ["".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    assert repair.cheapest(some) == [brute_edits(s) for s in some]


def test_chunks_give_what_one_walk_gives(monkeypatch):
    rng = random.Random(6)
    some = ["".join(rng.choice("suaoSUAOx") for _ in range(n)) for n in (*range(30), 255, 256, 257, 700)]
    found = []
    for chunk in (5, 64, 10_000):
        monkeypatch.setattr(repair, "CHUNK", chunk)
        found.append(repair.cheapest(some))
    assert found[0] == found[1] == found[2]


def brute_repair(rows):
    """What the contract says of one conversation's rows (turn, role, text), in Python."""
    space = " \t\n\v\f\r"
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults, letters = set(), Counter(), ""
    for _, role, text in rows:
        end = text.rstrip(space)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        own = role[:1] if role[:1] in tuple("sua") else "o"
        letters += "x" if fault in ("blank", "duplicate") else own.upper() if fault else own
    cost, audit = brute_edits(letters)
    kept, left = [], iter(rows)
    for e in audit:
        row = next(left) if e != "I" else (None, None, "")
        if e != "D":
            kept.append((e, row[1], row[2]))
    odd = len(kept) % 2
    said = [f"{role if e == 'K' else ('user', 'assistant')[(i - odd) % 2]}:{text}" for i, (e, role, text) in enumerate(kept)]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def test_repair_by_brute_force(spark):
    rng = random.Random(7)
    said = ["Yes.", "No!", "cut of", "", " \n", None, "é?", "ok.\t", "Yes.", "…", "x" * 5000 + "."]
    rows = []
    for conv in [*range(40), None]:
        for _ in range(rng.randint(1, 5)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), rng.choice(said)))
    rows += rows[:3]
    given = spark.createDataFrame([(*r, 1, "k") for r in rows], TURNS)
    ids = spark.createDataFrame([(c,) for c in [*range(41), None]], "conv_id long")
    got = {r["conv_id"]: tuple(r[1:]) for r in repair.repair(given, ids).collect()}
    assert len(got) == 42 and got[40] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv in [*range(40), None]:
        assert got[conv] == brute_repair([r[1:] for r in rows if r[0] == conv])


def test_repaired_turns_fit_the_grammar(spark):
    """Real turns come out, numbered, and repairing them again changes nothing."""
    rows = repair.damage(spark.read.parquet(f"{SF}/conversations.parquet"))
    plans = repair.plan_repairs(rows).cache()
    fixed = repair.repaired_turns(rows, plans).cache()
    turns = {}
    for r in fixed.collect():
        turns.setdefault(r["conv_id"], []).append((r["place"], r["role"]))
    for found in turns.values():
        assert sorted(p for p, _ in found) == list(range(len(found)))
        assert GRAMMAR.fullmatch("".join(role[0] for _, role in sorted(found)))
    assert fixed.where("edit = 'I'").where("text != ''").count() == 0
    again = repair.plan_repairs(fixed.where("edit != 'I'").selectExpr("conv_id", "place turn", "role", "text")).agg({"blank": "sum", "duplicate": "sum"}).first()
    assert tuple(again) == (0, 0)


def test_long_conversation_is_merged_from_chunks(spark):
    """One conversation with most rows of the table, longer than a walk."""
    rows = [(1, i, ["user", "assistant"][i % 2], f"Turn {i}.", 0, "") for i in range(1501)] + [(2, 0, "user", "Hi.", 0, ""), (2, 1, "assistant", "Hi.", 0, "")]
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in repair.repair(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {1: (2, "K" * 1500 + "D"), 2: (0, "KK")}


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.repair(none).count() == 0 and repair.damage(none).count() == 0


# --- best fit ---------------------------------------------------------------------------------------------------------


def brute_bins(sizes, full):
    room, n = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(room, s)
        left = full if at == len(room) else room.pop(at)
        n += left == full and at == len(room)
        bisect.insort(room, left - s)
    return len(room)


def test_rules_pack_as_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(200):
        full = rng.choice([1, 7, 16, 33, 100])
        counts = Counter(rng.randint(1, full) for _ in range(rng.randint(0, 300)))
        rules, bins = sorted(bf.plan_bins(counts, full)), {}
        for (size, first, sequence, each, offset), after in itertools.zip_longest(rules, rules[1:]):
            stop = after[1] if after and after[0] == size else counts[size]
            for number in range(first, stop):
                bins.setdefault(sequence + (number - first) // each, []).append((offset + (number - first) % each * size, size))
        assert sum(map(len, bins.values())) == sum(counts.values()) and len(bins) == brute_bins(counts.elements(), full)
        for held in bins.values():
            ends = [0, *itertools.accumulate(s for _, s in sorted(held))]
            assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= full


def test_tree_finds_the_tightest():
    tree, rng = bf.RoomTree(1024), random.Random(9)
    held = Counter()
    for _ in range(500):
        room = rng.choice([0, 1, 511, 512, 1023, 1024, rng.randint(0, 1024)])
        step = -1 if held[room] and rng.random() < 0.5 else 1
        tree.add(room, step)
        held[room] += step
        size = rng.randint(0, 1024)
        assert tree.tightest(size) == min((r for r, n in held.items() if n and r >= size), default=None)


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library, rng = bf.ByteTokenizer(path, budget=1 << 14), Tokenizer.from_file(path), random.Random(10)
    signs = "ab'sre llvdmt \n\t\r\v\f\x1c\x85  éßĀſµªº²½Ⅷ0١日本語😀́‍.,!?-<|>_\x00\x7f"
    for n in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) + ("<|endoftext|> a" if n % 50 == 0 else "")
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_best_fit_of_documents(spark, documents):
    from tokenizers import Tokenizer

    rng = random.Random(11)
    texts = ["", None, "word " * 3000, "x" * 20_000, "same", "same"] + ["token " * rng.randint(0, 200) for _ in range(150)]
    docs = documents([(None if i == 3 else i // 2 * 2 if i < 20 else i, t) for i, t in enumerate(texts)])
    library = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    ids_of = {}
    for d, t in zip([r["doc_id"] for r in docs.collect()], texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        cut = [0, *range((len(ids) - 1) % 128 + 1, len(ids) + 1, 128)]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        ids_of[d] = ids
    found = set()
    for parts in (1, 7):
        rows = bf.best_fit(docs.repartition(parts), path, full=128).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for held in bins.values():
            ends = [0, *itertools.accumulate(n for _, n in sorted(held))]
            assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 128
        assert len(bins) == brute_bins([r["length"] for r in rows], 128)
        found.add(len(bins))
    assert len(found) == 1
    assert bf.best_fit(documents([]), path).count() == 0


# --- importance -------------------------------------------------------------------------------------------------------


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


def brute_resample(docs, target, percent, least):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in brute_features(t)[1])
    s, t = count([x for _, x in docs]), count(target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    rows, able = [], []
    for i, text in docs:
        words, feats = brute_features(text)
        weight = sum(gain(zlib.crc32(f.encode()) % 10_000) for f in feats) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = [i, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None]
        rows.append(row)
        able += [row] if len(words) >= least else []
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = k + 1
    return rows


def test_resampling_by_brute_force(spark, documents):
    rng = random.Random(12)
    words = ["Éa", "b2", "c", "日本", "w" * 63, "w" * 64, "w" * 65, "z" * 300, "a-b", "A", "É"]
    docs = [(rng.choice([i, i // 3, None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, "--- \x00"), (7, docs[0][1]), (7, docs[0][1])]
    target = ["a b2 c b2", None, "w" * 65 + " c", ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for percent, least in ((25, 20), (100, 1), (0, 1)):
        got = importance.resample(documents(docs).repartition(5), bench, percent, least).collect()
        key = repr
        assert sorted(map(list, got), key=key) == sorted(brute_resample(docs, target, percent, least), key=key)


def test_resampling_without_rows(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(documents([]), bench).count() == 0
    assert importance.resample(documents([(1, "a b " * 20)]), bench, percent=100).first()["rank"] == 1


def test_hashes_of_joined_words():
    rng = random.Random(13)
    texts = ["".join(rng.choice("aB9é -\x00日") for _ in range(rng.randint(0, 300))) for _ in range(50)]
    hashes, of, n = importance.features(texts)
    want = Counter((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in brute_features(t)[1])
    assert Counter(zip(of.tolist(), hashes.tolist())) == want and n.tolist() == [len(brute_features(t)[0]) for t in texts]
