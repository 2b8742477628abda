import zlib
from collections import Counter

import numpy as np
from helpers import DATA
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from pairfold.llm import packing


def _stages(spark, docs):
    out = []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        out.append(docs)
    return out


def test_stages_one_by_one(spark, documents):
    text = [f"word{k} of the long text" for k in range(60)]
    near = [*text[:50], "changed words here", *text[51:]]
    rows = [(1, " ".join(text), "en"), (2, " ".join(near), "en"), (3, "the house and the cat", "en"), (4, "the house and the cat", "en"), (5, None, "en"), (6, "12 ?", "en"), (7, "das haus und die katze", "de"), (8, "", "de"), (9, "apart and alone it stands", None)]
    docs = documents(rows)
    stages = _stages(spark, docs)
    for df, ids in zip(stages[:-1], ({1, 2, 3, 4, 7, 9}, {1, 2, 4, 7, 9}, {1, 4, 7, 9}), strict=True):
        assert df.columns == docs.columns and {r["doc_id"] for r in df.collect()} == ids
    assert {r["doc_id"] for r in stages[-1].collect()} == {1, 4, 7, 9}
    assert _stages(spark, docs.where("false"))[-1].count() == 0


def test_run_by_brute_force(spark):
    """What stays is found by comparing all texts and all pairs; all of its tokens are packed."""
    from test_dedup import _near

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    lettered = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    last = {t: i for i, t in sorted(lettered.items())}
    unique = {i: t for t, i in last.items()}
    kept = {i for i, _, component, own in _near(sorted(unique.items()), 5, 80) if own}
    assert 0 < len(kept) < len(unique) < len(lettered)
    pieces = pipeline.run(spark, f"{DATA}/sf0.001").collect()
    fresh = Tokenizer.from_file(pipeline.public_tokenizers.path("word_bpe_49k.json"))
    sizes = Counter()
    for p in pieces:
        sizes[p["doc_id"]] += p["length"]
    assert sizes == {i: len(fresh.encode(docs[i], add_special_tokens=False).ids) + 1 for i in kept}


def test_stages_with_null_and_repeated_ids(spark):
    """Each row is judged by its own text, whatever its id; columns with the names that stages use within come through."""
    said = lambda w: " ".join(f"{w}{k} of the house" for k in "abcdefghijkl")
    rows = [(None, said("one")), (None, said("two")), (7, said("three")), (7, said("four")), (7, said("four")), (9, said("three")), (None, said("three")), (None, None)]
    names = ["id", "n", "digest", "key", "keep_id", "copies", "content", "signature", "component", "kept", "lang_pred", "score", "_gone", "_sha", "_id", "_twice", "a", "b", "size", "shingle"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names)
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *range(len(names))) for i, t in rows], schema)
    stages = _stages(spark, docs)
    for df in stages[:-1]:
        assert df.columns == docs.columns
    want = sorted([(None, said("one")), (None, said("two")), (7, said("four")), (9, said("three"))], key=str)
    for df in stages[1:3]:
        assert sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str) == want
    assert sorted((str(r["doc_id"]) for r in stages[-1].where("start = 0").collect())) == ["7", "9", "None", "None"]


def test_run_packs_what_is_kept(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    pieces = pipeline.run(spark, f"{DATA}/sf0.001").collect()
    t = packing.tokenizer(pipeline.public_tokenizers.path("word_bpe_49k.json"))
    assert len({p["doc_id"] for p in pieces}) > 0.7 * len(docs)
    for p in pieces[:200]:
        ids = np.append(np.frombuffer(t.encode(docs[p["doc_id"]]), "<u4"), 2).astype("<u4")
        assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) and p["doc_tokens"] == len(ids)
