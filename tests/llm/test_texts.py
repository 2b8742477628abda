import base64
import gzip
import hashlib
import io
import random
import sys
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
from helpers import DATA, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairfold.llm import bpe, chat, html_text, packing, queries, warc

SF = f"{DATA}/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


# --- chat ---------------------------------------------------------------------------------------------------------------


@given(st.text(alphabet="<|\\>im_startend \n日a"))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\n\nb", "<|im_end|>"]), st.text(alphabet="<|\\>im_endstart\n x"))))
@settings(max_examples=200)
def test_render_and_parse(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


LAYOUTS = [
    ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "extra": {"x": 1}}', "messages", [("user", "a"), ("assistant", "b")]),
    ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": null}, {"from": "gpt", "value": "c"}]}', "from_value", [("user", "a"), ("assistant", ""), ("assistant", "c")]),
    ('{"instruction": "do", "input": "this", "output": "done"}', "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ('{"instruction": "do", "output": "done", "input": null}', "instruction", [("user", "do"), ("assistant", "done")]),
    ('{"prompt": "p", "completion": "c", "system": "s"}', "prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ('{"prompt": "p", "response": "c"}', "prompt_response", [("user", "p"), ("assistant", "c")]),
    ('{"question": "q", "context": "c", "answer": "a"}', "question_answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ('{"prompt": "p", "chosen": "c", "rejected": "r"}', "preference", [("user", "p"), ("assistant", "c")]),
    ('{"messages": [{"role": "user", "content": null}]}', "messages", [("user", "")]),
    ('{"messages": [], "system": "s"}', "messages", [("system", "s")]),
    ('{"messages": [null]}', "messages", []),
    ('{"conversations": []}', "from_value", []),
    ('{"prompt": "p", "completion": null, "response": "r"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
    ('{"prompt": null, "completion": "c"}', "prompt_completion", [("assistant", "c")]),
    ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "x"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]}', "message_parts", [("user", "ab"), ("assistant", "c")]),
    ('{"messages": ["a"]}', None, []),
    ('{"foo": 1}', None, []),
    ("no json", None, []),
    (None, None, []),
]


def test_layouts(spark):
    df = spark.createDataFrame([(k, r) for k, (r, *_) in enumerate(LAYOUTS)], "conv_id long, record string")
    got = {r["conv_id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.turns_from_json(df, "record", "conv_id").collect()}
    assert got == {k: (n, t) for k, (_, n, t) in enumerate(LAYOUTS)}


def test_typed_layouts(spark):
    df = spark.createDataFrame([(1, "p", "c", None, 5), (2, None, None, "s", 6)], "conv_id long, prompt string, completion string, system string, n int")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.turns_from_columns(df).collect()}
    assert got == {1: [("user", "p"), ("assistant", "c")], 2: [("system", "s")]}
    m = spark.createDataFrame([(1, [("human", "x"), ("gpt", None)]), (2, None)], "conv_id long, conversations array<struct<`from`:string,value:string>>")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.turns_from_columns(m).collect()}
    assert got == {1: [("user", "x"), ("assistant", "")], 2: []}
    parts = spark.createDataFrame([(1, [("user", [("text", "x"), ("text", None), ("text", "y")]), ("assistant", None)])], "conv_id long, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    assert [tuple(t) for t in chat.turns_from_columns(parts).first()["turns"]] == [("user", "xy"), ("assistant", "")]
    with pytest.raises(ValueError):
        chat.turns_from_columns(spark.range(3))


def test_long_and_clashing_turn_rows(spark):
    long = "<|im_end|>ü\n" * 300_000
    rows = [(1, 0, "user", "q", "x", "y", 5, "p", "s"), (1, 1, "assistant", long, "x", "y", 5, "p", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, layout string, id int, prompt string, system string")
    made = chat.format_chat(df)
    assert chat.parse(made.first()["formatted"]) == [("user", "q"), ("assistant", long)]
    back = chat.read_back(made).first()
    assert (back["n_turns"], back["loss_chars"]) == (2, len(long)) and back["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def test_read_back_of_nulls_and_repeats(spark):
    turns = spark.createDataFrame([(1, [("user", "a"), None, (None, None)]), (1, None), (None, [])], f"conv_id long, turns {chat.TURNS}")
    got = sorted((str(r["conv_id"]), r["n_turns"]) for r in chat.read_back(chat.format_turns(turns)).collect())
    assert got == [("1", 0), ("1", 2), ("None", 0)]
    nothing = spark.createDataFrame([(1, None, None)], "conv_id long, formatted string, loss_spans array<struct<start:long,stop:long>>")
    assert chat.read_back(nothing).first()["n_turns"] == 0


def test_turn_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "user", "lost"), (1, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    assert chat.parse(got[1]["formatted"]) == [("", "x"), ("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert chat.parse(got[None]["formatted"]) == [("user", "lost")]
    assert chat.format_chat(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op1_chat_format", "op5_warc"])
def test_equals_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


# --- tokens -------------------------------------------------------------------------------------------------------------


def _tiktoken():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LETTERS = list("abcdeEé '.!?\n\t 0123ñßŉſİΣς<|>\x1c\x1f\x85\xa0 ªº½Ⅷ中文\U0001f600́̈T") + [chr(i) for i in range(0x250)]


def _random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_tiktoken(spark):
    own, other = bpe.encoder(RANKS, P.PATTERN), _tiktoken()
    texts = [*_random_texts(1500, 1), "a" * 20_000, "ab" * 7000, "thanedble" * 900, " " * 3000 + "x", ""]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t, ids in zip(texts, own.encode_many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
    for piece in (b"thereabouts", "größtenteils".encode(), b"xyzzyxyzzy" * 9):  # one tree at a time gives the same
        assert own.merge(piece) == other.encode_single_token(piece) if piece in own.ranks else own.merge(piece) == [x for x in other._encode_single_piece(piece)]


def test_bpe_cache_is_bounded_by_bytes():
    own, other, rng = bpe.Encoder(RANKS, P.PATTERN, budget=200_000), _tiktoken(), random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts = [word(20_000) for _ in range(10)] + [" ".join(word(rng.randrange(1, 900)) for _ in range(20)) for _ in range(150)]
    peak = 0
    for t in texts + texts[:20]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == other.encode_ordinary(t)
        held = {**own.old, **own.new}
        assert all(len(p) <= 1024 for p in held)
        peak = max(peak, sum(sys.getsizeof(p) + sys.getsizeof(x) for p, x in held.items()))
    assert 200_000 < peak < 2 * 200_000 + 100_000  # two generations and a text's pieces


def test_bpe_tables(spark, documents):
    docs = documents([(1, "Hello world"), (2, None), (None, ""), (1, "Hello world")])
    got = bpe.bpe_encode(docs, RANKS, P.PATTERN)
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == ["1", "1", "2", "None"]
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.bpe_decode(got, RANKS, P.PATTERN).collect()}
    assert back == {1: b"Hello world", 2: b"", None: b""}
    r = {r["doc_id"]: r for r in bpe.bpe_round_trip(docs, RANKS, P.PATTERN).collect()}
    assert r[1]["decoded_sha256"] == hashlib.sha256(b"Hello world").hexdigest() and r[2]["n_tokens"] == 0
    assert bpe.bpe_round_trip(docs.where("false"), RANKS, P.PATTERN).count() == 0


@lru_cache(1)
def _fresh_tokenizer():
    return Tokenizer.from_file(WORDS)


def _reference_ids(text):
    return _fresh_tokenizer().encode(text, add_special_tokens=False).ids


def test_word_ids_equal_the_library(spark):
    texts = [*_random_texts(1500, 2), "<|endoftext|> it's Don'T", "İstanbul ﬁne T̈ K", "a<|startoftext|>b <|EndOfText|>"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    parts = ["a", "É", "ß", "İ", "ı", "ſ", "'s", "'", "’", "\u0301", "1", "٣", "!", "?.", "_", "<|endoftext|>", "\x1c", " ", "\u0085", "\xa0", "\n", "中", "Σ", "×", "ª", "don't", "\x00", "\x7f", "😀", "\u200b"]
    rng = random.Random(9)
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)]
    small = packing.WordTokenizer(WORDS, budget=50_000)  # its generations go again and again
    for t in texts:
        want = np.array(_reference_ids(t), "<u4").tobytes()
        assert packing.tokenizer(WORDS).encode(t) == want == small.encode(t)
    assert _reference_ids("<|endoftext|>") == [49407]


def test_query_packs_with_little_padding(spark):
    """Each id of every document is in one piece, in sequences of at most 4096 with under one per cent of padding."""
    import zlib

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    pieces = queries.QUERIES["op4_packing"](spark, f"{DATA}/sf0.01").toPandas()
    sums = pieces.groupby("sequence_id")["length"].sum()
    assert sums.max() <= 4096
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sums.tolist())
    assert padding < 0.01 * sums.sum()
    offsets = pieces.sort_values(["sequence_id", "offset"])
    assert (offsets["offset"] == offsets.groupby("sequence_id")["length"].cumsum() - offsets["length"]).all()
    by_doc = dict(list(pieces.sort_values("start").groupby("doc_id")))
    for r in docs.collect():
        ids, at = np.array([*_reference_ids(r["text"] or ""), 2], "<u4"), 0
        for p in by_doc.pop(r["doc_id"]).itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert not by_doc


def test_pack_repeats_and_nulls(spark, documents):
    """Rows with the same or a null id are packed each on its own."""
    rows = [(1, "one two"), (1, "one two"), (1, "other"), (None, "one two"), (None, None), (2, " \n")]
    pieces = packing.pack(documents(rows), WORDS).collect()
    want = sorted(((i, len(_reference_ids(t or "")) + 1) for i, t in rows), key=str)
    assert sorted(((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0), key=str) == want
    assert sum(p["length"] for p in pieces) == sum(n for _, n in want)


def _best_cost(cuts, penalties, full):
    best = [0.0] + [float("inf")] * (len(cuts) - 1)
    for i in range(1, len(cuts)):
        for j in range(i):
            n = cuts[i] - cuts[j]
            if n <= full:
                best[i] = min(best[i], best[j] + (0 if n & (n - 1) == 0 else full - n) + penalties[i])
    return best[-1]


def test_cuts_are_optimal():
    rng = random.Random(5)
    for _ in range(300):
        full = rng.choice([8, 16, 64])
        cuts = [0]
        for _ in range(rng.randint(1, 25)):
            cuts.append(cuts[-1] + rng.randint(1, full))
        penalties = [0.0] + [rng.choice([0.0, 2.0, 5.0]) for _ in cuts[1:]]
        chosen = packing.choose_cuts(cuts, penalties, full)
        cost, at = 0.0, 0
        for c in chosen:
            n = c - at
            assert 0 < n <= full
            cost += (0 if n & (n - 1) == 0 else full - n) + penalties[cuts.index(c)]
            at = c
        assert at == cuts[-1] and abs(cost - _best_cost(cuts, penalties, full)) < 1e-9


def test_pack_covers_every_token(spark, documents):
    import zlib

    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [None, "", "word " * 9000, "x" * 30_000, "One. Two! Three?"]
    rows = list(enumerate(texts))
    pieces = packing.pack(documents(rows), WORDS, block=20_000).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in rows:
        ids = np.array([*_reference_ids(t or ""), 2], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = tokens = 0
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        tokens, padding = tokens + at, padding + (0 if at & (at - 1) == 0 else 4096 - at)
    assert padding < 0.02 * tokens
    assert packing.pack(documents([]).where("false"), WORDS).count() == 0


# --- pages --------------------------------------------------------------------------------------------------------------

LONG = "The quick brown fox is in the house of the king and it was there for a day that he had been with the people, so it goes on."
PAGES = [
    (f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head &amp; line</h1><p>{LONG}<p>Short.</article><footer>c</footer>", f"Head & line\n\n{LONG}\n\nShort."),
    (f'<body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">{LONG}</div><div id=content><h2>Title here</h2><p>{LONG}</p></div><section id="comments"><p>{LONG}</p></section>', f"Title here\n\n{LONG}"),
    (f"<main><header><h1>Kept</h1></header><p>{LONG}</p><aside><p>{LONG}</p></aside><form><p>{LONG}</p></form><div class='ad'>{LONG}</div><p>a<br>b &lt;i&gt; &#233;</p></main><p>{LONG}</p>", f"Kept\n\n{LONG}\n\na b <i> é"),
    (f'<article><p>{LONG}</p><script>var t="</p>{LONG}";</script><style>p{{}}</style><!-- <p>{LONG}</p> --><p>{LONG}</p></article>', f"{LONG}\n\n{LONG}"),
    (f'<div class="ad">left open<article><p title="a>b">{LONG}</p></article>', LONG),
    ("<p><a href=x>one link</a> <a href=y>another link</a></p>", ""),
    ("", ""),
    (None, ""),
    ("<", ""),
    ("<!-- never closed <p>x", ""),
]


def test_pages(spark):
    df = spark.createDataFrame([(k, "u", h, "x") for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    assert {k: r["text"] for k, r in got.items()} == {k: t for k, (_, t) in enumerate(PAGES)}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.extract_text(df.where("false")).count() == 0


SAID = "That is what the man of the house said to the king, and it was not what he had been asked for on that day, as we know."
LINKS = "".join(f"<li><a href=/{k}>Link number {k}</a></li>" for k in range(6))
WIDE = f"{LONG} {SAID}"
#: Pages without containers, with comments, teasers, forums and left-open furniture: (html, main text).
PAGE_LAYOUTS = {
    # no article, main or content class: the rules alone tell
    "plain": (f"<body><ul>{LINKS}</ul><p>Menu</p><h1>The head of it</h1><p>{WIDE}</p><p>Yes.</p><p>{WIDE}</p><ul>{LINKS}</ul><p>Imprint</p>", f"The head of it\n\n{WIDE}\n\nYes.\n\n{WIDE}"),
    "table": (f"<table><tr><td><a href=1>One</a> <a href=2>Two</a></td></tr><tr><td><b>News</b><p>{WIDE}<p>{WIDE}</td></tr><tr><td><a href=3>Three</a></td></tr><tr><td>(c) us</td></tr></table>", f"News\n\n{WIDE}\n\n{WIDE}"),
    "comments": (f"<article><h1>Title</h1><p>{LONG}</p></article><div id='comments'><article class='comment'><p>{SAID}</p></article><article><p>{SAID}</p></article></div>", f"Title\n\n{LONG}"),
    "comment list": (f"<div class='post'><h1>Title</h1><p>{LONG}</p></div><ol class='comment-list'><li><article class='comment-body'><p>{SAID}</p></article></ol>", f"Title\n\n{LONG}"),
    "open comments": (f"<article><p>{LONG}</p></article><section class='comments'><article><p>{SAID}</p></article>", LONG),
    "teasers": (f"<main><article><h1>Title</h1><p>{LONG}</p></article><div class='related'><article><h3><a href=1>More of this</a></h3><p>Short words.</p></article></div></main>", f"Title\n\n{LONG}"),
    "teasers without a class": (f"<article><h1>Title</h1><p>{LONG}</p></article><article><h3><a href=1>Another story of the day</a></h3><p>Short words.</p></article>", f"Title\n\n{LONG}"),
    "forum": (f"<div class='breadcrumb'><a href=/>All</a></div><div class='thread'><h1>How is it?</h1><div><p>{WIDE}</p><p>Thanks!</p></div></div><div class='pagination'><a href=2>2</a></div>", f"How is it?\n\n{WIDE}\n\nThanks!"),
    "open advert": (f"<div class='ad'>buy this<article><p>{LONG}</p></article><footer>end</footer>", LONG),
    "links within": (f"<article><p>{LONG}</p><p>See also</p><ul>{LINKS}</ul><p>Tags: x</p><ul>{LINKS}</ul><p>{SAID}</p></article>", f"{LONG}\n\nSee also\n\n{SAID}"),
    "short article": ("<nav><a href=/>Home</a></nav><article><h1>News</h1><p>It rains.</p></article>", "News\n\nIt rains."),
    "nothing": ("<p>Not found</p>", ""),
    "entities": (f"<main><p>a &lt;p&gt; &amp;amp; &#x41;&nbsp;b</p><p>{LONG}</p></main>", f"a <p> &amp; A b\n\n{LONG}"),
}


FINNISH = "Vanha talo seisoi kaukana metsässä, jossa kukaan ei ollut vuosiin kulkenut. Sen ikkunat olivat rikki, ja tuuli lauloi huoneissa kuin kadonnut lapsi."
JAPANESE = "昔々あるところにお爺さんとお婆さんが住んでいました。お爺さんは山へ柴刈りに、お婆さんは川へ洗濯に行きました。ある日、大きな桃が流れてきました。"
PAGE_LAYOUTS |= {
    # a word of furniture among others doesn't decide alone
    "market share": (f"<ul>{LINKS}</ul><div class='market-share'><p>{WIDE}</p></div>", WIDE),
    "art form": (f"<article><h1>Title</h1><section id='art-form'><p>{WIDE}</p></section></article>", f"Title\n\n{WIDE}"),
    "cookie recipe": (f"<main class='cookie-recipe'><p>{WIDE}</p></main>", WIDE),
    "paragraph": (f"<article><p class='search-of-truth'>{LONG}</p></article>", LONG),
    "named advert": (f"<article><p>{LONG}</p><div class='promo-spring-sale'>Buy now for less</div><p>{LONG}</p></article>", f"{LONG}\n\n{LONG}"),
    # words of furniture alone, or with words that tell nothing, do
    "share buttons": (f"<article><p>{LONG}</p><div class='share-buttons top'><p>{WIDE}</p></div></article>", LONG),
    "user comment": (f"<article><p>{LONG}</p></article><div class='user-comment js-item'><p>{WIDE}</p></div>", LONG),
    "notice": (f"<div id='siteNotice'><p>{WIDE}</p></div><div><p>{WIDE}</p></div>", WIDE),
    # languages without known stop words
    "finnish": (f"<ul>{LINKS}</ul><div>{FINNISH}</div><div>{FINNISH}</div><ul>{LINKS}</ul>", f"{FINNISH}\n\n{FINNISH}"),
    "japanese": (f"<ul>{LINKS}</ul><div>{JAPANESE}</div><div>{JAPANESE}</div><ul>{LINKS}</ul>", f"{JAPANESE}\n\n{JAPANESE}"),
    "words in a row": (f"<ul>{LINKS}</ul><div>{'alpha beta gamma delta ' * 12}</div>", ""),
}


@pytest.mark.parametrize("name", PAGE_LAYOUTS)
def test_page_layouts(name):
    page, want = PAGE_LAYOUTS[name]
    assert html_text.main_text(page) == want


def test_both_passes_count(monkeypatch):
    """Without either pass, pages come out otherwise: undecided blocks are lost, or link lists stay."""
    right = {k for k, (page, want) in PAGE_LAYOUTS.items() if html_text.main_text(page) == want}
    assert right == set(PAGE_LAYOUTS)
    with monkeypatch.context() as m:
        m.setattr(html_text, "second_pass", lambda blocks, first: [bool(x) for x, _ in first])
        lost = {k for k, (page, want) in PAGE_LAYOUTS.items() if html_text.main_text(page) != want}
    assert {"plain", "table", "forum", "links within"} <= lost
    for verdict in (True, None):
        with monkeypatch.context() as m:
            m.setattr(html_text, "first_pass", lambda block, known, v=verdict: (v, False))
            wrong = {k for k, (page, want) in PAGE_LAYOUTS.items() if html_text.main_text(page) != want}
        assert {"plain", "table", "links within"} <= wrong


@pytest.mark.parametrize("page", [
    "<p>x</p>" + "<a " * 700_000, "<div>" * 150_000 + "</section>" * 150_000, '<a "' * 500_000, '<a ">' * 400_000 + '"', "<dl><dt><dl>" + "<div>" * 100_000 + "<dt></dt>" * 100_000,
    "<li><div>" * 150_000, "<" * 2_000_000, "<!--" * 500_000, "<p class" + " " * 2_000_000 + "x>a", "<script>" * 200_000, "&" * 2_000_000,
])
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 15


def test_repeated_pages(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>"), (1, "u", f"<p>{LONG}</p>"), (None, None, f"<p>{LONG}</p>")], "page_id long, url string, html string")
    assert [r["text"] for r in html_text.extract_text(df).collect()] == [LONG] * 3


def test_pages_of_the_test_data(spark):
    """The articles by plain rules that fit these pages' markup."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["op2_html_text"](spark, SF).collect():
        inner = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(p for p in parts if p)


def test_long_page():
    text = html_text.main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")
    assert text.count("\n\n") == 19_999


# --- archives -----------------------------------------------------------------------------------------------------------


def test_arc_versions():
    for version in (1, 2):
        raw = warc.arc_version_block("x.arc", "20240101000000", version) + b"\n"
        bodies = [b"HTTP/1.1 200 OK\r\n\r\n\n\nbody\n", b"", b"plain\nfiledesc://no 1\n"]
        for k, body in enumerate(bodies):
            raw += warc.arc_record(f"http://a b/{k}", "1.2.3.4", "20240203040506", "text/plain", body, version) + b"\n"
        found = list(warc.read_arc(io.BytesIO(raw)))
        assert [r["body"] for r in found[1:]] == bodies and found[1]["URL"] == "http://a%20b/0"
        got = [warc.convert(r) for r in found]
        assert [r["type"] for r in got] == ["warcinfo", "response", "resource", "resource"]
        assert got[1]["payload"] == b"\n\nbody\n" and got[1]["date"] == "2024-02-03T04:05:06Z"
        assert warc.convert(found[1])["id"] == got[1]["id"]
        block = b"".join(warc.warc_record(r) + b"\r\n\r\n" for r in got)
        headers = list(warc.read_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(block))))))
        assert [h["warc-type"] for h, _ in headers] == [r["type"] for r in got]
        assert [b for _, b in headers] == [r["head"] + r["payload"] for r in got]
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(b"http://x 1.2.3.4 20240101000000 text/plain 50\nshort\n")))
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(b"http://x 1.2.3.4 text/plain 5\nshort\n")))


def test_arc_dates():
    dates = {"20240203040506": "2024-02-03T04:05:06Z", "202402030405": "2024-02-03T04:05:00Z", "20240203": "2024-02-03T00:00:00Z", "2024": "2024-01-01T00:00:00Z", "00000000000000": None, "20241301000000": None, "202": None, "": None, "2024020304050": None}
    assert {d: warc.warc_date(d) for d in dates} == dates


def test_bad_arc_records_are_rejected(spark, tmp_path):
    """URLs with blanks are read, and bad records are told of; those around them are converted."""
    good = lambda k: f"http://x/{k} y 10.0.0.{k} 20240203040506 text/html 4\nbod{k}\n".encode()
    bad = [b"http://bad 1.2.3.4 20240203040506 text/html many\nabc\n", b"short line\nabc\n", b"http://nodate 1.2.3.4 00000000000000 text/html 3\nabc\n", b"http://cut 1.2.3.4 20240203040506 text/html 500\nabc\n"]
    raw = warc.arc_version_block("x.arc", "20240101000000", 1) + b"\n" + b"".join(x for k in range(3) for x in (good(k), bad[k])) + good(3) + bad[3]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/a.arc").write_bytes(raw)
    (tmp_path / "arc/b.arc.gz").write_bytes(gzip.compress(warc.arc_version_block("b", "2024", 2) + b"\nhttp://v2 1.2.3.4 20240203 text/html 404 abcd http://to 0 b.arc 2\nhi\n"))
    rejects = warc.arc_rejects(spark, f"file://{tmp_path}/arc").collect()
    assert sorted((r["line"].split(b"\n")[0][:12], r["reason"].split(":")[0]) for r in rejects) == [
        (b"http://bad 1", "a header line has no length"), (b"http://cut 1", "4 bytes instead of 500"), (b"http://nodat", "no date"), (b"short line", "a header line has 2 fields instead of 5")]
    warc.convert_arc(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    found = []
    for f in (tmp_path / "warc").glob("*.gz"):
        found += list(warc.read_warc(io.BufferedReader(gzip.GzipFile(f))))
    by = {h["warc-target-uri"]: (h, b) for h, b in found if h["warc-type"] != "warcinfo"}
    assert {u: b for u, (_, b) in by.items()} == {f"http://x/{k} y": f"bod{k}".encode() for k in range(4)} | {"http://v2": b"hi"}
    assert by["http://x/2 y"][0]["warc-ip-address"] == "10.0.0.2"
    h = by["http://v2"][0]
    assert (h["arc-result-code"], h["arc-checksum"], h["arc-location"], h["warc-date"]) == ("404", "abcd", "http://to", "2024-02-03T00:00:00Z")


def test_archives_of_repeated_and_long_pages(spark):
    long = "<p>ü" * 400_000
    rows = [(1, "http://a", long), (1, "http://a", long), (2, "http://b", long), (2, "http://b", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.through_archives(df).collect())
    n = len(long.encode())
    assert [(i, s, k) for i, s, k, _ in got] == [(1, n, "revisit"), (1, n, "revisit"), (2, 1, "response"), (2, n, "response")]
    assert [t for *_, t in got] == [2, 2, None, None]


def test_archives_of_pages(spark):
    rows = [(1, "http://a", "<p>same</p>"), (5, "http://b#x", "<p>same</p>"), (3, None, None), (4, "http://c d", ""), (7, "http://e", "WARC/1.1\r\n\r\nü\r\n\r\n"), (None, "http://f", "alone")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.through_archives(df).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kinds = {1: ("revisit", 5), 5: ("response", None), 3: ("revisit", 4), 4: ("response", None), 7: ("response", None), None: ("response", None)}
    assert got == {i: (len((t or "").encode()), sha(t), *kinds[i]) for i, _, t in rows}
    some = {r["page_id"]: r["record_type"] for r in warc.through_archives(df, min_bytes=1).collect()}
    assert some[3] == "response" and some[1] == "revisit"
    assert warc.through_archives(df.where("false")).count() == 0
