"""Token counts: the tokenizer itself is the brute force."""

import numpy as np
import public_tokenizers as P
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scorekit.llm import token_counts as T

from .conftest import rows_of

JSON = P.path("byte_bpe_50k.json")
TRICKY = [
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "  lead", "trail  ",
    "tabs\t\tand\n\n\nlines\r\n", "it's we're I'll 'sx 's 'S", "12 345 6.78", "x" * 500,
    "՘֋ unknown ꟒ letters 1՘a", "　wide space s", "é" * 90,
    "\x1c\x1d a\x1eb", "日本語 текст العربية", "👩‍👩‍👧 🏳️‍🌈", "á é", "…—“q”", " ", "\n",
]


def brute(tokenizer, rows):
    return sorted(str((r["doc_id"], len((r["text"] or "").encode()),
                       len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)))
                  for r in rows)


def got(df):
    return sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"])) for r in rows_of(df))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def test_matches_the_tokenizer(docs, tokenizer):
    assert got(T.token_counts(docs, JSON, P.PATTERN)) == brute(tokenizer, rows_of(docs))


@pytest.mark.parametrize("sizes", [{}, {"block_tokens": 1}, {"block_pairs": 700},
                                   {"block_tokens": 300, "chunk": 50, "part": 90}])
def test_blocks_of_any_size(spark, docs, tokenizer, sizes):
    """One block a task, one a document, and blocks that end within documents."""
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    some = docs.select("doc_id", "text").limit(40).unionByName(tricky)
    assert got(T.token_counts(some, JSON, P.PATTERN, **sizes)) == brute(tokenizer, rows_of(some))


def test_edge_rows(edge, empty, tokenizer):
    assert got(T.token_counts(edge, JSON, P.PATTERN)) == brute(tokenizer, rows_of(edge))
    assert T.token_counts(empty, JSON, P.PATTERN).count() == 0


def test_library_split_without_a_pattern(edge, tokenizer):
    assert got(T.token_counts(edge, JSON)) == brute(tokenizer, rows_of(edge))


def test_another_vocabulary(docs):
    """Lower case, word ends, another splitter, from the file alone."""
    path = P.path("word_bpe_49k.json")
    assert got(T.token_counts(docs, path)) == brute(Tokenizer.from_file(path), rows_of(docs))


def test_chunks_of_a_document_and_string_ids(spark, tokenizer):
    rows = [("a", " ".join(f"w{i}" for i in range(900))), ("a", "short"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    written = rows_of(T.pre_token_counts(df, JSON, P.PATTERN, chunk=100).where("tokens is null"))
    docs = [(r, p, n) for w in written for r, p, n in zip(w["row"], w["pieces"], w["sizes"])]
    sizes = [n for _, _, n in docs]
    assert max(sizes) == 100 and min(sizes) == 0 and len({r for r, _, _ in docs}) == 3
    assert sorted({p for _, p, _ in docs}) == [1, sizes.count(100) + 1]
    assert got(T.token_counts(df, JSON, P.PATTERN, chunk=100)) == brute(tokenizer, rows_of(df))


@pytest.mark.parametrize("part", [1, 5, 40])
def test_parts_change_nothing(part):
    text = ("Some  words\t here, it's 12 x <|endoftext|> y\n\n z " * 20
            + "word " * 30 + "՘ a֋ b ")
    whole, cut = T.PreTokens(JSON, P.PATTERN), T.PreTokens(JSON, P.PATTERN, part)
    assert cut(text) == whole(text) and len(list(cut.parts(text))) > 3


def test_characters_known_to_the_pattern_split_as_in_the_library(tokenizer):
    """Every character but those that Python's own table does not know."""
    split = T.PreTokens(JSON, P.PATTERN)
    known = [c for c in map(chr, range(0x110000))
             if not "\ud800" <= c <= "\udfff" and not split.young(c)]
    find = regex.compile(P.PATTERN).findall
    for at in range(0, len(known), 1000):
        text = "".join(f"a{c}a 1{c}1 !{c}! {c}\n" for c in known[at:at + 1000])
        found = tokenizer.pre_tokenizer.pre_tokenize_str(text)
        assert [text[i:j] for _, (i, j) in found] == find(text)
    assert split.young("a\u0558") and not split.young("a\u0556")


def test_each_entry_of_a_block_has_its_pieces(docs, tokenizer):
    written = T.pre_token_counts(docs, JSON, P.PATTERN, block_tokens=2000)
    words = {(r["block"], r["first"] + i): w for r in rows_of(written) if r["tokens"] is not None
             for i, w in enumerate(r["tokens"])}
    assert len({b for b, _ in words}) > 3
    got = {divmod(r["entry"], 1 << T.NUMBER_BITS): r["pieces"]
           for r in rows_of(T.piece_counts(written, JSON, P.PATTERN))}
    assert got.keys() == words.keys()
    some = sorted(words)[::37]
    assert [got[k] for k in some] == [len(tokenizer.encode(words[k]).ids) for k in some]


def test_a_pre_token_of_every_block_is_split_once(spark):
    """Runs of one pre-token go on over batches; the rows of others lie between them."""
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", 10_000
    df = spark.createDataFrame([(i, f"same x{i} same" + " -" * 40) for i in range(300)],
                               "doc_id long, text string")
    spark.conf.set(key, 7)
    try:
        rows = rows_of(T.token_counts(df, JSON, P.PATTERN, block_tokens=2))
    finally:
        spark.conf.set(key, old)
    assert sorted(map(str, rows)) == sorted(map(str, rows_of(T.token_counts(df, JSON, P.PATTERN))))


def test_long_pre_tokens(spark, tokenizer):
    df = spark.createDataFrame([(i, "-" * 300 + "=" * i) for i in range(200)],
                               "doc_id long, text string")
    assert got(T.token_counts(df, JSON, P.PATTERN)) == brute(tokenizer, rows_of(df))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 2 ** 20), st.integers(1, 2 ** 31), max_size=6),
                min_size=1, max_size=6))
def test_packing_is_a_round_trip(docs):
    sizes = [len(d) for d in docs]
    payload = T.packed(sizes, [n for d in docs for n in d], [c for d in docs for c in d.values()])
    numbers, counts = T.unpacked(np.array(sizes), payload)
    at = np.cumsum([0, *sizes])
    assert [dict(zip(numbers[a:b].tolist(), counts[a:b].tolist())) for a, b in zip(at, at[1:])] == docs
