"""BPE by tree reduction against the library it must equal, round trips, and packing."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqlab.llm import bpe, packing

BPE = bpe.loaded(bpe.default_ranks(), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BPE.rank, special_tokens={})
PARTS = ["a", "the", "er", "'s", "'ll", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "᠎", "é", "ß", "日本", "1", "23", "#", "===", "!?", "x" * 33, "ab" * 20, "<|endoftext|>", "\U0001f600"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60))
def test_equals_library(parts):
    text = "".join(parts)
    ids = BPE.encode(text)
    assert ids == np.array(LIBRARY.encode_ordinary(text), dtype="<u4").tobytes()
    assert BPE.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_equals_library_on_any_text(text):
    assert BPE.encode(text) == np.array(LIBRARY.encode_ordinary(text), dtype="<u4").tobytes()


@pytest.mark.parametrize("text", ["=" * 5001, "ab" * 3000, "a" * 4097, " " * 3001, "\n" * 2001, "thequickbrownfox" * 500])
def test_long_runs(text):
    assert BPE.encode(text) == np.array(LIBRARY.encode_ordinary(text), dtype="<u4").tobytes()


def test_packing_tokens_equal_tokenizers():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    own = packing.tokens_of(bpe.default_ranks(), public_tokenizers.PATTERN)
    for text in ["", "Hello  world\n\nagain", "naïve café #1", "It's <|endoftext|> here", "x\ty " * 50]:
        assert own.encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_pieces_equal_tokenizers_at_its_defaults(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["It's <|endoftext|> here", "<|endoftext|>", "a<|endoftext|><|endoftext|>b \n", "<|endoftext", "x <|endoftext|>", ""]
    got = {r.doc_id: r for r in packing.pieces_of(docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, packing.END_ID], dtype="<u4").tobytes()
        assert (got[i].length, got[i].ids_crc32) == (len(ids) // 4, zlib.crc32(ids)), text


def test_encode_table(spark, docs):
    rows = [(1, None), (2, ""), (3, "plain words here"), (3, "plain words here"), (None, "x"), (4, "long " * 30_000)]
    got = bpe.encode(docs(rows, True), decoded=True).toArrow().to_pylist()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) // 4
    assert {hashlib.sha256(r["decoded"]).hexdigest() for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert bpe.encode(docs([])).count() == 0
    assert bpe.decode(bpe.encode(docs(rows))).count() == len(rows)


def test_packing_is_whole_and_tight(spark, docs):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 3000)))) for i in range(200)] + [(7, None), (7, None)]
    got = packing.packed(docs(rows, True)).toPandas()
    assert got.groupby("doc_id").piece.min().eq(0).all()
    total = sum(len(BPE.encode(t or "")) // 4 + 1 for _, t in rows)
    assert got.length.sum() == total and got.length.max() <= 1024
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-total // 1024) * 1.02 + 1
    assert (got[got.piece > 0].length == 1024).all()
    assert packing.packed(docs([])).count() == 0


def test_fullest_bin_closes_first():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (7, 4, 9)] == [(0, 0), (1, 0), (2, 0)]
    assert fit.place(6) == (1, 4)  # bin 0, the fuller one, was closed for bin 2
    assert fit.place(1) == (2, 9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=120), st.integers(1, 6))
def test_best_fit_equals_a_plain_search(lengths, most):
    """Against a list of open bins searched from end to end: the tightest that holds the piece, of equals the one that got there last."""
    fit, open_, made = packing.BestFit(20, most), [], 0
    for length in lengths:
        holds = [b for b in open_ if b["free"] >= length]
        if holds:
            own = min(reversed(holds), key=lambda b: b["free"])
            open_.remove(own)
        else:
            if len(open_) >= most:
                open_.remove(min(reversed(open_), key=lambda b: b["free"]))
            own = {"name": made, "free": 20}
            made += 1
        want = (own["name"], 20 - own["free"])
        own["free"] -= length
        if own["free"]:
            open_.append(own)
        assert fit.place(length) == want
        assert fit.count == len(open_) <= most


def test_few_open_bins_still_pack_everything(spark, docs):
    rows = [(i % 5, "word " * (i * 37 % 700)) for i in range(300)]
    got = packing.packed(docs(rows), open_bins=2).toPandas()
    assert got.length.sum() == sum(len(BPE.encode(t)) // 4 + 1 for _, t in rows)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 1024


def test_packing_of_a_whole_table(spark):
    """Pieces against the library at its defaults, and at most 1 % more sequences than the tokens need."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.packed(table).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = {i: p.sort_values("piece") for i, p in got.groupby("doc_id")}
    rows = table.select("doc_id", "text").collect()
    assert len(own) == len(rows)
    for r in rows:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        at = 0
        for p in own[r.doc_id].itertuples():
            assert (p.start, p.ids_crc32) == (at, zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert got.sequence_id.nunique() <= got.length.sum() / 1024 * 1.01 + 1
