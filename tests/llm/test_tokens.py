import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engram.llm.queries import vocabulary
from engram.llm.sentencepiece_arrays import decode_pieces, encode_pieces, piece_model
from engram.llm.token_counts import merger, token_counts
from helpers import ODD, empty_docs, odd_docs

BPE, SPM = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=SPM)


TEXTS = st.lists(st.text(st.one_of(st.sampled_from("abcet  \n\t'.,09▁é中\r\x01"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_counts_equal_library(library, texts):
    assert merger(BPE).texts(texts) == [len(e.ids) for e in library[0].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_pieces_equal_library(library, texts):
    from engram.llm.arrays import utf8
    import pyarrow as pa

    ids, n = piece_model(SPM).encode(*utf8(pa.array(texts, pa.large_string())))
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == [library[1].encode(t) for t in texts]


def test_special_strings(library):
    texts = ["a<|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext"]
    assert merger(BPE).texts(texts) == [len(e.ids) for e in library[0].encode_batch(texts, add_special_tokens=False)]


def test_odd_rows(spark, library):
    got = sorted(((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(odd_docs(spark), BPE).collect()))
    want = sorted((i or -1, len((t or "").encode()), (n := len(library[0].encode(t or "", add_special_tokens=False).ids)), n > 1024) for i, t in ODD)
    assert got == want
    assert token_counts(empty_docs(spark), BPE).count() == 0 and encode_pieces(empty_docs(spark), SPM).count() == 0


def test_round_trip(spark, library):
    enc = encode_pieces(odd_docs(spark), SPM)
    for r in enc.collect():
        assert r["pieces_sha256"] == hashlib.sha256(np.array(r["piece_ids"], "<i4").tobytes()).hexdigest() and r["n_pieces"] == len(r["piece_ids"])
        assert r["round_trip"] == (r["doc_id"] != 7)
    back = sorted((r["doc_id"] or -1, r["text"]) for r in decode_pieces(enc, SPM).collect())
    assert back == sorted((i or -1, (t or "").replace("▁", " ")) for i, t in ODD)
