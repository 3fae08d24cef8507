import hashlib
import random
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engram.llm import alignment
from engram.llm.alignment import Transducer, align_tokenizers, aligner
from engram.llm.arrays import utf8
from engram.llm.queries import vocabulary
from engram.llm.token_counts import byte_symbols
from helpers import ODD, empty_docs, odd_docs

BPE, SPM = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=SPM)


def plain(library, text):
    """Groups (ids of a, ids of b) and links of one text by byte offsets."""
    tok, sp = library
    if not text:
        return [], []
    byte = byte_symbols()
    a = [(i, bytes(byte[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    own = (" " + text).encode()
    if b"".join(x for _, x in a) != own or b"".join(x for _, x in b) != own:
        return [], []

    def spans(side):
        at, out = 0, []
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    a, b = spans(a), spans(b)
    ends = sorted({e for *_, e in a} & {e for *_, e in b})
    groups = [([], []) for _ in ends]
    for side, tokens in enumerate((a, b)):
        for i, _, e in tokens:
            groups[bisect_left(ends, e)][side].append(i)
    links, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            links.append((i, b[k][0]))
            k += 1
    return groups, links


def expected(library, texts):
    each = [plain(library, t) for t in texts]
    count = Counter(x for _, links in each for x in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for groups, links in each:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
WILD = st.text(st.one_of(st.sampled_from("abcets  \n\n\t'.,09▁é中ü\r\x00\x01\x85\xa0 　 "), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(WILD, min_size=1, max_size=6))
def test_texts_equal_offsets(library, texts):
    m = aligner(BPE, SPM)
    totals, digest, text, pair, times = m.texts(*utf8(pa.array(texts, pa.large_string())))
    for k, t in enumerate(texts):
        groups, links = plain(library, t)
        assert totals[k].tolist() == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links)], repr(t)
        assert digest[k] == (hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if groups else "")
        assert {divmod(p, m.width): n for p, n, of in zip(pair.tolist(), times.tolist(), text.tolist()) if of == k} == Counter(links)


def test_transducer_steps():
    t = Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"x"])
    a_leads = t.transition(alignment.EMPTY, 0)
    b_left = t.transition(a_leads, 3)
    b_leads = t.transition(b_left, 4)
    assert [t.residual[s] for s in (a_leads, b_left, b_leads)] == [(True, b"ab"), (True, b"b"), (False, b"c")]
    assert t.transition(b_leads, 1) == alignment.EMPTY and t.transition(a_leads, 5) == alignment.FAILED


def test_odd_rows(spark, library, monkeypatch):
    texts = [x or "" for _, x in ODD] + ["a<|endoftext|></s> b", " ", "a  中", "x▁y", "naïve\nnaïve\n\n naïve"]
    want = expected(library, texts)
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(100 + i, t, "c", "x", 0) for i, t in enumerate(texts[len(ODD) :])], odd_docs(spark).schema))
    ids = [i for i, _ in ODD] + [100 + i for i in range(len(texts) - len(ODD))]
    key = lambda r: repr(r)
    for share in (1 << 18, 20, 1):  # with pairs joined, too
        monkeypatch.setattr(alignment, "HEAVY", share)
        got = align_tokenizers(docs, BPE, SPM)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted([(r["doc_id"], *(r[c] for c in COLUMNS)) for r in got.collect()], key=key) == sorted([(i, *w) for i, w in zip(ids, want)], key=key)


def test_empty_table(spark):
    assert align_tokenizers(empty_docs(spark), BPE, SPM).count() == 0


def test_long_varied_words(library):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/") for _ in range(60_000))
    totals, digest, *_ = aligner(BPE, SPM).texts(*utf8(pa.array([text], pa.large_string())))
    groups, links = plain(library, text)
    assert totals[0].tolist() == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links)]
    assert digest[0] == hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest()
