"""Token counts and byte-level BPE against the public libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_cases import LONG, ROWS, empty, odd
from tokenizers import Tokenizer

from taxomatch.llm import byte_bpe as B
from taxomatch.llm import queries
from taxomatch.llm import token_count as C

SF = "/root/testdata/sf0.001"
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    letters = "aZé ß\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 \u2003\u200b\u180e\ufeff'sdlvetm0१½一龍😀!,.$<|>ʼ́Ⅷ"
    fuzz = ["".join(r.choice(letters) for _ in range(r.randrange(50))) for _ in range(4000)]
    words = [" ".join("".join(r.choice("etaoinshr") for _ in range(r.randrange(1, 15))) for _ in range(40))
             for _ in range(300)]
    return fuzz + words + ["a<|endoftext|>b <|endoftext|> ", "<|endoftext|>" * 3, "<|endoftext", "ab" * 5000,
                           " " * 300, "\n" * 70 + "x", "é" * 400, "a", "", *(t for _, t in ROWS if t)]


def test_counts_equal_the_library(texts):
    counter, tok = C.MergeCounter(JSON, P.PATTERN), Tokenizer.from_file(JSON)
    want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want


def test_ids_equal_the_library_and_decode(texts, library):
    enc = B.Encoder(RANKS, P.PATTERN)
    for t in texts:
        ids = np.frombuffer(enc.encode(t), "<u4").tolist()
        assert ids == library.encode_ordinary(t)
        assert enc.vocabulary.decode(ids) == t.encode()


def test_small_memos_change_nothing(monkeypatch, library):
    from taxomatch.llm import pieces

    monkeypatch.setattr(pieces, "CHUNKS", 5)
    monkeypatch.setattr(pieces, "PIECES", 3)
    monkeypatch.setattr(B, "PAIRS", 4)
    monkeypatch.setattr(B, "PREFIXES", 3)
    monkeypatch.setattr(B, "SHORT", 2)
    enc, tok, counter = B.Encoder(RANKS, P.PATTERN), Tokenizer.from_file(JSON), C.MergeCounter(JSON, P.PATTERN)
    for t in (LONG[:3000], "the thing of things in thing"):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == library.encode_ordinary(t)
        assert counter.count(t) == len(tok.encode(t, add_special_tokens=False).ids)


def test_appends_and_edits_of_the_prefix_table(library):
    v, r = B.Vocabulary(RANKS), random.Random(3)
    table = B.Prefixes(v, b"thneonationable" * 40)
    few = 0
    for _ in range(150):
        a = r.randrange(len(table.data) + 1)
        b = min(len(table.data), a + r.randrange(6))
        few += table.replace(a, b, bytes(r.choice(b"thnea ") for _ in range(r.randrange(7)))) < 200
        assert table.last == B.Prefixes(v, table.data).last
    assert few > 100  # an edit is worked out near its place only
    grown = B.Prefixes(v)
    for i in range(0, 60, 7):
        grown.append(table.data[i : min(i + 7, 60)])
    assert grown.last == B.Prefixes(v, table.data[:60]).last
    assert grown.ids() == v_ids(v, table.data[:60])


def v_ids(v, data):
    return [v.rank[t] for t in v.merged(data)]


def test_queries_against_the_libraries(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tok = Tokenizer.from_file(JSON)
    for r in queries.op6_token_counts(spark, SF).collect():
        n = len(tok.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)
    for r in queries.op8_byte_bpe(spark, SF).collect():
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, library):
    counted = C.token_counts(odd(spark), JSON, P.PATTERN).collect()
    assert len(counted) == len(ROWS)
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in counted if not r.text] == [(0, 0, False)] * 2
    coded = B.encode(odd(spark), RANKS, P.PATTERN)
    for r in B.decode(coded, RANKS, P.PATTERN).collect():
        assert r.token_ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert C.token_counts(empty(spark), JSON, P.PATTERN).count() == 0
    assert B.encode(empty(spark), RANKS, P.PATTERN).count() == 0
