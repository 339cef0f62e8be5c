"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framejobs.llm.bpe import Bpe, decode_documents, encode_documents, load, op12_bpe, tokenizer_path

ODD = [
    "", " ", "a", "Don't STOP 123", "naïve Straße ÀÉÎ ß İI Σίσυφος ΣΑΣ", "é Å ﬁ Å", "x y　z\x85w\xa0v\x1cq\x1f", "<|endoftext|>", "a<|startoftext|> B<|endoftext|>c",
    "<|ENDOFTEXT|> <|endoftext", "日本語 テスト 한국어", "\U0001f600\U0001f468‍\U0001f469", "'s't're've'm'll'd 'S 'RE", "١٢٣ ½ ²", "\x00\x01", "a" * 5000, "ab" * 3000 + " " + "!?" * 2000, "“q” – … €5",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def same(bpe, library, texts):
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == expected, text[:80]
        assert bpe.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_odd_texts(library):
    same(Bpe(tokenizer_path()), library, ODD)
    same(Bpe(tokenizer_path()), library, ODD[::-1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_any_texts(texts):
    same(load(tokenizer_path()), Tokenizer.from_file(tokenizer_path()), texts)


def test_random_letters_and_a_full_memory(library, monkeypatch):
    monkeypatch.setattr("framejobs.llm.bpe.KEPT", 50)
    monkeypatch.setattr("framejobs.llm.bpe.AT_ONCE", 70)
    monkeypatch.setattr("framejobs.llm.bpe.MANY", 2)
    r, bpe = random.Random(2), Bpe(tokenizer_path())
    for _ in range(20):
        same(bpe, library, ["".join(r.choice("aabcdeeinrstth é'!1 ") for _ in range(r.randrange(200))) for _ in range(10)])


def test_lower_ranks_that_a_merge_makes_go_first():
    bpe = Bpe(tokenizer_path())
    # Rules by rank: (y, z) makes b, which comes after what its merge allows, (a, b).
    bpe.rules, letters = [(1, 4, 5), (2, 3, 4), (4, 4, 6)], {c: i for i, c in enumerate("-ayz")}
    assert bpe.ascending
    bpe.index_rules()
    assert not bpe.ascending
    bpe.inner = bpe.last = np.array([letters.get(chr(b), -1) for b in range(256)], dtype=np.int32)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in bpe.merge(["ayzyz", "yzyzyz", "yzayz"])] == [[5, 4], [6, 4], [4, 5]]


def test_documents_with_nulls_repeats_and_clashing_names(spark, library):
    rows = [(1, "Hello"), (1, "Hello"), (2, None), (None, "World <|endoftext|>"), (3, ""), (4, "word " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "batch", "id")})
    got = decode_documents(encode_documents(df)).collect()
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["text"]) for r in got), key=key) == sorted(expected, key=key)
    assert decode_documents(encode_documents(df.limit(0))).collect() == []


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in op12_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
