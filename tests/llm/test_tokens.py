import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import queries as q
from quillspark.llm import tokens as t

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    tok = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text, add_special_tokens=False).ids if text else []


@pytest.fixture(scope="module")
def mine():
    enc = t.TrieEncoder(t.vocabulary_path(), t.split_pattern())

    def ids(text):
        offsets, flat = enc.encode_batch([text])
        assert list(offsets) == [0, len(flat)]
        return flat.tolist()

    return ids


@pytest.mark.parametrize("text", ["", "a", " ", "\n\n \t x", "<|endoftext|>", "don't we'll I'd", "naïve café", "ภาษาไทยค่ะ", "日本語のテキスト", "🎸🎸 🎸", "​﻿", "١٢٣ ½", "aaaaaaaaaaaa" * 30, "=" * 300, " " * 500, "x" * 20_000])
def test_written_cases(reference, mine, text):
    assert mine(text) == reference(text)


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(reference, mine, text):
    assert mine(text) == reference(text)


def test_random_words(reference, mine):
    rng = random.Random(5)
    for alphabet in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "0123456789.,", "äöüßéèñ", "กขคงจ่้ไ"):
        for _ in range(300):
            text = "".join(rng.choices(alphabet + " ", k=rng.randint(1, 60)))
            assert mine(text) == reference(text)


def test_forgetting_words_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(t, "MEMO_WORDS", 3)
    enc = t.TrieEncoder(t.vocabulary_path(), t.split_pattern())
    for text in ("one two three four five", "two three", "six seven one"):
        assert enc.encode_batch([text])[1].tolist() == reference(text)


def test_all_documents(spark, tables, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in q.p7_ids(spark, tables).collect()}
    assert got == {i: reference(x) for i, x in docs.items()}


def test_edge_rows(spark):
    rows = [(1, None, "x", [1]), (2, "", "x", None), (None, "hi", "x", None), (4, "hi", "x", None), (4, "hi", "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, ids array<int>")
    got = sorted(((r.doc_id, r.ids) for r in t.token_ids(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (None, [5303]), (4, [5303]), (4, [5303])], key=str)
    assert t.token_ids(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab1'é中 .!s\t\n\r\x0b\x1c\x1f\x85\xa0  　​", max_size=30), max_size=4))
def test_stretches_give_what_the_pattern_gives(texts):
    enc = t.encoder(t.vocabulary_path(), t.split_pattern())
    assert enc.stretch is not None
    plain = t.encoder(t.vocabulary_path(), "(?:" + t.split_pattern() + ")")  # another spelling, so without stretches
    assert plain.stretch is None
    for got, want in zip(enc.encode_batch(texts), plain.encode_batch(texts)):
        assert got.tolist() == want.tolist()


def test_long_words_are_not_kept():
    enc = t.TrieEncoder(t.vocabulary_path(), t.split_pattern())
    texts = ["x" * 300 + " short", "字" * 200, "x" * 300]
    first = [a.tolist() for a in enc.encode_batch(texts)]
    assert [a.tolist() for a in enc.encode_batch(texts)] == first
    assert max(map(len, enc.memo)) <= 64 and max(map(len, enc.stretches)) <= 64 and " short" in enc.stretches
