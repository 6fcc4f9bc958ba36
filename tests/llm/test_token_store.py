from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlake.llm import token_store as T

from .corpus import documents, empty, frame


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.default_tokenizer())
    t.encode_special_tokens = True
    return t


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70_000), max_size=3000))
@settings(max_examples=40, deadline=None)
def test_codes_give_every_id_at_random(ids):
    codes = T.Codes(T.pack_ids(np.array(ids, dtype=np.uint32)))
    assert codes.all().tolist() == ids
    assert [codes[i] for i in range(len(ids))] == ids


def test_codes_refuse_other_data_and_positions():
    with pytest.raises(ValueError):
        T.Codes(b"none of that")
    with pytest.raises(IndexError):
        T.Codes(T.pack_ids(np.zeros(0, np.uint32)))[0]


@given(st.text(alphabet=st.sampled_from(list(" \n\tab'sé1.▁　\x1c<|>")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_give_the_codes_of_the_whole_text(text):
    encoder = T.word_encoder(T.default_tokenizer())
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole


def test_store_against_plain_encoding(spark, tmp_path, tokenizer):
    path = str(tmp_path / "store")
    T.write_store(frame(spark), path, segment_tokens=500)
    got = [tuple(r) for r in T.document_digests(spark, path).collect()]
    rows = documents()
    assert len(got) == len(rows)
    want = {}
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, T.END_ID]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found = {}
    for doc_id, _, n, crc in got:
        found.setdefault(doc_id, []).append((n, crc))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    by_start = sorted(got, key=lambda r: r[1])
    at = 0
    for _, start, n, _ in by_start:
        assert start == at
        at += n
    ids = [r[0] for r in by_start]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_tokens_at_any_position(spark, tmp_path, tokenizer):
    path = str(tmp_path / "store")
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(["hello world", None, "", "some longer text here"])]
    T.write_store(frame(spark, rows), path, segment_tokens=3)
    stream = [i for _, t, *_ in rows for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, T.END_ID]]
    asked = spark.createDataFrame([(p,) for p in [*range(len(stream)), len(stream), 10**9]], "position long")
    assert {r[0]: r[1] for r in T.tokens_at(spark, path, asked).collect()} == dict(enumerate(stream))


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "store")
    T.write_store(empty(spark), path)
    assert T.document_digests(spark, path).collect() == []


END = "<|endoftext|>"


@given(st.lists(st.sampled_from([END, END[:-1], END[1:], " ", "  ", "\n", "one", "two", "é"]), max_size=12).map("".join))
@settings(max_examples=200, deadline=None)
def test_added_tokens_as_an_untouched_tokenizer_has_them(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(T.default_tokenizer())
    texts = ["one two", text, f"one {END} two"]
    got = [np.frombuffer(x, "<u4").tolist() for x in T.word_encoder(T.default_tokenizer()).encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[2] == [505, 220, 50256, 734]


def test_store_of_texts_with_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(T.default_tokenizer())
    path = str(tmp_path / "store")
    texts = ["one two", f"one {END} two", END, f"a{END}{END} b c"]
    T.write_store(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), path)
    at, want = 0, []
    for i, t in enumerate(texts):
        ids = [*plain.encode(t, add_special_tokens=False).ids, T.END_ID]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in T.document_digests(spark, path).collect()) == want
