from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from flowlake.llm import pieces

from .corpus import documents, empty, frame


@given(st.text(alphabet=st.sampled_from(list(" \n\tab'sé1.▁　\x00<>ﬁ①")), max_size=60) | st.text(max_size=40))
@settings(max_examples=400, deadline=None)
def test_chunks_give_the_ids_of_the_whole_text(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    table = pieces.chunk_table(pieces.default_model())
    assert table.by_chunk
    assert table.encode([text]) == [[*table.model.encode(text), table.end_id]]


def test_digests_against_the_library(spark):
    model = pieces.chunk_table(pieces.default_model()).model
    want = []
    for doc_id, text, *_ in documents():
        ids = model.encode(text or "", add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids))))
    got = [tuple(r) for r in pieces.digests(frame(spark)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_ids_decode_to_the_text(spark):
    rows = [(1, "some text,  here", "en", "s", 1), (2, None, "en", "s", 0)]
    got = {r["doc_id"]: r for r in pieces.encode_decode(frame(spark, rows)).collect()}
    assert got[1]["decoded"] == "some text,  here" and got[2]["ids"] == [2]


def test_empty_table(spark):
    assert pieces.digests(empty(spark)).collect() == []
