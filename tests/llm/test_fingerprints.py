from __future__ import annotations

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from flowlake.llm import fingerprints as P

from .corpus import documents, empty, frame, words

TEXT = st.text(alphabet="ab é", max_size=300)


@given(TEXT, TEXT, st.integers(0, 300), st.integers(0, 300))
@settings(max_examples=200, deadline=None)
def test_spans_and_extensions(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    x, y = P.PrefixHashes(a), P.PrefixHashes(b)
    n = x.common_extension(i, y, j)
    assert a[i : i + n] == b[j : j + n]
    assert i + n == len(a) or j + n == len(b) or a[i + n] != b[j + n]
    k = x.common_suffix(y)
    assert a[len(a) - k :] == b[len(b) - k :]
    assert k == min(len(a), len(b)) or a[-k - 1] != b[-k - 1]
    assert (x.span(0, x.n) == y.span(0, y.n)) == (a == b)


@given(TEXT, TEXT)
@settings(max_examples=200, deadline=None)
def test_likeness_against_the_texts(a, b):
    fa, fb = P.fingerprint(a), P.fingerprint(b)
    got = P.likeness(fa, fb)
    assert 0 <= got <= 1 and got == P.likeness(fb, fa)
    assert (fa == fb) == (a == b)
    if a != b and a and b:
        step = max(P.grid_step(len(a)), P.grid_step(len(b)))
        head = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
        tail = next((i for i, (p, q) in enumerate(zip(a[::-1], b[::-1], strict=False)) if p != q), min(len(a), len(b)))
        want = min((head // step + tail // step) * step, len(a), len(b)) / max(len(a), len(b))
        assert abs(got - want) < 1e-9


def brute(rows):
    out = []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for i, (doc_id, text, *_) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + nxt[:half]
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), P.fingerprint(text), P.fingerprint(changed)))
    return out


def test_neighbours_against_plain_order(spark):
    rows = [r for i, r in enumerate(documents()) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())  # one row per id, so that the order is the ids'
    got = [tuple(r)[:5] for r in P.neighbours(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_ties_nulls_and_small_tables(spark):
    assert len(P.neighbours(frame(spark)).collect()) == len(documents())
    assert P.neighbours(empty(spark)).collect() == []
    one = P.neighbours(frame(spark, [(7, "abcd", "en", "s", 4)])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    two = P.neighbours(frame(spark, [(None, None, "en", "s", 4), (None, "", "en", "s", 4)])).collect()
    assert [r["near_edited"] for r in two] == [1.0, 1.0]


def many(seed, n):
    return words(random.Random(seed), n)


def near(a, b):
    return P.resemblance(P.PrefixHashes(a), P.PrefixHashes(b))


def test_resemblance_around_several_edits():
    base = many(3, 400)
    text = " ".join(base)
    for at in ([100, 300], [1, 398], [0, 399], list(range(10, 400, 20))):
        changed = list(base)
        for i in at:
            changed[i] = "Z" * len(base[i])
        copy = " ".join(changed)
        lost = sum(len(base[i]) for i in at)
        assert abs(near(text, copy) - (len(text) - lost) / len(text)) < 0.01, at
        assert near(text, copy) == near(copy, text)
    moved = " ".join(base[200:] + base[:200])
    assert near(text, moved) > 0.99
    assert near(text, " ".join(many(4, 400))) < 0.05


@given(TEXT, TEXT)
@settings(max_examples=200, deadline=None)
def test_resemblance_is_bounded_and_no_less_than_the_ends_show(a, b):
    got = near(a, b)
    assert 0 <= got <= 1 and got == near(b, a) and (got == 1.0) == (a == b)
    assert got >= P.likeness(P.fingerprint(a), P.fingerprint(b)) - 1e-9


def test_query_sees_text_between_edits(spark):
    base = many(5, 300)
    one, two = " ".join(base), " ".join(["Z" * len(w) if i in (3, 296) else w for i, w in enumerate(base)])
    got = P.neighbours(frame(spark, [(1, one, "en", "s", 0), (2, two, "en", "s", 0)])).collect()
    assert all(r["near_next"] > 0.95 for r in got)
