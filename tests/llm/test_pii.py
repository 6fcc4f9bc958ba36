from __future__ import annotations

import hashlib
import random
import re

import pytest

from flowlake.llm import pii

from .corpus import documents, empty, frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m.group())]
    return sorted(found, key=lambda s: (s[0], pii.ORDER[s[2]]))


def private_texts():
    rnd = random.Random(4)
    parts = ["a@b.c", "1.2.3.4", "+1 (017) 555-7713", "4539578763621486", "4111 1111-1111 1111", "a.b@c.d_e@f.gg", "256.1.1.1.1", "word", "12", "version 2.0"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    return texts + ["".join(rnd.choice("a1 .@-+(5") for _ in range(rnd.randint(1, 60))) for _ in range(2000)]


def test_base_spans_against_the_patterns():
    for text in private_texts():
        assert pii.base_spans(text) == brute(text)


def test_long_runs_are_read_in_linear_time():
    assert pii.base_spans("a" * 300_000 + " x" + "1" * 100_000) == []


def secrets(n=60):
    rnd = random.Random(3)
    hexa = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k - 2)) + "a1"
    texts = [f"some words password={hexa(18)} and more" for _ in range(n)] + [f'see token = "{hexa(40)}" there' for _ in range(n)]
    texts += ["key AKIA" + "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(15)) + "7 word" for _ in range(n)]
    return texts + [f"chapter {i} of version {i}.0, 17 pages and b{i}" for i in range(n)]


@pytest.fixture(scope="module")
def keys(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(secrets())]
    return rows, pii.train(pii.count_patterns(frame(spark, rows)))


def test_secrets_are_learned_and_plain_numbers_left(keys):
    rows, model = keys
    for i, text, *_ in rows:
        added = [s for s in pii.all_spans(text, model)[1] if s[2] == pii.ADDED]
        assert len(added) == (i < 180), text


def test_estimate_reads_counts_only(spark, keys):
    _, model = keys
    assert all(0 <= p <= 1 for p in model.values()) and pii.train({}) == {}


def test_find_against_brute_force(spark, keys):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(private_texts())] + documents()
    got = {(r["doc_id"], r["base_sha256"]) for r in pii.find(frame(spark, rows), keys[1]).collect()}
    for doc_id, text, *_ in rows:
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in brute(text or ""))
        assert (doc_id, hashlib.sha256(said.encode()).hexdigest()) in got


def test_redact_keeps_columns_and_clean_texts(spark, keys):
    rows = [(1, "mail a@b.c now", "en", "s", 1), (2, "clean", "en", "s", 1), (3, None, "en", "s", 0)]
    df = frame(spark, rows)
    got = pii.redact(df, keys[1])
    assert got.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "mail <email> now", 2: "clean", 3: None}


def test_empty_table(spark):
    assert pii.find(empty(spark)).collect() == []
