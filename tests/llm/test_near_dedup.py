from __future__ import annotations

import random
import re
from itertools import combinations

from flowlake.llm import near_dedup as N

from .corpus import documents, empty, frame, lowered, words


def shingle_set(text, k):
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1)))


def brute(rows, k):
    """Component of each row by all pairs: (id, set size, smallest id)."""
    sets = [shingle_set(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[root(i)] = root(j)
    low = lambda d: -(2**63) if d is None else d
    first = {}
    for i, r in enumerate(rows):
        first[root(i)] = min(first.get(root(i), 2**63), low(r[0]))
    out = []
    for i, r in enumerate(rows):
        c = first[root(i)]
        c = None if c == -(2**63) else c
        out.append((r[0], len(sets[i]), c, r[0] == c))
    return out


key = lambda r: tuple((x is not None, x or 0) for x in r)


def result(df, words, **kw):
    return sorted((tuple(r)[:4] for r in N.near_groups(df, words=words, **kw).collect()), key=key)


def test_against_all_pairs(spark):
    rows, k = documents(), 2
    assert result(frame(spark), k) == sorted(brute(rows, k), key=key)


def chains():
    """Chains of small edits, a frequent passage in many texts, and a large group of near copies."""
    rnd = random.Random(9)
    passage, rows = words(rnd, 40), []
    for i in range(40):
        own = words(rnd, rnd.randint(5, 60))
        rows.append(" ".join([*own, *passage]))
    text = words(rnd, 80)
    for _ in range(40):
        text[rnd.randrange(len(text))] = words(rnd, 1)[0]
        text[rnd.randrange(len(text))] = words(rnd, 1)[0]
        rows.append(" ".join(text))
    base = words(rnd, 60)
    for _ in range(120):
        copy = list(base)
        for _ in range(rnd.randint(0, 5)):
            copy[rnd.randrange(len(copy))] = words(rnd, 1)[0]
        rows.append(" ".join(copy))
    return [(i * 7 % len(rows), t, "en", "s", 1) for i, t in enumerate(rows)]


def test_chains_passages_and_near_copies(spark):
    rows = chains()
    assert result(frame(spark, rows), 2) == sorted(brute(rows, 2), key=key)


def test_star_rounds_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "PATIENCE", 0.01)
    rows = chains()
    assert result(frame(spark, rows), 2) == sorted(brute(rows, 2), key=key)


def near_copies():
    """A large group of near copies, many too far from the others to be linked, and texts that share a passage."""
    rnd = random.Random(3)
    base, passage, rows = words(rnd, 150), words(rnd, 60), []
    for _ in range(120):
        copy = list(base)
        for _ in range(rnd.randint(0, 16)):
            copy[rnd.randrange(len(copy))] = words(rnd, 1)[0]
        rows.append(" ".join(copy))
    rows += [" ".join([*words(rnd, 25), *passage]) for _ in range(40)]
    return [(i, t, "en", "s", 1) for i, t in enumerate(rows)]


def test_few_pairs_of_a_large_group_are_looked_up(spark, monkeypatch):
    rows, given, likely = near_copies(), [], N.likely
    monkeypatch.setattr(N, "likely", lambda pairs, *more: (given.append(pairs.count()), likely(pairs, *more))[1])
    assert result(frame(spark, rows), 2) == sorted(brute(rows, 2), key=key)
    sets = [shingle_set(r[1], 2) for r in rows]
    links = sum(100 * len(a & b) >= 80 * len(a | b) for a, b in combinations(sets, 2))
    assert 0 < given[-1] < links


def test_long_lists_in_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "LONG", 2)
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = chains()
    assert result(frame(spark, rows), 2) == sorted(brute(rows, 2), key=key)


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 150), (150, 170)]
    edges = N.staged(spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long"), "test-edges")
    got = {r["node"]: r["comp"] for r in N.components(edges).collect()}
    assert all(got[i] == got[0] for i in range(31)) and all(got[100 + i] == got[100] for i in range(20))
    assert got[200] == got[150] == got[170] and len({got[0], got[100], got[150]}) == 3


def test_keep_one_leaves_one_of_each_group(spark):
    rows = [r for r in documents() if r[0] is not None]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    kept = N.keep_one(frame(spark, rows), words=2)
    assert set(frame(spark, rows).columns) == set(kept.columns)
    got = kept.select("doc_id", "text").collect()
    gone = {r[0] for r in brute(rows, 2) if not r[3]}
    assert all(r["doc_id"] not in gone or r["text"] is not None for r in got)
    again = [(r["doc_id"], r["text"]) for r in got]
    sizes = {}
    for d, n, c, _ in brute([(d, t) for d, t in again], 2):
        if n:
            sizes[c] = sizes.get(c, 0) + 1
    assert set(sizes.values()) == {1}


def test_empty_table(spark):
    assert N.near_groups(empty(spark)).collect() == [] and N.keep_one(empty(spark)).collect() == []
