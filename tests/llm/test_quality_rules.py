from __future__ import annotations

import re
from collections import Counter
from math import ceil

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlake.llm import quality_rules

from .corpus import documents, empty, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, straight from the contract."""
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + d for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), len(lines)


def floor_bucket(value: int) -> int:
    step = 1 << max(value.bit_length() - 8, 0)
    return value // step * step


def shares(c: tuple[int, ...]) -> dict[str, int]:
    part = lambda a, scale, b: a * scale // b if b else 0
    return {"word_length": part(c[1], 1000, c[0]), "symbol_share": part(c[2], 10_000, c[1]), "dup_line_share": part(c[3], 10_000, c[5]), "repeat_share": part(c[4], 10_000, c[0])}


def quartile(values: list[int], part: int) -> int:
    values = sorted(map(floor_bucket, values))
    return values[ceil(part * len(values) / 4) - 1]


def brute_force(rows: list[tuple]) -> list[tuple]:
    all_of = [(r, counts(r[1])) for r in rows]
    seen = [(r[2], r[3], shares(c)) for r, c in all_of if c[0]]
    found = []
    for r, c in all_of:
        base, failed = c[0] < 50 or 100 * c[4] > 50 * c[0], []
        for m, (least, both) in quality_rules.LEAST_SPREAD.items() if c[0] else ():
            ends = []
            for part in (1, 3):
                at = quartile([x[m] for *_, x in seen], part)
                for group in ([x[m] for lang, _, x in seen if lang == r[2]], [x[m] for lang, source, x in seen if (lang, source) == (r[2], r[3])]):
                    at = (len(group) * quartile(group, part) + quality_rules.PRIOR * at) // (len(group) + quality_rules.PRIOR)
                ends.append(at)
            reach = quality_rules.REACH * max(ends[1] - ends[0], least)
            value = shares(c)[m]
            if value > ends[1] + reach or both and value < ends[0] - reach:
                failed.append(m)
        reasons = ",".join(["base"] * base + failed)
        found.append((r[0], *c[:5], base, reasons == "", reasons))
    return sorted(found, key=repr)


def corpus() -> list[tuple]:
    rows = documents(n=30)
    prose = [r for r in rows if r[1] and len(r[1].split()) > 20]
    junk = [(9000 + i, "## $$ <<>> ** " * 30 + f"tail {i}", r[2], r[3], 1) for i, r in enumerate(prose[:3])]
    long_words = [(9100, " ".join("w" * 60 + str(i) for i in range(80)), "en", "src1", 1), (9101, "same line here\n" * 40, "en", None, 1)]
    other = [(9200 + i, r[1], None, "src1", 2) for i, r in enumerate(prose[:8])]
    return [*rows, *junk, *long_words, *other]


def test_counts_fences_and_verdicts_equal_brute_force(spark):
    rows = corpus()
    got = quality_rules.judge(frame(spark, rows)).drop("lang", "source").select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "reasons")
    want = brute_force(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {"symbol_share", "word_length", "base", ""} <= {w[-1] for w in want} | {x for w in want for x in w[-1].split(",")}


@given(st.lists(st.text("ab \n\t#", max_size=60), max_size=6))
@settings(max_examples=8, deadline=None)
def test_counts_of_any_text(spark, texts):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = quality_rules.measure(frame(spark, rows, clashing=False)).select(*quality_rules.COUNTS, "n_lines", "doc_id").collect()
    assert sorted(tuple(r)[-1:] + tuple(r)[:-1] for r in got) == [(i, *counts(t)) for i, t in enumerate(texts)]


def test_windows_with_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 62)  # one bit of hash is left: nearly all windows collide
    text = " ".join(f"w{i}" for i in range(300)) + " w5 w6 w7"
    got = quality_rules.measure(frame(spark, [(1, text, "en", "s", 1)])).first()
    assert got["n_repeat_words"] == counts(text)[4] == 6


def test_sketches_of_parts_add_up(spark):
    rows = [r for r in corpus() if r[1]]
    of = lambda part: quality_rules.sketch(quality_rules.with_measures(quality_rules.measure(frame(spark, part, clashing=False))))
    whole, parts = of(rows), quality_rules.merge(of(rows[:20]), of(rows[20:]))
    columns = whole.columns
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.select(columns).collect()))
    first = quality_rules.judge(frame(spark, rows[20:], clashing=False), seen=of(rows[:20]))
    at_once = quality_rules.judge(frame(spark, rows, clashing=False))
    later = {repr(r) for r in at_once.collect()}
    assert all(repr(r) in later for r in first.collect())


@pytest.mark.parametrize("value", [0, 1, 255, 256, 257, 511, 512, 9_999, 10_000, 123_456_789])
def test_bucket_is_within_one_part_in_128(spark, value):
    from pyspark.sql import functions as F

    got = spark.range(1).select(quality_rules.bucket(F.lit(value).cast("long"))).first()[0]
    assert got == floor_bucket(value) and got <= value <= got + got // 128


def test_clean_texts_of_every_group_stay(spark):
    rows = [(i, " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(60 + i % 50)), ("en", "de", None)[i % 3], "hot" if i % 3 else f"s{i}", 1) for i in range(300)]
    junk = [(1000 + i, " ".join(f"|##{(i + k) % 89}" for k in range(60)), "en", "hot", 1) for i in range(30)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(frame(spark, rows + junk)).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(30))


def test_sql_states_the_same_rules(spark):
    rows = corpus()
    got = quality_rules.judge(frame(spark, rows)).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "reasons").collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert sorted(map(repr, con.execute(quality_rules.OP11_SQL).fetchall())) == sorted(repr(tuple(r)) for r in got)


def test_empty_table(spark):
    assert quality_rules.judge(empty(spark)).collect() == []
