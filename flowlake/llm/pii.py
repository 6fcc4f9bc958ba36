"""Operator 8: personal data by aggregated weak labels.

Four base kinds (e-mail, IP address, card, phone) have exact patterns and are always found. Beyond
them, tokens with digits are candidates for credentials (kind ``key``). Labelers vote on each
candidate: patterns of keys and of plain numbers, a gazetteer of cue words, the context before it,
and the mix of characters; each says yes, no, or nothing. Spark counts the vote patterns of the
whole corpus (a few hundred at most), expectation-maximisation on these counts estimates how often
each labeler is right, and a logistic classifier is trained on the posteriors. A second pass scores
the spans of every text with it.

Defined cases: a null text counts as empty and has no spans; whole texts are read, however long;
repeated rows and ids are separate rows; an empty table gives an empty result and trains nothing;
further columns of the input are ignored, except by ``redact``, which keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, small_batches, table, text_or_empty, texts_of

KINDS = ("email", "ip", "card", "phone")
ADDED = "key"
ORDER = {k: i for i, k in enumerate((*KINDS, ADDED))}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[int, int, str]


# ---- base kinds ----------------------------------------------------------------------------------


def emails(text: str) -> Iterator[Span]:
    """From each @ backwards over its local part, so that a long run of letters is read once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        done = match.end() if match else at + 1
        if match:
            yield start, done, "email"
        at = text.find("@", done)


def ips(text: str) -> Iterator[Span]:
    for run in DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in IP.finditer(text, *run.span()):
                parts = [p.lstrip("0") for p in m.group().split(".")]
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                    yield *m.span(), "ip"


def luhn(digits: str) -> bool:
    back = digits[::-1]
    return (sum(map(int, back[::2])) + sum(DOUBLED[int(d)] for d in back[1::2])) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield *m.span(), "card"


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m.group())) <= 15:
            yield *m.span(), "phone"


def base_spans(text: str) -> list[Span]:
    found = list(emails(text)) if "@" in text else []
    if DIGITS.search(text):
        found += [*ips(text), *cards(text), *phones(text)]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


# ---- candidates and labelers ---------------------------------------------------------------------

# What tokens are made of, and cue words.
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")
CUES = re.compile(r"(?i)\b(?:password|passwd|pwd|passphrase|token|secret|credential|bearer|auth|api[ _-]?key|access[ _-]?key|private[ _-]?key)\b")
PLAIN_CUES = re.compile(r"(?i)\b(?:version|license|licence|page|chapter|section|copyright|edition|number|year)\b")
KEY_SHAPES = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{20,}|[0-9a-f]{16,}|[0-9A-F]{16,}")
PLAIN_SHAPES = re.compile(r"[0-9]{1,8}|[0-9]+[-/][0-9/-]+|[A-Za-z]{1,12}[-_]?[0-9]{1,3}|[0-9]{1,3}[a-z]{1,3}")
ASSIGNED = re.compile(r"[=:]\s?[\"']?$")
REACH = 24
LABELERS = ("key_shape", "plain_shape", "cue_words", "plain_words", "assigned", "mixed")
YES, NO, NOTHING = 1, 0, -1


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Maximal tokens with a digit that touch no base span."""
    done, k = 0, 0
    base = sorted(base)
    for m in DIGITS.finditer(text):
        if m.start() < done:
            continue
        start, stop = m.span()
        while start > done and text[start - 1] in TOKEN:
            start -= 1
        while stop < len(text) and text[stop] in TOKEN:
            stop += 1
        done = stop
        while k < len(base) and base[k][1] <= start:
            k += 1
        if all(b[0] >= stop or b[1] <= start for b in base[k : k + len(KINDS)]):
            yield start, stop


def votes(text: str, start: int, stop: int) -> tuple[int, ...]:
    token, before = text[start:stop], text[max(0, start - REACH) : start]
    digit = [c.isdigit() for c in token]
    changes = sum(a != b for a, b in zip(digit, digit[1:], strict=False))
    return (
        YES if KEY_SHAPES.fullmatch(token) and not token.isdigit() else NOTHING,
        NO if PLAIN_SHAPES.fullmatch(token) else NOTHING,
        YES if CUES.search(before) else NOTHING,
        NO if PLAIN_CUES.search(before) else NOTHING,
        YES if ASSIGNED.search(before) else NOTHING,
        YES if len(token) >= 12 and changes >= 4 else NO if changes <= 1 else NOTHING,
    )


# ---- aggregation of votes and the classifier -----------------------------------------------------


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 100, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for two classes: patterns, their weights, and each pattern's posterior of yes.

    A labeler has a probability of yes, no and nothing in each class; it starts from the majority of
    votes, with ``prior`` added rows per answer, so an unseen answer is never impossible.
    """
    keys = np.array(sorted(patterns), dtype=int)
    weight = np.array([patterns[tuple(k)] for k in keys.tolist()], dtype=float)
    answers = np.stack([keys == a for a in (NO, YES, NOTHING)], axis=2).astype(float)
    balance = (keys == YES).sum(1) - (keys == NO).sum(1)
    posterior = np.clip(0.5 + 0.4 * np.sign(balance), 0.05, 0.95)
    for _ in range(rounds):
        shares, logs = [], []
        for mass in ((1 - posterior) * weight, posterior * weight):
            seen = np.einsum("p,pla->la", mass, answers) + prior
            logs.append(np.einsum("pla,la->p", answers, np.log(seen / seen.sum(1, keepdims=True))))
            shares.append(np.log(mass.sum() + prior))
        new = 1 / (1 + np.exp(np.clip(shares[0] + logs[0] - shares[1] - logs[1], -50, 50)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return keys, weight, posterior


def train(patterns: dict[tuple[int, ...], int], steps: int = 50, ridge: float = 1e-2) -> dict[tuple[int, ...], float]:
    """A logistic classifier on one-hot votes, fitted to the posteriors by Newton steps; scored per pattern."""
    if not patterns:
        return {}
    keys, weight, target = estimate(patterns)
    x = np.concatenate([np.ones((len(keys), 1)), keys == YES, keys == NO], axis=1).astype(float)
    w, beta = weight / weight.sum(), np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (target - p)) - ridge * w.min() * beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + (ridge * w.min() + 1e-9) * np.eye(len(beta))
        move = np.linalg.solve(curve, slope)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return {tuple(k): float(v) for k, v in zip(keys.tolist(), p, strict=True)}


def count_patterns(docs: DataFrame) -> dict[tuple[int, ...], int]:
    """How often each vote pattern occurs in the corpus. One row per pattern reaches the driver."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch):
                found.update(votes(text, *c) for c in candidates(text, base_spans(text)))
        names = pa.array([",".join(map(str, k)) for k in found], pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])

    sums = docs.select(text_or_empty().alias("text")).mapInArrow(work, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n"))
    return {tuple(map(int, k.split(","))): n for k, n in (tuple(r) for r in sums.collect())}


def all_spans(text: str, model: dict[tuple[int, ...], float], least: float = 0.5) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans); a pattern that the model never saw adds nothing."""
    base = base_spans(text)
    added = [(*c, ADDED) for c in candidates(text, base) if model.get(votes(text, *c), 0.0) >= least]
    return base, sorted([*base, *added], key=lambda s: (s[0], ORDER[s[2]]))


def find(docs: DataFrame, model: dict[tuple[int, ...], float] | None = None) -> DataFrame:
    """doc_id, counts per base kind, base_sha256 and spans of every document."""
    model = train(count_patterns(docs)) if model is None else model
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    said = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [all_spans(t, model) for t in texts_of(batch)]
        counts = [[sum(s[2] == k for s in base) for base, _ in both] for k in KINDS]
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
            pa.array([hashlib.sha256(said(base).encode()).hexdigest() for base, _ in both], pa.string()),
            pa.array([said(spans) for _, spans in both], pa.string()), pa.array([len(s) - len(b) for b, s in both], pa.int64()),
        ], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(lambda batches: map_batches(batches, work), schema)


def masked(text: str, spans: list[Span]) -> str:
    """Each span gives way to its kind in angle brackets; of overlapping spans the first is named."""
    out, done = [], 0
    for start, stop, kind in spans:
        if start >= done:
            out += (text[done:start], f"<{kind}>")
        done = max(done, stop)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: dict[tuple[int, ...], float] | None = None) -> DataFrame:
    """``docs`` with all its columns, and every span in ``text`` masked. A null text stays null."""
    model = train(count_patterns(docs)) if model is None else model
    small_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = [None if t is None else masked(t, all_spans(t, model)[1]) for t in batch.column("text").to_pylist()]
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(clean, pa.string()))

    return docs.mapInArrow(lambda batches: map_batches(batches, work), docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
