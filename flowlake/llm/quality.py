"""Operator 9: a quality classifier, a generalised additive model with pairwise interactions.

Spark computes a few shape features of every text in Arrow batches (shares of character classes,
word and line statistics, entropy). On a bounded sample of labelled rows the driver learns one
lookup table per feature: boosting visits the features in turn, fits a shallow tree on the binned
feature to the loss, and adds its leaves to the table. Then the pairs of features that explain most
of what is left get two-dimensional tables in the same way. A score is the sum of the tables at a
text's bins, through the logistic function, so scoring is a few vectorised additions.

Labels, language, source and id never enter a score.

Defined cases: a null text counts as empty and is scored like any other; labels that are null or
other than 0 and 1 teach nothing; without labels of both kinds every score is the share of ones, kept
between 0.001 and 0.999 (0.5 without any label); repeated rows and ids are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, small_batches, staged, table, text_or_empty, texts_of

THRESHOLD = 0.3
MAX_TRAINING_ROWS = 100_000
FOLDS = 5
FEATURES = (
    "chars", "words", "word_length", "distinct_words", "longest_word", "lines", "line_length", "repeated_lines", "upper", "lower",
    "digits", "spaces", "commas", "periods", "exclamations", "pipes", "symbols", "other_marks", "non_ascii", "entropy",
)


# ---- features ------------------------------------------------------------------------------------

_BYTE = np.arange(256)
_CHAR = [chr(b) for b in range(128)]


def _mask(wanted) -> np.ndarray:
    return np.array([b < 128 and wanted(_CHAR[b]) for b in _BYTE], dtype=float)


MASKS = np.stack([
    _mask(str.isupper), _mask(str.islower), _mask(str.isdigit), _mask(str.isspace), _mask(lambda c: c == ","), _mask(lambda c: c == "."),
    _mask(lambda c: c == "!"), _mask(lambda c: c == "|"), _mask(lambda c: c in "#$%&*^~<>{}[]\\_=+@"), _mask(lambda c: c in "?;:'\"()-/`"),
    (_BYTE >= 128).astype(float),
])


def features(text: str) -> list[float]:
    data = text.encode()
    if not data:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total = len(data)
    shares = (MASKS @ counts / total).tolist()
    p = counts[counts > 0] / total
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = len(words) or 1
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n, np.log1p(max(map(len, words), default=0)),
        np.log1p(len(lines)), np.log1p(len(text) / (len(lines) or 1)), 1 - len(set(lines)) / (len(lines) or 1), *shares, float(-(p * np.log2(p)).sum()),
    ]


def with_features(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns and ``_features`` of every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(c) for c in keep], text_or_empty().alias("_text"))
    schema = rows.drop("_text").withColumn("_features", F.array(F.lit(0.0).cast("float"))).schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([features(t) for t in texts_of(batch, "_text")], pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], names=[*keep, "_features"])

    return rows.mapInArrow(lambda batches: map_batches(batches, work), schema)


# ---- model ---------------------------------------------------------------------------------------


@dataclass
class Additive:
    """Intercept, bin edges and table per feature, and tables of pairs on coarser edges."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        if self.pairs:
            bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
            for (a, b), values in self.pairs.items():
                total += values[bins[a], bins[b]]
        return 1 / (1 + np.exp(-total))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def tree(slope: np.ndarray, curve: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values per bin of a greedy tree on ordered bins: each cut is the one that gains most."""
    s, c = np.concatenate([[0.0], np.cumsum(slope)]), np.concatenate([[0.0], np.cumsum(curve)])
    worth = lambda a, b: (s[b] - s[a]) ** 2 / (c[b] - c[a] + ridge)
    bounds = [0, len(slope)]
    while len(bounds) <= leaves:
        best = max(
            ((worth(a, m) + worth(m, b) - worth(a, b), m) for a, b in zip(bounds, bounds[1:], strict=False) for m in range(a + 1, b)),
            default=(0.0, 0),
        )
        if best[0] <= 1e-12:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(slope))
    for a, b in zip(bounds, bounds[1:], strict=False):
        out[a:b] = (s[b] - s[a]) / (c[b] - c[a] + ridge)
    return out


def cross_tree(slope: np.ndarray, curve: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut into four quadrants of a table, its gain, and its leaf values."""
    s, c = slope.cumsum(0).cumsum(1), curve.cumsum(0).cumsum(1)
    quarters = lambda t: (t, t[:, -1:] - t, t[-1:, :] - t, t[-1, -1] - t[:, -1:] - t[-1:, :] + t)
    qs, qc = quarters(s), quarters(c)
    gain = sum(a**2 / (b + ridge) for a, b in zip(qs, qc, strict=True))[:-1, :-1]
    if not gain.size:
        return 0.0, np.zeros_like(slope)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    leaf = [float(a[i, j] / (b[i, j] + ridge)) for a, b in zip(qs, qc, strict=True)]
    out = np.empty_like(slope)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), out


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 48, leaves: int = 3, n_pairs: int = 6, pair_bins: int = 8,
    ridge: float = 1.0,
) -> Additive:
    """Cyclic boosting of shallow trees, first on single features and then on the chosen pairs."""
    if not len(y):
        return Additive(0.0)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Additive(float(np.log(share / (1 - share))))
    if y.min() == y.max():  # one kind of label only
        return model
    d = x.shape[1]
    model.edges = [cuts(x[:, j], bins) for j in range(d)]
    model.coarse = [cuts(x[:, j], pair_bins) for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j in range(d):
            p = 1 / (1 + np.exp(-total))
            n = len(model.tables[j])
            step = rate * tree(np.bincount(at[j], y - p, n), np.bincount(at[j], p * (1 - p), n), leaves, ridge)
            model.tables[j] += step
            total += step[at[j]]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]

    def residue(a: int, b: int) -> tuple[float, np.ndarray]:
        p, shape = 1 / (1 + np.exp(-total)), (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        cell, n = rough[a] * shape[1] + rough[b], shape[0] * shape[1]
        return cross_tree(np.bincount(cell, y - p, n).reshape(shape), np.bincount(cell, p * (1 - p), n).reshape(shape), ridge)

    gains = sorted(((residue(a, b)[0], a, b) for a in range(d) for b in range(a + 1, d)), reverse=True)
    model.pairs = {(a, b): np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for _, a, b in gains[:n_pairs]}
    for _ in range(rounds // 2):
        for (a, b), values in model.pairs.items():
            step = rate * residue(a, b)[1]
            values += step
            total += step[rough[a], rough[b]]
    return model


# ---- queries -------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(rows: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Additive:
    """Fit on rows (doc_id, _features) outside the held-out fold. Of more than ``max_rows`` labelled
    rows a hash of the id chooses about that many, so the driver's share is bounded."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    sample = rows.join(known, "doc_id").select("doc_id", "quality", "_features").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    x = np.array(sample.column("_features").combine_chunks().flatten()).reshape(len(sample), len(FEATURES)).astype(float)
    return fit(x, sample.column("quality").to_numpy().astype(float))


def score(rows: DataFrame, model: Additive, keep: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns of rows with ``_features``, with ``score`` and ``predicted``."""
    schema = rows.select(*keep).withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column("_features").flatten()).reshape(batch.num_rows, len(FEATURES)).astype(float)
        p = model.score(x)
        return pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in keep), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())
        ], names=[*keep, "score", "predicted"])

    return rows.mapInArrow(lambda batches: map_batches(batches, work), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and predicted of every document; the features are computed once and staged."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = staged(with_features(rows, ["doc_id"]), "features")
    return score(rows, train(rows, labels), ["doc_id"])


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected.

    Training takes the narrow features of all rows; the rows themselves are scored where they are
    read, so no text is shuffled.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(with_features(narrow, ["doc_id"]), labels)
    small_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in texts_of(batch)], dtype=np.float32).astype(float)
        return batch.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(lambda batches: map_batches(batches, work), docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
