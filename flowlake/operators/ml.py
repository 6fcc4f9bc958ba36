"""Model jobs: frozen preprocessing, MLlib learners, batch scoring and attributions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions.numeric import is_finite, is_missing
from flowlake.operators import forest
from flowlake.operators.clean import contract_check
from flowlake.operators.metrics import binary_metrics
from flowlake.operators.ordered import attach_row, exact_percentiles


# ---- preprocessing -------------------------------------------------------------------------------

def fit_statistics(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact median, then mean and population deviation after imputation, one row per feature."""
    clean = train.select([F.when(~is_missing(f), F.col(f).cast("double")).alias(f) for f in features])
    long = clean.unpivot([], list(features), "feature", "value")
    med = exact_percentiles(long, ["feature"], "value", {"median": 0.5})
    base = long.groupBy("feature").agg(
        F.count("*").alias("n"), F.count("value").alias("have"), F.sum("value").alias("s"),
        F.avg("value").alias("m"), F.var_pop("value").alias("v"),
    )
    # moments of the imputed column from the moments of the present values and the imputed count
    n, h = F.col("n").cast("double"), F.col("have").cast("double")
    mean = (F.col("s") + (n - h) * F.col("median")) / n
    var = (h * (F.col("v") + (F.col("m") - mean) * (F.col("m") - mean)) + (n - h) * (F.col("median") - mean) * (F.col("median") - mean)) / n
    std = F.sqrt(var)
    return base.join(F.broadcast(med), "feature").select(
        "feature", "median", mean.alias("mean"), F.when(std > 0, std).otherwise(1.0).alias("std")
    )


def freeze(stats: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Statistics as plain values (three numbers per feature)."""
    return {r["feature"]: (r["median"], r["mean"], r["std"]) for r in stats.collect()}


def apply_statistics(df: DataFrame, features: Sequence[str], frozen: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Impute and scale in the frozen feature order: a pure projection."""
    cols = {}
    for f in features:
        med, mean, std = frozen[f]
        value = F.when(is_missing(f), F.lit(med)).otherwise(F.col(f).cast("double"))
        cols[f] = (value - F.lit(mean)) / F.lit(std)
    return df.withColumns(cols)


def assemble(df: DataFrame, features: Sequence[str], out: str = "vec") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def spread_array(df: DataFrame, column: str, size: int, prefix: str = "f") -> tuple[DataFrame, list[str]]:
    """Array elements as columns."""
    names = [f"{prefix}{i}" for i in range(size)]
    return df.select("*", *[F.col(column)[i].cast("double").alias(n) for i, n in enumerate(names)]), names


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight n / (classes * n_c) per row; the class table is small."""
    per = df.groupBy(label).agg(F.count("*").alias("_c"))
    table = attach_row(per, per.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k")))
    w = table.select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return df.join(w, label)


# ---- learners ------------------------------------------------------------------------------------

def random_forest(train: DataFrame, label: str = "y", trees: int = 200, depth: int = 16, seed: int = 42) -> forest.Forest:
    """Balanced weights, two draws or more to a leaf, at most 32 bins; Spark's own learner holds all nodes in the driver."""
    return forest.fit(train, label, trees, depth, seed)


def gradient_boosting(train: DataFrame, label: str = "y", rounds: int = 100, depth: int = 6, seed: int = 42):
    return GBTClassifier(
        featuresCol="vec", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed,
    ).fit(train)


def logistic(train: DataFrame, label: str = "y"):
    data = balanced_weights(train, label)
    return LogisticRegression(featuresCol="vec", labelCol=label, weightCol="weight", maxIter=100, regParam=0.0).fit(data)


def decision_tree(train: DataFrame, label: str = "y", depth: int = 12, seed: int = 42):
    data = balanced_weights(train, label)
    return DecisionTreeClassifier(featuresCol="vec", labelCol=label, weightCol="weight", maxDepth=depth, seed=seed).fit(data)


def majority_class(train: DataFrame, rows: DataFrame, label: str = "y") -> DataFrame:
    """Prior of the attack class as score and the majority label as prediction."""
    prior = train.agg(F.avg((F.col(label) == 1).cast("double")).alias("score"))
    return attach_row(rows, prior.withColumn("pred", (F.col("score") > 0.5).cast("int")))


def importances(model, features: Sequence[str], spark) -> DataFrame:
    rows = list(zip(features, [float(v) for v in model.featureImportances.toArray()]))
    return spark.createDataFrame(rows, "feature string, importance double")


def attack_score(model, df: DataFrame, out: str = "score") -> DataFrame:
    """P(class = 1) from a fitted binary classifier."""
    if isinstance(model, forest.Forest):
        return model.score(df, out)
    got = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return got.drop("rawPrediction", "probability", "prediction")


def platt(validation: DataFrame, score: str = "score", y: str = "y"):
    """One-dimensional logistic fit of label on score; the ridge weight matches a unit penalty over the
    whole sample."""
    data = assemble(validation.select(F.col(score).cast("double").alias("_s"), F.col(y).cast("double").alias("_y")), ["_s"])
    n = max(data.count(), 1)
    model = LogisticRegression(featuresCol="vec", labelCol="_y", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=200).fit(data)
    return float(model.coefficients[0]), float(model.intercept)


def apply_platt(score: Column, slope: float, intercept: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(slope) * score + F.lit(intercept))))


def multiclass_family(model, df: DataFrame, classes: Sequence[str], floor: float = 0.40) -> DataFrame:
    """Family of highest probability, UNKNOWN below ``floor``."""
    p = vector_to_array("probability")
    best = F.array_max(p)
    names = F.array(*[F.lit(c) for c in classes])
    got = model.transform(df).withColumn("confidence", best)
    return got.withColumn(
        "predicted_family",
        F.when(F.col("confidence") < floor, "UNKNOWN").otherwise(F.element_at(names, F.array_position(p, best).cast("int"))),
    ).drop("rawPrediction", "probability", "prediction")


def fit_families(train: DataFrame, features: Sequence[str], family: str, trees: int = 50, depth: int = 10, seed: int = 42):
    """A forest over family names: the model and its class names (families of a label contract are few)."""
    classes = sorted(r[0] for r in train.select(family).distinct().collect())
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(family)).cast("double") - 1
    data = balanced_weights(assemble(train, features).withColumn("_label", index), "_label")
    model = RandomForestClassifier(
        featuresCol="vec", labelCol="_label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2,
    ).fit(data)
    return model, classes


def rung_sweep(
    train: DataFrame, test: DataFrame, rungs: dict[str, Sequence[str]], y: str = "y", trees: int = 100, depth: int = 16, rounds: int = 100, boosted_depth: int = 6
) -> DataFrame:
    """Test metrics of a forest and a boosted ensemble per feature rung, each with statistics frozen on train."""
    out = None
    for name, features in rungs.items():
        frozen = freeze(fit_statistics(train, features))
        ready = lambda df: assemble(apply_statistics(df, features, frozen), features)  # noqa: B023, E731
        learners = (("forest", random_forest(ready(train), y, trees, depth)), ("boosted", gradient_boosting(ready(train), y, rounds, boosted_depth)))
        for learner, fitted in learners:
            scored = attack_score(fitted, ready(test)).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
            row = binary_metrics(scored, y).withColumns({"rung": F.lit(name), "model": F.lit(learner)})
            out = row if out is None else out.unionByName(row)
    return out


def transfer_eval(source: DataFrame, target: DataFrame, features: Sequence[str], y: str = "y", trees: int = 100, depth: int = 16) -> DataFrame:
    """Fit each step of the baseline ladder (majority, logistic, tree, forest) on the source and score both
    populations with the source's frozen statistics."""
    frozen = freeze(fit_statistics(source, features))
    ready = lambda df: assemble(apply_statistics(df, features, frozen), features)
    fit, populations = ready(source), {"source": ready(source), "target": ready(target)}
    learners = {
        "logistic": lambda: logistic(fit, y), "tree": lambda: decision_tree(fit, y), "forest": lambda: random_forest(fit, y, trees, depth),
    }
    out = None
    for name, df in populations.items():
        guess = majority_class(fit, df, y).select(F.lit("majority").alias("model"), F.lit(name).alias("population"), y, "pred")
        out = guess if out is None else out.unionByName(guess)
    for learner, fitted in ((n, f()) for n, f in learners.items()):
        for name, df in populations.items():
            scored = attack_score(fitted, df).select(F.lit(learner).alias("model"), F.lit(name).alias("population"), y, (F.col("score") >= 0.5).cast("int").alias("pred"))
            out = out.unionByName(scored)
    return binary_metrics(out, y, keys=["model", "population"])


def routed_union(df: DataFrame, route: str, models: dict[str, object], features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Each row scored by the model of its dataset, in one result. Rows of an unknown dataset have no score."""
    known = list(models)
    out = df.filter(~F.coalesce(F.col(route).isin(known), F.lit(False))).select(*keep, F.lit(None).cast("double").alias("score"))
    for name, model in models.items():
        part = assemble(df.filter(F.col(route) == name), features)
        out = out.unionByName(attack_score(model, part).select(*keep, "score"))
    return out


# ---- isolation forest ----------------------------------------------------------------------------

TREE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth_value double"


def _c(n: float) -> float:
    """Average path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def tree_draws(train: DataFrame, features: Sequence[str], row_id: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, rank, features): for each tree the rows of least hash seeded by it. A task keeps its ``sample`` least
    rows per tree, so at most ``trees * sample`` rows leave a task; the ``sample`` least of all are the draw."""
    feats, size = list(features), sample
    kinds = ", ".join(f"`{f}` double" for f in feats)

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            seeds = pdf["_h"].to_numpy(np.uint64)
            parts = [] if held is None else [held]
            for tree in range(trees):
                mixed = (seeds ^ np.uint64((seed * 1_000_003 + tree) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                rank = (mixed ^ (mixed >> np.uint64(29))) >> np.uint64(1)
                at = np.argsort(rank, kind="stable")[:size]
                parts.append(pdf.iloc[at][feats].assign(tree=tree, rank=rank[at].astype(np.int64)))
            held = pd.concat(parts).sort_values(["tree", "rank"], kind="stable").groupby("tree").head(size)
        if held is not None:
            yield held[["tree", "rank", *feats]]

    base = train.select(F.abs(F.xxhash64(F.col(row_id).cast("string"))).alias("_h"), *[F.col(f).cast("double").alias(f) for f in feats])
    return base.mapInPandas(least, f"tree int, rank long, {kinds}")


def isolation_forest(train: DataFrame, features: Sequence[str], row_id: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Trees as node rows. Each tree grows on its own draw of min(``sample``, n) rows, independent of the
    other trees' draws."""
    feats, size = list(features), sample
    drawn = tree_draws(train, feats, row_id, trees, sample, seed)

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        pdf = pdf.sort_values("rank", kind="stable").head(size)
        x = pdf[feats].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        rows: list[list] = []
        stack = [(np.arange(len(x)), 0, -1, 0)]
        while stack:
            idx, depth, parent, side = stack.pop()
            node = len(rows)
            rows.append([tree, node, -1, 0.0, -1, -1, depth + _c(len(idx))])
            if parent >= 0:
                rows[parent][4 + side] = node
            part = x[idx]
            lo, hi = part.min(axis=0), part.max(axis=0)
            free = np.flatnonzero(hi > lo)
            if depth >= limit or len(idx) <= 1 or len(free) == 0:
                continue
            f = int(rng.choice(free))
            cut = float(rng.uniform(lo[f], hi[f]))
            rows[node][2], rows[node][3] = f, cut
            go = part[:, f] <= cut
            stack.append((idx[~go], depth + 1, node, 1))
            stack.append((idx[go], depth + 1, node, 0))
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "depth_value"])

    return drawn.groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


def isolation_scores(df: DataFrame, features: Sequence[str], forest: DataFrame, sample: int, out: str = "score") -> DataFrame:
    """Anomaly score 1 / (1 + exp(10 d)) with d = 0.5 - 2^(-mean path / c(sample)). ``sample`` is the size
    of a tree's draw: the number of training rows where that is below the limit.

    The forest (trees times at most 2 * sample nodes) is shipped to the tasks; rows stay where they are."""
    nodes = forest.toPandas().sort_values(["tree", "node"])
    grown = [
        (g["feature"].to_numpy(), g["threshold"].to_numpy(), g["left"].to_numpy(), g["right"].to_numpy(), g["depth_value"].to_numpy())
        for _, g in nodes.groupby("tree")
    ]
    shared = df.sparkSession.sparkContext.broadcast(grown)
    scale = _c(sample)

    @F.pandas_udf("double")
    def path(x: pd.Series) -> pd.Series:
        m = np.asarray(x.tolist(), dtype=float).reshape(len(x), -1)
        total = np.zeros(len(m))
        for feature, cut, left, right, value in shared.value:
            at = np.zeros(len(m), dtype=int)
            inner = feature[at] >= 0
            while inner.any():
                i = np.flatnonzero(inner)
                go = m[i, feature[at[i]]] <= cut[at[i]]
                at[i] = np.where(go, left[at[i]], right[at[i]])
                inner = feature[at] >= 0
            total += value[at]
        return pd.Series(total / max(len(shared.value), 1))

    mean = path(F.array(*[F.col(f).cast("double") for f in features]))
    d = 0.5 - F.pow(F.lit(2.0), -F.col("_path") / scale)
    return df.withColumn("_path", mean).withColumn(out, 1.0 / (1.0 + F.exp(10.0 * d))).drop("_path")


# ---- batch scoring -------------------------------------------------------------------------------

def batch_score(
    model, df: DataFrame, features: Sequence[str], frozen: dict[str, tuple[float, float, float]], keep: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Scores of a whole table in narrow steps, and the violations of the feature contract, counted per feature: rows
    with a value that is not finite get no score and are listed there, not lost."""
    broken = F.greatest(*[(~is_finite(f)).cast("int") for f in features], F.lit(0)).cast("boolean")
    scaled = assemble(apply_statistics(df.filter(~broken), features, frozen), features)
    scored = attack_score(model, scaled).select(*keep, "score")
    refused = df.filter(broken).select(*keep, F.lit(None).cast("double").alias("score"))
    return scored.unionByName(refused), contract_check(df, features)[1]
