"""Detector quality on scored tables. Everything is one or two combinable aggregates; exact curve
metrics work on per-distinct-score counts and a running sum that is spread over value ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.numeric import is_finite, ratio, ratio_or_zero
from flowlake.operators.ordered import attach_row, exact_percentiles, running_totals

COUNTS = ("tn", "fp", "fn", "tp")


def threshold_predict(df: DataFrame, score: str, thresholds: dict[str, float]) -> DataFrame:
    """One 0/1 column per named threshold (inclusive)."""
    return df.withColumns({n: (F.col(score) >= t).cast("int") for n, t in thresholds.items()})


def outcome(y: Column, pred: Column) -> Column:
    return (
        F.when(y.isNull() | pred.isNull(), "UNVERIFIED").when(y == pred, "CORRECT")
        .when(pred == 1, "FALSE_POSITIVE").otherwise("FALSE_NEGATIVE")
    )


def cell(y: Column, pred: Column) -> Column:
    return (
        F.when((y == 1) & (pred == 1), "TP").when((y == 0) & (pred == 0), "TN")
        .when((y == 0) & (pred == 1), "FP").when((y == 1) & (pred == 0), "FN")
    )


def confusion_aggs(y: str, pred: str) -> list[Column]:
    c = cell(F.col(y), F.col(pred))
    return [F.count_if(c == n.upper()).alias(n) for n in COUNTS]


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*confusion_aggs(y, pred)) if keys else df.agg(*confusion_aggs(y, pred))


def rates(counts: DataFrame) -> DataFrame:
    """All threshold metrics from tn, fp, fn, tp. Precision, recall and F1 are 0 where undefined;
    specificity, FPR and FNR are NULL."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in COUNTS)
    n = tn + fp + fn + tp
    p1, r1 = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    p0, r0 = ratio_or_zero(tn, tn + fn), ratio_or_zero(tn, tn + fp)
    f1, f0 = ratio_or_zero(2 * tp, 2 * tp + fp + fn), ratio_or_zero(2 * tn, 2 * tn + fp + fn)
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    # a class counts for the macro mean if it occurs in truth or prediction; an absent one has F1 0
    named = (tp + fn + fp > 0).cast("int") + (tn + fp + fn > 0).cast("int")
    return counts.withColumns({
        "n": n.cast("long"), "accuracy": ratio(tp + tn, n),
        "precision": p1, "recall": r1, "f1": f1,
        "benign_precision": p0, "benign_recall": r0, "benign_f1": f0,
        "macro_f1": ratio(f1 + f0, named),
        "weighted_f1": ratio(f1 * (tp + fn) + f0 * (tn + fp), n),
        "balanced_accuracy": ratio(r1 + r0, present),
        "specificity": ratio(tn, tn + fp), "fpr": ratio(fp, tn + fp), "fnr": ratio(fn, tp + fn),
    })


def binary_metrics(df: DataFrame, y: str = "y", pred: str = "pred", keys: Sequence[str] = ()) -> DataFrame:
    return rates(confusion(df, y, pred, keys))


def score_counts(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )


def curve_points(df: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: counts, running counts and totals."""
    return running_totals(score_counts(df, y, score, keys), keys, "_score", ["pos", "neg"])


def auc_from_points(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties count one half) and average precision; NULL when a class is absent."""
    neg_below = F.col("cum_neg") - F.col("neg")
    pos_at = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    neg_at = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    wins = F.sum(F.col("pos") * (neg_below + F.col("neg") / 2.0))
    area = F.sum(F.col("pos") * pos_at.cast("double") / (pos_at + neg_at))
    agg = [
        wins.alias("_w"), area.alias("_a"), F.max("tot_pos").alias("n_pos"), F.max("tot_neg").alias("n_neg"),
    ]
    got = points.groupBy(*keys).agg(*agg) if keys else points.agg(*agg)
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return got.select(
        *keys, "n_pos", "n_neg",
        F.when(both, F.try_divide(F.col("_w"), F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("_a"), F.col("n_pos").cast("double"))).alias("pr_auc"),
    )


def auc(df: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    return auc_from_points(curve_points(df, y, score, keys), keys)


def recall_at_fpr(
    df: DataFrame, target: float, y: str = "y", score: str = "score", keys: Sequence[str] = ()
) -> DataFrame:
    """Largest recall over the score cuts whose false-positive rate is at most ``target``."""
    pts = curve_points(df, y, score, keys)
    pos_at = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    neg_at = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    tpr = F.try_divide(pos_at.cast("double"), F.col("tot_pos"))
    ok = F.try_divide(neg_at.cast("double"), F.col("tot_neg")) <= target
    agg = F.coalesce(F.max(F.when(ok, tpr)), F.lit(0.0)).alias("recall_at_fpr")
    return pts.groupBy(*keys).agg(agg) if keys else pts.agg(agg)


def evaluate(df: DataFrame, y: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Threshold metrics and curve metrics in one row, with the refusal reason where the input is not
    a proper score table (labels outside {0,1}, non-finite scores, scores that are only 0 and 1)."""
    pred = (F.col(score) >= threshold).cast("int")
    checked = df.select(F.col(y).alias("y"), F.col(score).cast("double").alias("s"), pred.alias("p"))
    summary = checked.agg(
        *confusion_aggs("y", "p"),
        F.count_if(~F.coalesce(F.col("y").isin(0, 1), F.lit(False))).alias("bad_labels"),
        F.count_if(~is_finite("s")).alias("bad_scores"),
        F.count_if((F.col("s") != 0) & (F.col("s") != 1)).alias("graded"),
    )
    reason = (
        F.when(F.col("bad_labels") > 0, "labels are not binary")
        .when(F.col("bad_scores") > 0, "scores are not finite")
        .when(F.col("graded") == 0, "scores are hard predictions")
        .when((F.col("tp") + F.col("fn") == 0) | (F.col("tn") + F.col("fp") == 0), "only one class")
    )
    curve = auc(checked.filter(is_finite("s")), "y", "s")
    return (
        attach_row(rates(summary.withColumn("refused", reason)), curve.select("roc_auc", "pr_auc"))
        .withColumns({
            "roc_auc": F.when(F.col("refused").isNull(), F.col("roc_auc")),
            "pr_auc": F.when(F.col("refused").isNull(), F.col("pr_auc")),
        })
        .drop("bad_labels", "bad_scores", "graded")
    )


def threshold_sweep(
    df: DataFrame, y: str = "y", score: str = "score", steps: int = 100, keys: Sequence[str] = ()
) -> DataFrame:
    """Counts and rates at ``steps + 1`` even thresholds from one pass: each score is put into the
    highest grid step it reaches, then the at most ``steps + 1`` buckets are summed from the top."""
    spark = df.sparkSession
    s = F.col(score).cast("double")
    guess = F.floor(s * steps).cast("int")
    grid_at = lambda b: b.cast("double") / steps
    # the grid value itself decides, not the rounding of the product
    bucket = (
        F.when(s >= grid_at(guess + 1), guess + 1).when(s < grid_at(guess), guess - 1).otherwise(guess)
    )
    bucket = F.least(F.greatest(bucket, F.lit(-1)), F.lit(steps))
    per = df.groupBy(*keys, bucket.alias("b")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    if keys:
        grid = per.select(*keys).distinct().withColumn("b", F.explode(F.sequence(F.lit(-1), F.lit(steps))))
    else:
        grid = spark.range(-1, steps + 1).select(F.col("id").cast("int").alias("b"))
    full = grid.join(per, [*keys, "b"], "left").fillna(0, ["pos", "neg"])
    top = Window.partitionBy(*keys).orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    swept = full.select(
        *keys, "b",
        F.sum("pos").over(top).alias("tp"), F.sum("neg").over(top).alias("fp"),
        F.sum("pos").over(whole).alias("_p"), F.sum("neg").over(whole).alias("_n"),
    ).filter(F.col("b") >= 0)
    counts = swept.select(
        *keys, (F.col("b").cast("double") / steps).alias("threshold"),
        (F.col("_n") - F.col("fp")).alias("tn"), "fp", (F.col("_p") - F.col("tp")).alias("fn"), "tp",
    )
    return rates(counts)


def operating_points(
    sweep: DataFrame, min_recall: float = 0.95, max_fpr: float = 0.01, fp_cost: float = 1.0, fn_cost: float = 10.0
) -> DataFrame:
    """Named thresholds from a sweep; the lowest threshold wins ties."""
    c = F.col
    cost = c("fp") * fp_cost + c("fn") * fn_cost
    pick = lambda ok, value: F.min_by("threshold", F.when(ok, F.struct(value, c("threshold"))))
    points = sweep.agg(
        pick(F.lit(True), -c("f1")).alias("max_f1"),
        pick(c("recall") >= min_recall, c("fpr")).alias("min_fpr_at_recall"),
        pick(c("fpr") <= max_fpr, c("fnr")).alias("min_fnr_at_fpr"),
        pick(F.lit(True), cost).alias("min_cost"),
    )
    names = ("max_f1", "min_fpr_at_recall", "min_fnr_at_fpr", "min_cost")
    long = points.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("objective"), c(n).alias("threshold")) for n in names
    ])).alias("o")).select("o.*")
    return long.join(
        sweep.select("threshold", "precision", "recall", "f1", "fpr", "fnr", cost.alias("cost")),
        "threshold", "left",
    ).select("objective", "threshold", "precision", "recall", "f1", "fpr", "fnr", "cost")


def multiclass_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))


def multiclass_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per class: support, precision, recall, F1 (0 where undefined). The table has one row per class."""
    m = multiclass_matrix(df, y, pred)
    diag = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = m.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"), F.sum(diag).alias("tp"))
    cols = m.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = rows.join(cols, "cls", "full").fillna(0, ["support", "tp", "predicted"])
    tp, sup, prd = F.col("tp").cast("double"), F.col("support"), F.col("predicted")
    return j.select(
        "cls", "support", "predicted", "tp", ratio_or_zero(tp, prd).alias("precision"),
        ratio_or_zero(tp, sup).alias("recall"), ratio_or_zero(2 * tp, sup + prd).alias("f1"),
    )


def multiclass_summary(per_class: DataFrame, benign: str) -> DataFrame:
    """Accuracy, macro and weighted averages, and the mean recall of rare attack classes (support at
    most the median support of all classes)."""
    med = per_class.filter("support > 0").agg(F.percentile("support", F.lit(0.5)).alias("_m"))
    rare = (F.col("cls") != benign) & (F.col("support") > 0) & (F.col("support") <= F.col("_m"))
    n = F.sum("support").cast("double")
    return attach_row(per_class, med).agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        F.coalesce(F.avg(F.when(rare, F.col("recall"))), F.lit(0.0)).alias("rare_recall"),
    )


def clean_family(family: Column) -> Column:
    """En dash, em dash and the replacement character become a hyphen."""
    return F.translate(family, "\u2013\u2014\ufffd", "---")


def family_metrics(df: DataFrame, family: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per family: support, correct, fp, fn, detection and error rate. A family with any attack row is
    an attack family, which has no false alarms; a benign one has no misses."""
    g = df.withColumn(family, clean_family(F.col(family))).groupBy(family).agg(
        F.count("*").alias("support"), F.max(y).alias("is_attack"), *confusion_aggs(y, pred),
    )
    attack = F.col("is_attack") == 1
    zero = F.lit(0).cast("long")
    correct = F.when(attack, F.col("tp")).otherwise(F.col("tn"))
    wrong = F.when(attack, F.col("fn")).otherwise(F.col("fp"))
    return g.select(
        family, "is_attack", "support", correct.alias("correct"),
        F.when(attack, zero).otherwise(F.col("fp")).alias("fp"), F.when(attack, F.col("fn")).otherwise(zero).alias("fn"),
        ratio(correct, F.col("support")).alias("detection_rate"), ratio(wrong, F.col("support")).alias("error_rate"),
    ).orderBy("is_attack", F.desc("support"), family)


def confidence_distribution(df: DataFrame, y: str = "y", pred: str = "pred", score: str = "score") -> DataFrame:
    """Score distribution in each cell of the confusion matrix."""
    tagged = df.select(cell(F.col(y), F.col(pred)).alias("outcome"), F.col(score).alias("s"))
    base = tagged.groupBy("outcome").agg(
        F.count("*").alias("n"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"),
        F.min("s").alias("min"), F.max("s").alias("max"),
    )
    q = exact_percentiles(tagged, ["outcome"], "s", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return base.join(q, "outcome")


def disagreement(df: DataFrame, y: str, a: str, b: str, fused: str, threshold: float = 0.5) -> DataFrame:
    """Where two detectors differ and what the fused score makes of it, in one pass."""
    p = lambda s: (F.col(s) >= threshold).cast("int")
    pa, pb, pf, t = p(a), p(b), p(fused), F.col(y)
    ra, rb, rf = pa == t, pb == t, pf == t
    differ = pa != pb
    return df.agg(
        F.count("*").alias("n"), F.count_if(differ).alias("disagreements"),
        F.count_if((pa == 1) & (pb == 0) & (t == 1)).alias("a_only_right"),
        F.count_if((pa == 1) & (pb == 0) & (t == 0)).alias("a_only_false_alarm"),
        F.count_if((pa == 0) & (pb == 1) & (t == 1)).alias("b_only_right"),
        F.count_if((pa == 0) & (pb == 1) & (t == 0)).alias("b_only_false_alarm"),
        F.count_if((ra != rb) & rf).alias("fusion_rescues"),
        F.count_if(~ra & ~rb & rf).alias("fusion_rescues_both_wrong"),
        F.count_if(ra & rb & ~rf).alias("fusion_degradations"),
        F.avg(F.when(differ, rf.cast("double"))).alias("fusion_accuracy_on_disagreements"),
    )


def agreement_cube(df: DataFrame, y: str, a: str, b: str, threshold: float = 0.5) -> DataFrame:
    """Row counts by correctness of both detectors and truth, with all subtotals."""
    right = lambda s: ((F.col(s) >= threshold).cast("int") == F.col(y)).cast("int")
    return (
        df.select(right(a).alias("a_right"), right(b).alias("b_right"), F.col(y).cast("int").alias("truth"))
        .cube("a_right", "b_right", "truth")
        .agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))
    )


def reliability(df: DataFrame, y: str = "y", score: str = "score", bins: int = 10) -> DataFrame:
    """Calibration bins with their edges: left-closed, the last one closed, empty bins kept. A score is
    compared with the edges themselves; the gap keeps its sign."""
    s = F.col(score).cast("double")
    inner = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    b = F.size(F.filter(inner, lambda e: s >= e))
    per = df.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_predicted"),
        F.avg(F.col(y).cast("double")).alias("observed"),
    )
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(per), "bin", "left").select(
        "bin", (F.col("bin") / F.lit(float(bins))).alias("lower"), ((F.col("bin") + 1) / F.lit(float(bins))).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"), "mean_predicted", "observed",
        (F.col("mean_predicted") - F.col("observed")).alias("gap"),
    )


def brier_ece(df: DataFrame, y: str = "y", score: str = "score", bins: int = 10) -> DataFrame:
    err = F.col(score) - F.col(y)
    brier = df.agg(F.avg(err * err).alias("brier"))
    curve = reliability(df, y, score, bins)
    ece = curve.agg((F.sum(F.col("n") * F.coalesce(F.abs("gap"), F.lit(0.0))) / F.sum("n")).alias("ece"))
    return attach_row(brier, ece)


def run_summary(runs: DataFrame, metrics: Sequence[str], model: str = "model", seed: str = "seed") -> DataFrame:
    """Mean, population deviation, range and values per model and metric over repeated runs. A row of
    ``runs`` is one finished training run, so the list per group is the number of seeds."""
    long = runs.unpivot([model, seed], list(metrics), "metric", "value")
    return long.groupBy(model, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count("value").alias("n"),
        F.sort_array(F.collect_list("value")).alias("values"),
    )


def latency_summary(df: DataFrame, component: str, value: str) -> DataFrame:
    base = df.groupBy(component).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max")
    )
    q = exact_percentiles(df, [component], value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return base.join(q, component)


def score_bands(df: DataFrame, score: str = "score") -> DataFrame:
    """Both bandings of the score plus its summary, one row."""
    s = F.col(score)
    base = df.agg(
        F.count_if(s < 0.40).alias("low"), F.count_if((s >= 0.40) & (s < 0.65)).alias("medium"),
        F.count_if(s >= 0.65).alias("high"),
        F.count_if(s < 0.50).alias("informational_b"), F.count_if((s >= 0.50) & (s < 0.65)).alias("low_b"),
        F.count_if((s >= 0.65) & (s < 0.85)).alias("medium_b"), F.count_if(s >= 0.85).alias("high_b"),
        F.avg(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"),
    )
    return attach_row(base, exact_percentiles(df, [], score, {"median": 0.5}))


def worst(df: DataFrame, n: int, y: str = "y", pred: str = "pred", score: str = "score", row_id: str = "row_id") -> DataFrame:
    """The n lowest-scored missed attacks and the n highest-scored false alarms."""
    fn = df.filter((F.col(y) == 1) & (F.col(pred) == 0)).orderBy(score, row_id).limit(n)
    fp = df.filter((F.col(y) == 0) & (F.col(pred) == 1)).orderBy(F.desc(score), row_id).limit(n)
    return fn.withColumn("kind", F.lit("FN")).unionByName(fp.withColumn("kind", F.lit("FP")))


def disagreement_examples(df: DataFrame, n: int, a: str, b: str, row_id: str = "row_id", threshold: float = 0.5) -> DataFrame:
    return df.filter((F.col(a) >= threshold) != (F.col(b) >= threshold)).orderBy(row_id).limit(n)


def align_inner(a: DataFrame, b: DataFrame, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Rows scored by both detectors, and how many each side lost."""
    joined = a.join(b, row_id)
    drops = (
        a.select(row_id, F.lit(1).alias("_a")).join(b.select(row_id, F.lit(1).alias("_b")), row_id, "full")
        .agg(
            F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("aligned"),
            F.count_if(F.col("_b").isNull()).alias("dropped_a"),
            F.count_if(F.col("_a").isNull()).alias("dropped_b"),
        )
    )
    return joined, drops


def align_strict(a: DataFrame, b: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Ids present on one side only; must be empty."""
    only_a = a.select(row_id).join(b.select(row_id), row_id, "left_anti").withColumn("side", F.lit("a"))
    only_b = b.select(row_id).join(a.select(row_id), row_id, "left_anti").withColumn("side", F.lit("b"))
    return only_a.unionByName(only_b)


def widen_scores(scores: DataFrame, models: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Long (row_id, model, score) to one column per model. The model list is given, so no extra pass."""
    return scores.groupBy(row_id).pivot("model", list(models)).agg(F.first("score"))


def fuse(a: Column, b: Column, alpha: float) -> Column:
    """alpha * a + (1 - alpha) * b; a alone where b is missing."""
    return F.coalesce(F.lit(alpha) * a + F.lit(1.0 - alpha) * b, a)


def tune_alpha(df: DataFrame, y: str, a: str, b: str, steps: int = 10) -> DataFrame:
    """ROC-AUC at each mixing weight; the best one, ties to the weight closest to one half.

    The grid multiplies distinct (label, score, score) counts, not rows, and those are combined again
    per weight before the shuffle."""
    grid = F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)]))
    mixed = (
        df.groupBy(y, a, b).agg(F.count("*").alias("w"))
        .withColumn("alpha", grid)
        .withColumn("_s", F.col("alpha") * F.col(a) + (F.lit(1.0) - F.col("alpha")) * F.col(b))
    )
    per = mixed.groupBy("alpha", F.col("_s").alias("_score")).agg(
        F.sum(F.when(F.col(y) == 1, F.col("w")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(y) == 0, F.col("w")).otherwise(0)).alias("neg"),
    )
    got = auc_from_points(running_totals(per, ["alpha"], "_score", ["pos", "neg"]), ["alpha"])
    near = F.abs(F.col("alpha") - 0.5)
    # of equal weights the one closest to one half, then the first of the grid
    order = F.struct(F.round("roc_auc", 9), F.round(-near, 9), -F.col("alpha"))
    best = F.max_by("alpha", order).over(Window.partitionBy())  # one row per weight; a second read would count all again
    return got.withColumn("best_alpha", best).withColumn("is_best", F.col("alpha") == F.col("best_alpha"))


def compare_components(df: DataFrame, y: str, scores: dict[str, Column], threshold: float = 0.5) -> DataFrame:
    """Threshold and curve metrics of several scores on the same rows."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), s.cast("double").alias("score")) for n, s in scores.items()
    ]))
    long = df.select(F.col(y).alias("y"), rows.alias("_m")).select("y", "_m.*")
    long = long.withColumn("pred", (F.col("score") >= threshold).cast("int"))
    return binary_metrics(long, keys=["model"]).join(auc(long, keys=["model"]).drop("n_pos", "n_neg"), "model")


def degradation(source: DataFrame, target: DataFrame, metrics: Sequence[str], model: str = "model") -> DataFrame:
    """Source minus target per model and metric (one row per model)."""
    s = source.select(model, *[F.col(m).alias(f"source_{m}") for m in metrics])
    t = target.select(model, *[F.col(m).alias(f"target_{m}") for m in metrics])
    return s.join(t, model).withColumns(
        {f"delta_{m}": F.col(f"target_{m}") - F.col(f"source_{m}") for m in metrics}
    )


def family_auc(df: DataFrame, family: str, benign: str, score: str = "score") -> DataFrame:
    """AUC of each attack family against the benign rows. Benign counts are summed along the scores once and looked
    up by the families' scores, never copied per family."""
    per = df.groupBy(family, F.col(score).cast("double").alias("_score")).agg(F.count("*").alias("n"))
    pos = per.filter(F.col(family) != benign).select(F.col(family).alias("family"), "_score", F.col("n").alias("pos"))
    neg = per.filter(F.col(family).isNotNull()).groupBy("_score").agg(
        F.coalesce(F.sum(F.when(F.col(family) == benign, F.col("n"))), F.lit(0)).alias("neg")
    )
    below = running_totals(neg, [], "_score", ["neg"]).withColumnRenamed("_score", "_at")
    above = running_totals(pos, ["family"], "_score", ["pos"])
    return auc_from_points(above.join(below, F.col("_score").eqNullSafe(F.col("_at"))), ["family"])


def rank_average(df: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Tie-averaged rank of each distinct score."""
    per = df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"))
    run = running_totals(per, keys, "score", ["n"])
    return run.select(*keys, "score", "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def duplicate_breakdown(df: DataFrame, features: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Metrics on rows whose feature vector is duplicated and on unique rows. Counts per vector are
    enough: a vector with more than one row is duplicated."""
    per = df.groupBy(*features).agg(F.count("*").alias("_n"), *confusion_aggs(y, pred))
    flagged = per.groupBy((F.col("_n") > 1).alias("is_duplicate")).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return rates(flagged)
