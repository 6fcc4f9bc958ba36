"""Model jobs on the embeddings: ML1 to ML11, U3."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.operators import metrics, ml, shapley
from flowlake.queries.book import Book, rnd, rounded
from flowlake.queries.events import scratch
from flowlake.sources.views import cte, table, view

BOOK = Book()
SIZE = 64  # the whole width of an embedding
NAMES = [f"f{i}" for i in range(SIZE)]
VEC = cte("vectors")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The features of every embedding, an attack label, and a fixed split."""
    df = table(spark, d, "embeddings").withColumn("y", (F.col("label") % 2).cast("int"))
    df, _ = ml.spread_array(df, "embedding", SIZE)
    return df.withColumn("is_test", F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0).drop("embedding")


def parts(spark, d) -> tuple[DataFrame, DataFrame]:
    df = vectors(spark, d)
    return df.filter("not is_test"), df.filter("is_test")


def ready(train: DataFrame):
    frozen = ml.freeze(ml.fit_statistics(train, NAMES))
    return lambda df: ml.assemble(ml.apply_statistics(df, NAMES, frozen), NAMES)


V3 = ["f1", "f2", "f3"]
HOLES = f"{VEC}, v as (select row_id, case when f2 = 0.05 then null else f1 end as f1, f2, f3, family from vectors), tr as (select * from v where family <> 'R')"
STAT = ", ".join(f"(select quantile_cont({f}, 0.5) from tr) as m_{f}" for f in V3)
FIT = f"{HOLES}, med as (select {STAT}), imp as (select row_id, family, {', '.join(f'coalesce({f}, m_{f}) as {f}' for f in V3)} from v, med), st as (select {', '.join(f'avg({f}) as a_{f}, stddev_pop({f}) as s_{f}' for f in V3)} from imp where family <> 'R')"


def holes(spark, d):
    return view(spark, d, "vectors").withColumn("f1", F.when(F.col("f2") != 0.05, F.col("f1")))


@BOOK.query("ml1_impute_scale", f"{FIT} select row_id, {', '.join(f'{rnd(f'({f} - a_{f}) / case when s_{f} > 0 then s_{f} else 1 end', 5)} as {f}' for f in V3)} from imp, st")
def _(spark, d):
    df = holes(spark, d)
    frozen = ml.freeze(ml.fit_statistics(df.filter("family <> 'R'"), V3))
    return rounded(ml.apply_statistics(df, V3, frozen).select("row_id", *V3), 5)


@BOOK.query("ml1_statistics", f"{FIT} " + " union all ".join(f"select '{f}' as feature, {rnd(f'm_{f}')} as median, {rnd(f'a_{f}')} as mean, {rnd(f's_{f}')} as std from med, st" for f in V3))
def _(spark, d):
    return rounded(ml.fit_statistics(holes(spark, d).filter("family <> 'R'"), V3))


@BOOK.query("ml5_majority_class", f"{VEC}, p as (select avg(y) as s from vectors where family <> 'A') select row_id, {rnd('s')} as score, case when s > 0.5 then 1 else 0 end as pred from vectors, p where family = 'A'")
def _(spark, d):
    df = view(spark, d, "vectors")
    return rounded(ml.majority_class(df.filter("family <> 'A'"), df.filter("family = 'A'")).select("row_id", "score", "pred"))


def tested(scored: DataFrame) -> DataFrame:
    pred = scored.withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return rounded(metrics.binary_metrics(pred).select("n", "accuracy", "f1"), 3)


@BOOK.query("ml2_random_forest")
def _(spark, d):
    train, test = parts(spark, d)
    prepare = ready(train)
    return tested(ml.attack_score(ml.random_forest(prepare(train)), prepare(test)))


@BOOK.query("ml2_importances")
def _(spark, d):
    train, _ = parts(spark, d)
    return rounded(ml.importances(ml.random_forest(ready(train)(train)), NAMES, spark), 3)


@BOOK.query("ml3_gradient_boosting")
def _(spark, d):
    train, test = parts(spark, d)
    prepare = ready(train)
    return tested(ml.attack_score(ml.gradient_boosting(prepare(train)), prepare(test)))


@BOOK.query("ml4_logistic")
def _(spark, d):
    train, test = parts(spark, d)
    prepare = ready(train)
    return tested(ml.attack_score(ml.logistic(prepare(train)), prepare(test)))


@BOOK.query("ml4_decision_tree")
def _(spark, d):
    train, test = parts(spark, d)
    prepare = ready(train)
    return tested(ml.attack_score(ml.decision_tree(prepare(train)), prepare(test)))


@BOOK.query("ml6_isolation_forest")
def _(spark, d):
    train, test = parts(spark, d)
    benign = train.filter("y = 0")
    size = min(256, benign.count())
    forest = ml.isolation_forest(benign, NAMES, "vec_id")
    return rounded(ml.isolation_scores(test, NAMES, forest, size).select("vec_id", "y", "score"), 4)


@BOOK.query("ml7_multiclass_family")
def _(spark, d):
    named = lambda df: df.withColumn("family", F.concat(F.lit("c"), (F.col("label") % 4).cast("string")))
    train, test = parts(spark, d)
    model, classes = ml.fit_families(named(train), NAMES, "family")
    got = ml.multiclass_family(model, ml.assemble(named(test), NAMES), classes)
    return got.groupBy("family", "predicted_family").agg(F.count("*").alias("n"))


def explained(spark, d, fit, name: str) -> tuple[DataFrame, DataFrame, object]:
    """Attributions and the rows explained, of a model fitted on three quarters of the rows by id."""
    df = vectors(spark, d)
    train, test = df.filter("vec_id % 4 <> 0"), df.filter("vec_id % 4 = 0")
    prepare = ready(train)
    model = fit(prepare(train))
    trees = shapley.fitted_trees(model, spark, scratch(spark, name))
    return shapley.attributions(prepare(test), "vec_id", NAMES, trees), prepare(test), model


ADDITIVE = "select count(*) as rows, 0.0 as largest_error from embeddings where vec_id % 4 = 0"


@BOOK.query("ml8_attributions", ADDITIVE)
def _(spark, d):
    """Base and values of a forest add up to its score on every row."""
    phi, test, model = explained(spark, d, ml.random_forest, "forest")
    total = phi.groupBy("row_id").agg((F.sum("phi") + F.max("base")).alias("explained"))
    scored = ml.attack_score(model, test).select(F.col("vec_id").alias("row_id"), "score")
    return rounded(total.join(scored, "row_id").agg(F.count("*").alias("rows"), F.max(F.abs(F.col("explained") - F.col("score"))).alias("largest_error")), 6)


@BOOK.query("ml8_attributions_boosted", ADDITIVE)
def _(spark, d):
    """The same of a boosted ensemble, whose answer is the margin."""
    phi, test, model = explained(spark, d, lambda t: ml.gradient_boosting(t, rounds=20), "boosted")
    total = phi.groupBy("row_id").agg((F.sum("phi") + F.max("base")).alias("explained"))
    raw = model.transform(test).select(F.col("vec_id").alias("row_id"), (vector_to_array("rawPrediction")[1]).alias("margin"))
    return rounded(total.join(raw, "row_id").agg(F.count("*").alias("rows"), F.max(F.abs(F.col("explained") - F.col("margin"))).alias("largest_error")), 6)


@BOOK.query("ml8_importance")
def _(spark, d):
    phi, _, _ = explained(spark, d, ml.random_forest, "forest")
    return rounded(shapley.importance(phi), 4)


@BOOK.query("ml8_top_features")
def _(spark, d):
    phi, _, _ = explained(spark, d, ml.random_forest, "forest")
    return rounded(shapley.top_features(phi), 4)


@BOOK.query("ml9_rung_sweep")
def _(spark, d):
    train, test = parts(spark, d)
    got = ml.rung_sweep(train, test, {"R4": NAMES[:4], f"R{SIZE}": NAMES})
    return rounded(got.select("rung", "model", "n", "accuracy", "f1"), 3)


@BOOK.query("ml10_transfer_eval")
def _(spark, d):
    df = vectors(spark, d)
    got = ml.transfer_eval(df.filter("label < 5"), df.filter("label >= 5"), NAMES)
    return rounded(got.select("model", "population", "n", "accuracy", "f1"), 3)


@BOOK.query("ml11_batch_score")
def _(spark, d):
    train, test = parts(spark, d)
    frozen = ml.freeze(ml.fit_statistics(train, NAMES))
    model = ml.logistic(ready(train)(train))
    return rounded(ml.batch_score(model, test, NAMES, frozen, ["vec_id"])[0], 4)


@BOOK.query("ml11_contract", "select 'f' || i as feature, count(*) filter (where vec_id % 5 = 0 and i = 3) as violations from embeddings, range(64) t(i) group by i")
def _(spark, d):
    """Every fifth row has a value that is not finite; the scoring counts them."""
    train, _ = parts(spark, d)
    frozen = ml.freeze(ml.fit_statistics(train, NAMES))
    model = ml.decision_tree(ready(train)(train))
    holed = vectors(spark, d).withColumn("f3", F.when(F.col("vec_id") % 5 == 0, float("nan")).otherwise(F.col("f3")))
    return rounded(ml.batch_score(model, holed, NAMES, frozen, ["vec_id"])[1])


@BOOK.query("u3_routed_union")
def _(spark, d):
    train, test = parts(spark, d)
    route = lambda df: df.withColumn("dataset", F.concat(F.lit("d"), (F.col("vec_id") % 3).cast("string")))
    fit = lambda n: ml.logistic(ml.assemble(route(train).filter(F.col("dataset") == n), NAMES))
    models = {n: fit(n) for n in ("d0", "d1")}
    return rounded(ml.routed_union(route(test), "dataset", models, NAMES, ["vec_id", "dataset"]), 4)
