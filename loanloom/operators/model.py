"""Distributed tree models, cross-validation, voting and metrics on MLlib."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.expr import safe_div
from loanloom.operators.clean import finite_matrix
from loanloom.operators.split import stratified_folds


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Zero-filled features as one vector column, next to the kept columns."""
    filled = finite_matrix(df.select(*keep, *features), features)
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)
    return vectors.select(*keep, "features")


def base_models(label: str, seed: int = 0) -> dict[str, Estimator]:
    """M5: gradient-boosted trees and a random forest with library defaults."""
    return {
        "boosted": GBTClassifier(labelCol=label, seed=seed),
        "forest": RandomForestClassifier(labelCol=label, seed=seed),
    }


def param_grids(
    boosted: GBTClassifier, forest: RandomForestClassifier, linear: LogisticRegression, n_rows: int
) -> dict[str, list[dict[Param, object]]]:
    """M6: search grids.

    MLlib has no unlimited depth (30 is its most), sets the smallest leaf rather
    than the smallest split, and regularises by strength instead of its inverse,
    scaled by the number of rows. It never penalises the intercept, so there is
    no scaling of it to search.
    """
    # The parameter ranges searched.
    forest_depth = [5, 8, 15, 30]
    forest_features = ["5", "7", "auto"]
    forest_split = [8, 15, 20]
    forest_trees = [200, 500, 1000]
    deep_rate = [0.1, 0.01]
    deep_depth = [5, 8, 12, 20]
    deep_rounds = [100, 200]
    deep_columns = ["0.5", "0.8", "1.0"]
    light_rate = [0.01, 0.1]
    light_rounds = [300, 500, 1500]
    light_columns = ["0.5", "0.7", "1.0"]
    linear_tol = [0.0001, 0.0002, 0.0003]
    linear_rounds = [100, 200, 300]
    linear_c = [0.001, 0.01, 0.1, 1, 10, 100]
    return {
        "forest": ParamGridBuilder()
        .addGrid(forest.maxDepth, forest_depth)
        .addGrid(forest.featureSubsetStrategy, forest_features)
        .addGrid(forest.minInstancesPerNode, [s // 2 for s in forest_split])
        .addGrid(forest.numTrees, forest_trees)
        .build(),
        "boosted_deep": ParamGridBuilder()
        .addGrid(boosted.stepSize, deep_rate)
        .addGrid(boosted.maxDepth, deep_depth)
        .addGrid(boosted.maxIter, deep_rounds)
        .addGrid(boosted.featureSubsetStrategy, deep_columns)
        .build(),
        "boosted_light": ParamGridBuilder()
        .addGrid(boosted.stepSize, light_rate)
        .addGrid(boosted.maxIter, light_rounds)
        .addGrid(boosted.featureSubsetStrategy, light_columns)
        .build(),
        "linear": ParamGridBuilder()
        .addGrid(linear.tol, linear_tol)
        .addGrid(linear.maxIter, linear_rounds)
        .addGrid(linear.regParam, [1.0 / (c * n_rows) for c in linear_c])
        .build(),
    }


def balanced_weights(df: DataFrame, label: str, column: str = "weight") -> DataFrame:
    """Class weights n / (classes * class size) for an unbalanced binary label."""
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    total = sizes["pos"] + sizes["neg"]
    weight = F.when(F.col(label) == 1, safe_div(F.lit(total), F.lit(2 * sizes["pos"]))).otherwise(
        safe_div(F.lit(total), F.lit(2 * sizes["neg"]))
    )
    return df.withColumn(column, weight)


# --- metrics ----------------------------------------------------------------------------------


def binary_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 in one aggregate."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return counts.select(
        "tp", "fp", "fn", "tn",
        safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.coalesce(safe_div(tp, tp + fp), zero).alias("precision"),
        F.coalesce(safe_div(tp, tp + fn), zero).alias("recall"),
        F.coalesce(safe_div(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    sides = F.array(
        F.struct(F.col(label).cast("int").alias("class"), F.lit(1).alias("truth")),
        F.struct(F.col(prediction).cast("int").alias("class"), F.lit(0).alias("truth")),
    )
    hit = (F.col(label) == F.col(prediction)).alias("_hit")
    counts = df.select(hit, F.inline(sides)).groupBy("class").agg(
        F.count_if((F.col("truth") == 1) & F.col("_hit")).alias("_tp"),
        F.sum("truth").alias("support"),
        F.count_if(F.col("truth") == 0).alias("_predicted"),
    )
    zero = F.lit(0.0)
    return counts.select(
        "class",
        F.coalesce(safe_div("_tp", "_predicted"), zero).alias("precision"),
        F.coalesce(safe_div("_tp", "support"), zero).alias("recall"),
        F.coalesce(safe_div(2 * F.col("_tp"), F.col("_predicted") + F.col("support")), zero).alias("f1"),
        "support",
    )


def roc_auc(df: DataFrame, label: str, score: str) -> float:
    """Exact area under the ROC curve, ties counted half."""
    return BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=0
    ).evaluate(df.select(F.col(label).cast("double"), F.col(score).cast("double")))


def _positive(df: DataFrame, column: str = "probability") -> DataFrame:
    return df.withColumn("score", vector_to_array(F.col(column))[1])


# --- fitting ----------------------------------------------------------------------------------


def cross_validate(
    estimator: Estimator, df: DataFrame, label: str, key: str, folds: int = 3, seed: int = 0
) -> DataFrame:
    """M7: ROC-AUC, accuracy and F1 of every fold."""
    data = stratified_folds(df, label, key, folds, seed).persist()
    rows = []
    try:
        for i in range(folds):
            model = estimator.fit(data.where(F.col("fold") != i))
            rows.append((i, *_scores(model, data.where(F.col("fold") == i), label)))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, roc_auc double, accuracy double, f1 double")


def _scores(model: Model, df: DataFrame, label: str) -> tuple[float, float, float]:
    scored = _positive(model.transform(df)).select(label, "prediction", "score").persist()
    try:
        m = binary_metrics(scored, label, "prediction").first()
        return roc_auc(scored, label, "score"), m["accuracy"], m["f1"]
    finally:
        scored.unpersist()


def cross_validate_vote(
    estimators: Mapping[str, Estimator], df: DataFrame, label: str, key: str, folds: int = 3, seed: int = 0
) -> DataFrame:
    """M7: ROC-AUC, accuracy and F1 of the soft vote of several models in every fold."""
    data = stratified_folds(df, label, key, folds, seed).persist()
    rows = []
    try:
        for i in range(folds):
            train, held = data.where(F.col("fold") != i), data.where(F.col("fold") == i)
            scored = soft_vote({n: e.fit(train) for n, e in estimators.items()}, held).persist()
            m = binary_metrics(scored, label, "prediction").first()
            rows.append((i, roc_auc(scored, label, "score"), m["accuracy"], m["f1"]))
            scored.unpersist()
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, roc_auc double, accuracy double, f1 double")


def grid_search(
    estimator: Estimator,
    grid: Sequence[Mapping[Param, object]],
    df: DataFrame,
    label: str,
    key: str,
    folds: int = 3,
    seed: int = 0,
    parallelism: int = 4,
) -> tuple[Model, DataFrame]:
    """M8: best model by mean accuracy over the folds, and the score of every setting."""
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=[dict(g) for g in grid],
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    data = stratified_folds(df, label, key, folds, seed).persist()
    try:
        fitted = search.fit(data)
    finally:
        data.unpersist()
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(g.items(), key=lambda x: x[0].name)), float(a))
        for i, (g, a) in enumerate(zip(grid, fitted.avgMetrics, strict=True))
    ]
    scores = df.sparkSession.createDataFrame(rows, "setting int, params string, accuracy double")
    return fitted.bestModel, scores


def soft_vote(models: Mapping[str, Model], df: DataFrame) -> DataFrame:
    """M9: mean class-1 probability of all models, and class 1 above one half.

    Every model appends its own column to the same frame, so nothing is joined.
    """
    kept = df.columns
    for name, model in models.items():
        own = model.copy()
        own.setPredictionCol(f"_y_{name}").setProbabilityCol(f"_p_{name}").setRawPredictionCol(f"_r_{name}")
        df = own.transform(df)
    votes = {name: vector_to_array(F.col(f"_p_{name}"))[1].alias(f"score_{name}") for name in models}
    return vote(df.select(*kept, *votes.values()), [f"score_{n}" for n in models])


def vote(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """M9: the mean of given class-1 scores, and class 1 above one half."""
    mean = sum((F.col(s) for s in scores), F.lit(0.0)) / F.lit(float(len(scores)))
    return df.withColumn("score", mean).withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def feature_importance(
    model: Model, features: Sequence[str], spark_df: DataFrame, num: int | None = None
) -> DataFrame:
    """``(feature, value)``, the most important first."""
    values = model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values, strict=True)]
    table = spark_df.sparkSession.createDataFrame(rows, "feature string, value double")
    ordered = table.orderBy(F.col("value").desc(), "feature")
    return ordered if num is None else ordered.limit(num)


def validation_curve(
    estimator: Estimator,
    param: str,
    values: Sequence[object],
    df: DataFrame,
    label: str,
    key: str,
    folds: int = 10,
    seed: int = 0,
) -> DataFrame:
    """Mean ROC-AUC on the training and the held-out folds per parameter value."""
    data = stratified_folds(df, label, key, folds, seed).persist()
    rows = []
    try:
        for value in values:
            fitted = estimator.copy({estimator.getParam(param): value})
            train, valid = 0.0, 0.0
            for i in range(folds):
                seen, held = data.where(F.col("fold") != i), data.where(F.col("fold") == i)
                model = fitted.fit(seen)
                train += _scores(model, seen, label)[0] / folds
                valid += _scores(model, held, label)[0] / folds
            rows.append((float(value), train, valid))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "value double, train_score double, valid_score double")
