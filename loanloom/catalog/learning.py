"""Split, feature scores, scaling, models and metrics."""

from __future__ import annotations

from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from loanloom.catalog.registry import query, r4, rounded, sql_r4, sql_rounded
from loanloom.operators import model, selection
from loanloom.operators.clean import finite_matrix
from loanloom.operators.split import stratified_folds, stratified_split
from loanloom.operators.spread import spread
from loanloom.plans import roles

_HASH = "(SK_ID_CURR * 2654435761) % 1000003"
_SPLIT_SQL = f"""SELECT SK_ID_CURR, CAST(TARGET AS BIGINT) AS TARGET, CASE WHEN place <= round(n * 0.8e0) THEN 'train' ELSE 'cv' END AS side
    FROM (SELECT SK_ID_CURR, TARGET, row_number() OVER (PARTITION BY TARGET ORDER BY {_HASH}, SK_ID_CURR) AS place,
          count(*) OVER (PARTITION BY TARGET) AS n FROM {{application}}) s"""


@query("m1_split", _SPLIT_SQL)
def _(t):
    rows = t.application.select("SK_ID_CURR", F.col("TARGET").cast("long").alias("TARGET"))
    train, cv = stratified_split(rows, "TARGET", "SK_ID_CURR", 0.2, order=F.expr(_HASH), order_max=1_000_003)
    return train.withColumn("side", F.lit("train")).unionByName(cv.withColumn("side", F.lit("cv")))


FOLDS = 10


@query(
    "m7_folds",
    f"""WITH ranked AS (SELECT SK_ID_CURR, TARGET, row_number() OVER (PARTITION BY TARGET ORDER BY {_HASH}, SK_ID_CURR) AS r,
          count(*) OVER (PARTITION BY TARGET) AS n FROM {{application}})
        SELECT SK_ID_CURR, CAST(TARGET AS BIGINT) AS TARGET,
          CAST(len(list_filter(range(1, {FOLDS}), lambda i: r > n * i // {FOLDS})) AS INT) AS fold FROM ranked""",
)
def _(t):
    rows = t.application.select("SK_ID_CURR", F.col("TARGET").cast("long").alias("TARGET"))
    return stratified_folds(rows, "TARGET", "SK_ID_CURR", FOLDS, order=F.expr(_HASH), order_max=1_000_003)


FEATURES = [
    "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_BIRTH", "DAYS_EMPLOYED", "DAYS_REGISTRATION",
    "OWN_CAR_AGE", "EXT_SOURCE_1", "EXT_SOURCE_2", "CNT_CHILDREN", "FLAG_EMAIL", "FLAG_EMP_PHONE",
]
# Every numeric column of the applicants.
NUMBERS = [c for c in roles.application(lambda *_: "") if c.startswith(("CNT_", "AMT_", "DAYS_", "OWN_", "EXT_", "FLAG_"))]
TOP = 20


def _sql_anova(features: list[str]) -> str:
    """Between and within class mean squares from first principles."""
    return " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / nullif(sum(ss) / (sum(n) - count(*)), 0) AS f_score
            FROM (SELECT count(*) AS n, avg(coalesce({f}, 0)) AS m, sum((coalesce({f}, 0) - cm) * (coalesce({f}, 0) - cm)) AS ss, max(g) AS g
              FROM {{application}} a JOIN (SELECT TARGET AS ct, avg(coalesce({f}, 0)) AS cm FROM {{application}} GROUP BY TARGET) c ON TARGET = ct,
              (SELECT avg(coalesce({f}, 0)) AS g FROM {{application}}) o GROUP BY TARGET) p"""
        for f in features
    )


@query("m2_anova_f", sql_rounded(_sql_anova(NUMBERS), ["feature"]))
def _(t):
    return rounded(selection.anova_f(t.application, NUMBERS, "TARGET"), ["feature"])


@query(
    "m2_anova_topk",
    sql_rounded(f"SELECT * FROM ({_sql_anova(NUMBERS)}) f ORDER BY f_score DESC, feature LIMIT {TOP}", ["feature"]),
)
def _(t):
    return rounded(selection.top_features(selection.anova_f(t.application, NUMBERS, "TARGET"), TOP), ["feature"])


_SCALED = ["AMT_CREDIT", "AMT_ANNUITY", "OWN_CAR_AGE"]


@query(
    "m3_scale",
    "SELECT SK_ID_CURR, " + ", ".join(
        sql_r4(f"({c} - m_{c}) / s_{c}") + f" AS {c}" for c in _SCALED
    ) + " FROM {application} a, (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED
    ) + " FROM {application}) f",
)
def _(t):
    rows = t.application.select("SK_ID_CURR", *_SCALED)
    return rounded(selection.scale(rows, selection.fit_scaler(rows, _SCALED)), ["SK_ID_CURR"])


@query(
    "m4_align",
    """SELECT SK_ID_CURR, AMT_CREDIT, OWN_CAR_AGE, CAST(0 AS BIGINT) AS ORGANIZATION_TYPE_Org_99 FROM {application}""",
)
def _(t):
    aligned = selection.align_columns(
        t.application, ["SK_ID_CURR", "AMT_CREDIT", "OWN_CAR_AGE", "ORGANIZATION_TYPE_Org_99"]
    )
    return aligned.withColumn("ORGANIZATION_TYPE_Org_99", F.col("ORGANIZATION_TYPE_Org_99").cast("long"))


# --- metrics ----------------------------------------------------------------------------------

_GUESS = "CASE WHEN AMT_CREDIT < 15000 AND CNT_CHILDREN < 3 THEN 1 ELSE 0 END"


def _guessed(t):
    return t.application.select("TARGET", F.expr(_GUESS).alias("guess"), "AMT_CREDIT")


@query(
    "m10_metrics",
    f"""SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
        {sql_r4("(tp + tn) * 1e0 / (tp + fp + fn + tn)")} AS accuracy, {sql_r4("tp * 1e0 / nullif(tp + fp, 0)")} AS precision,
        {sql_r4("tp * 1e0 / nullif(tp + fn, 0)")} AS recall, {sql_r4("2e0 * tp / nullif(2 * tp + fp + fn, 0)")} AS f1
        FROM (SELECT sum(TARGET * g) AS tp, sum((1 - TARGET) * g) AS fp, sum(TARGET * (1 - g)) AS fn,
          sum((1 - TARGET) * (1 - g)) AS tn FROM (SELECT TARGET, {_GUESS} AS g FROM {{application}}) x) c""",
)
def _(t):
    return rounded(model.binary_metrics(_guessed(t), "TARGET", "guess"), ["tp", "fp", "fn", "tn"])


@query(
    "m10_report",
    " UNION ALL ".join(
        f"""SELECT CAST({c} AS BIGINT) AS class, {sql_r4("hit * 1e0 / nullif(guessed, 0)")} AS precision,
            {sql_r4("hit * 1e0 / nullif(support, 0)")} AS recall, {sql_r4("2e0 * hit / nullif(guessed + support, 0)")} AS f1,
            CAST(support AS BIGINT) AS support FROM (SELECT count(*) FILTER (WHERE TARGET = {c} AND g = {c}) AS hit,
            count(*) FILTER (WHERE g = {c}) AS guessed, count(*) FILTER (WHERE TARGET = {c}) AS support
            FROM (SELECT TARGET, {_GUESS} AS g FROM {{application}}) x) y"""
        for c in (0, 1)
    ),
)
def _(t):
    report = model.classification_report(_guessed(t), "TARGET", "guess")
    return rounded(report.withColumn("class", F.col("class").cast("long")), ["class", "support"])


@query(
    "m10_auc",
    f"""SELECT {sql_r4("(sum(CASE WHEN TARGET = 1 THEN mid ELSE 0 END) - p * (p + 1) / 2e0) / (p * (n - p))")} AS roc_auc
        FROM (SELECT TARGET, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS mid,
          CAST(sum(TARGET) OVER () AS DOUBLE) AS p, CAST(count(*) OVER () AS DOUBLE) AS n
          FROM (SELECT TARGET, AMT_GOODS_PRICE_0 AS s FROM (SELECT TARGET, coalesce(AMT_GOODS_PRICE, 0) AS AMT_GOODS_PRICE_0 FROM {{application}}) a) b) r
        GROUP BY p, n""",
)
def _(t):
    scored = t.application.select("TARGET", F.coalesce("AMT_GOODS_PRICE", F.lit(0)).alias("s"))
    auc = model.roc_auc(scored, "TARGET", "s")
    return t.spark.createDataFrame([(auc,)], "roc_auc double").select(r4("roc_auc").alias("roc_auc"))


@query(
    "m9_vote_scores",
    f"""SELECT SK_ID_CURR, {sql_r4("(EXT_SOURCE_1 + EXT_SOURCE_2) / 2e0")} AS score,
        CASE WHEN EXT_SOURCE_1 + EXT_SOURCE_2 > 1 THEN 1 WHEN EXT_SOURCE_1 + EXT_SOURCE_2 <= 1 THEN 0 END AS prediction FROM {{application}}""",
)
def _(t):
    voted = model.vote(t.application.select("SK_ID_CURR", "EXT_SOURCE_1", "EXT_SOURCE_2"), ["EXT_SOURCE_1", "EXT_SOURCE_2"])
    return voted.select("SK_ID_CURR", r4("score").alias("score"), "prediction")


# --- models (no SQL twin) ---------------------------------------------------------------------


def _vectors(t):
    rows = t.application.select("SK_ID_CURR", "TARGET", *FEATURES)
    scaler = selection.fit_scaler(finite_matrix(rows, FEATURES), FEATURES)
    scaled = selection.scale(finite_matrix(spread(rows, "SK_ID_CURR"), FEATURES), scaler)
    return model.assemble(scaled, FEATURES, keep=["SK_ID_CURR", "TARGET"])


def _small_models():
    models = model.base_models("TARGET", seed=7)
    models["boosted"].setMaxIter(5).setMaxDepth(3)
    models["forest"].setNumTrees(10).setMaxDepth(4)
    return models


def _fitted(t):
    data = _vectors(t)
    fitted = {name: m.fit(data) for name, m in _small_models().items()}
    return data, fitted


@query("m5_base_models")
def _(t):
    data, fitted = _fitted(t)
    return model.soft_vote(fitted, data).select("SK_ID_CURR", "TARGET", "score_boosted", "score_forest")


@query("m7_cv")
def _(t):
    return model.cross_validate(_small_models()["forest"], _vectors(t), "TARGET", "SK_ID_CURR", folds=3)


@query("m8_grid")
def _(t):
    forest = _small_models()["forest"]
    grid = ParamGridBuilder().addGrid(forest.maxDepth, [2, 4]).addGrid(forest.numTrees, [5, 10]).build()
    _best, scores = model.grid_search(forest, grid, _vectors(t), "TARGET", "SK_ID_CURR", folds=3)
    return scores


@query("m9_vote")
def _(t):
    data, fitted = _fitted(t)
    return model.soft_vote(fitted, data).select("SK_ID_CURR", "TARGET", "score", "prediction")


@query("m11_importance")
def _(t):
    data, fitted = _fitted(t)
    return model.feature_importance(fitted["forest"], FEATURES, data, 10)


@query("m12_curve")
def _(t):
    forest = _small_models()["forest"]
    return model.validation_curve(forest, "maxDepth", [2, 4], _vectors(t), "TARGET", "SK_ID_CURR", folds=3)
