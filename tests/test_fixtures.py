"""Small inputs with answers worked out by hand."""

import itertools
import math
import pathlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.functions import AggSpec, clip_at_zero, finite_or_zero, flag, ordinal_code, safe_div, unique_names
from loanloom.operators import clean, duplicates, encode, model, outliers, profile, selection
from loanloom.operators.correlation import correlations, drop_correlated, high_correlated_columns
from loanloom.operators.quantiles import group_median
from loanloom.operators.recency import Block, recency_features
from loanloom.operators.split import stratified_split
from loanloom.plans import application
from loanloom.plans.instalments import attach_payment_sum, instalment_row_features, late_columns
from loanloom.plans.pos import loan_outcomes, pos_features
from loanloom.sources import cache_or_load, narrow_types, read_csv, shared_dir


def test_stats_of_missing_groups(spark, rows):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5)], "k int, v int")
    out = df.groupBy("k").agg(*AggSpec({"v": ["sum", "count", "size", "mean", "var"]}).columns())
    assert rows(out) == [(1, 0, 0, 2, None, None), (2, 5, 1, 1, 5.0, None)]


def test_segment_without_rows_is_missing(spark, rows):
    df = spark.createDataFrame([(1, "a", 3), (2, "b", 4)], "k int, s string, v int")
    spec = AggSpec({"v": ["sum", "count", "size", "nunique", "max"]})
    out = df.groupBy("k").agg(*spec.columns(where="s = 'a'"))
    assert rows(out) == [(1, 3, 1, 1, 1, 3), (2, None, None, None, None, None)]


def test_unknown_stat_is_refused():
    with pytest.raises(ValueError):
        AggSpec({"v": ["mode"]})


def test_division_modes(spark):
    df = spark.createDataFrame([(1, 0), (-1, 0), (0, 0), (6, 3)], "n int, d int")
    out = df.select(safe_div("n", "d").alias("a"), safe_div("n", "d", "ieee").alias("b")).collect()
    assert [r.a for r in out] == [None, None, None, 2.0]
    assert [r.b for r in out][:2] == [math.inf, -math.inf]
    assert out[2].b is None and out[3].b == 2.0  # a later maximum would return NaN


def test_group_median_lookup(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9), ("b", 4), (None, 7)], "cat string, inc int")
    assert rows(group_median(df, "inc", ["cat"])) == [("a", 2.0), ("b", 4.0)]


def test_one_hot(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    encoded, names = encode.one_hot(df)
    assert names == ["x_a", "x_b", "x_nan"]
    assert rows(encoded) == [(0, 0, 1), (0, 1, 0), (1, 0, 0)]
    dropped, names = encode.one_hot(df, ["x"], missing=False, drop_first=True)
    assert names == ["x_b"] and rows(dropped) == [(0,), (0,), (1,)]


def test_one_hot_names_and_quotes(spark):
    df = spark.createDataFrame([("it's",), ("a b",), ("A.B",), ("back\\slash",)], "x string")
    encoded, names = encode.one_hot(df, missing=False)
    assert len({n.lower() for n in names}) == 4
    assert encoded.agg(*[F.sum(n) for n in names]).first() == (1, 1, 1, 1)
    assert unique_names(["a", "A", "b"]) == ["a", "A_2", "b"]


def test_one_hot_refuses_only_where_asked(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("x"))
    assert len(encode.fit_vocabulary(df).levels["x"]) == 50
    with pytest.raises(ValueError):
        encode.fit_vocabulary(df, max_levels=20)


def test_sentinels(spark, rows):
    df = spark.createDataFrame([(None,), (0,), (-42,), (365243,)], "x int")
    assert rows(clean.null_max(df, ["x"], zero_is_missing=True)) == [(-42,), (None,), (None,), (None,)]
    assert rows(clean.null_max(df, ["x"])) == [(-42,), (0,), (None,), (None,)]


def test_sentinel_scope(spark, rows):
    df = spark.createDataFrame([(1, 9), (9, 2)], "x int, y int")
    assert rows(clean.null_sentinel(df, "x")) == [(1, 9), (None, 2)]
    assert rows(clean.null_sentinel(df, "x", "all")) == [(1, None), (None, 2)]


def test_sentinel_scope_spares_keys(spark, rows):
    df = spark.createDataFrame([(1, 9, 9), (9, 2, 3)], "k int, x int, y int")
    assert rows(clean.null_sentinel(df, "x", "all", keys=["k"])) == [(1, None, None), (9, 2, 3)]


def test_clean_application_keeps_a_key_as_large_as_the_sentinel(spark):
    names = [*application.NOT_AVAILABLE_COLUMNS, "NAME_TYPE_SUITE", "CODE_GENDER", "NAME_FAMILY_STATUS"]
    plain = spark.range(365242, 365245).select(
        F.col("id").alias("SK_ID_CURR"), F.lit(365243).alias("DAYS_EMPLOYED"), F.lit(2.0).alias("CNT_FAM_MEMBERS"),
        *[F.lit("a").alias(c) for c in dict.fromkeys(names)], *[F.lit(1.0).alias(c) for c in application.ZERO_FILLED],
    )
    cleaned = application.clean_application(plain, sentinel_scope="all")
    assert sorted(r[0] for r in cleaned.select("SK_ID_CURR").collect()) == [365242, 365243, 365244]


def test_fills(spark, rows):
    df = spark.createDataFrame([("a", None), ("a", 1), ("b", 2), (None, 1)], "s string, n int")
    assert rows(clean.fill_mode(df, ["s", "n"])) == [("a", 1), ("a", 1), ("a", 1), ("b", 2)]
    assert rows(clean.fill_constant(df, {"s": "z", "n": "z"}), "s", "n")[-1] == ("z", 1)


def test_recency_slices(spark, rows):
    detail = spark.createDataFrame([(1, -3, 10), (1, -100, 20), (2, -400, 5)], "k int, d int, v int")
    base = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    block = Block.of(AggSpec({"v": ["sum", "size"]}))
    want = [(1, 30, 2, 30, 2, 10, 1), (2, 5, 1, None, None, None, None), (3,) + (None,) * 6]
    slices = {"": None, "_year": 365, "_week": 7}
    for strategy in ("tagged", "one_pass", "naive"):
        features = recency_features(detail, "k", "d", slices, block, strategy)
        assert rows(base.join(features, "k", "left")) == want, strategy


def test_loan_outcomes(spark, rows):
    df = spark.createDataFrame(
        [(7, 1, -3, 12, 5, "Active"), (7, 1, -2, None, 4, "Active"), (7, 1, -1, 10, None, "Completed")],
        "SK_ID_PREV int, SK_ID_CURR int, MONTHS_BALANCE int, CNT_INSTALMENT int, CNT_INSTALMENT_FUTURE int, "
        "NAME_CONTRACT_STATUS string",
    )
    assert rows(loan_outcomes(df, ["SK_ID_PREV"], ["MONTHS_BALANCE"])) == [(7, 1 / 3, 1, 4, 0.4)]
    full = pos_features(df.withColumns({"SK_DPD": F.lit(0), "SK_DPD_DEF": F.lit(0)}))
    assert full.first()["POS_REMAINING_INSTALMENTS_RATIO"] == 0.4


def test_payment_sums(spark, rows):
    df = spark.createDataFrame(
        [(1, 1, 100, 60, 0, 0), (1, 1, 100, 40, 0, 0), (1, 2, 100, 120, 0, 0)],
        "SK_ID_PREV int, NUM_INSTALMENT_NUMBER int, AMT_INSTALMENT int, AMT_PAYMENT int, "
        "DAYS_ENTRY_PAYMENT int, DAYS_INSTALMENT int",
    )
    assert rows(attach_payment_sum(df), "AMT_PAYMENT_GROUPED") == [(100,), (100,), (120,)]
    out = instalment_row_features(df)
    assert rows(out, "PAYMENT_DIFFERENCE") == [(-20,), (0,), (0,)]
    assert rows(out, "PAID_OVER_AMOUNT", "PAID_OVER") == [(-40, 0), (-60, 0), (20, 1)]


def test_days_past_due(spark):
    df = spark.createDataFrame([(10, 5), (5, 10), (5, 5), (None, 5)], "DAYS_ENTRY_PAYMENT int, DAYS_INSTALMENT int")
    df = df.withColumns({"AMT_PAYMENT": F.lit(1), "AMT_INSTALMENT": F.lit(1)})
    out = late_columns(df).collect()
    assert [r.DPD for r in out] == [5, 0, 0, None]
    assert [r.DBD for r in out] == [0, 5, 0, None]
    assert [r.LATE_PAYMENT for r in out] == [0, 1, 0, 0]
    assert [r.LATE_PAYMENT for r in late_columns(df, "DPD").collect()] == [1, 0, 0, 0]


def test_due_buckets(spark):
    df = spark.createDataFrame([(6,), (7,), (720,), (None,)], "DAYS_ENTRY_PAYMENT int")
    df = df.withColumns({"DAYS_INSTALMENT": F.lit(0), "AMT_PAYMENT": F.lit(1), "AMT_INSTALMENT": F.lit(1)})
    out = late_columns(df).select("DPD_7", "DPD_180", "DPD_WOF").collect()
    assert [tuple(r) for r in out] == [(0, 0, 0), (1, 0, 0), (1, 1, 1), (0, 0, 0)]


def test_narrow_types(spark):
    df = spark.createDataFrame(
        [(-127, 0, 0, 0, 1.5), (126, 127, 32767, 40000, None)], "a int, b int, c int, d int, e double"
    )
    assert [t for _, t in narrow_types(df).dtypes] == ["tinyint", "smallint", "int", "int", "float"]


def test_outliers(spark, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1, 2, 3, 4, 100])], "id int, x int")
    assert outliers.fit_fences(df, ["x"]) == {"x": (-1.0, 7.0)}
    assert rows(outliers.winsorise(df, ["x"]), "x") == [(1.0,), (2.0,), (3.0,), (4.0,), (7.0,)]
    assert rows(outliers.has_outliers(df, ["x"])) == [("x", True)]
    assert rows(outliers.remove_outliers(df, "x"), "x") == [(1,), (2,), (3,), (4,)]
    assert rows(outliers.grab_outliers(df, "x", "id")) == [(4, 100)]
    missing = df.unionByName(spark.createDataFrame([(9, None)], "id int, x int"))
    assert outliers.remove_outliers(missing, "x").count() == 5


def test_rare_categories(spark, rows):
    two_rare = spark.createDataFrame([("a",)] * 985 + [("b",)] * 8 + [("c",)] * 7, "x string")
    out = encode.rare_to_other(two_rare, ["x"], 0.01)
    assert rows(out.groupBy("x").count()) == [("999", 15), ("a", 985)]
    one_rare = spark.createDataFrame([("a",)] * 992 + [("b",)] * 8, "x string")
    assert rows(encode.rare_to_other(one_rare, ["x"], 0.01).groupBy("x").count()) == [("a", 992), ("b", 8)]


def test_correlated_columns(spark):
    data = [(float(i), 2.0 * i, -1.0 * i, float((i * 7) % 5)) for i in range(50)]
    df = spark.createDataFrame(data, "x double, y double, z double, w double")
    assert high_correlated_columns(df, threshold=0.9) == ["y", "z"]
    assert drop_correlated(df, threshold=0.9).columns == ["x", "w"]


def test_correlation_by_brute_force(spark):
    nan = float("nan")
    data = [
        (float(i * i % 17), None if i % 4 == 0 else float(i % 7), float(i) + 1e9, 3.0, 0.1 if i % 2 else None, nan if i % 3 else float(i))
        for i in range(200)
    ]
    data = [(*r, r[0] if r[4] is None else 0.7) for r in data]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double, f double, g double")
    found = {(r.col_a, r.col_b): r.r for r in correlations(df).collect()}
    assert len(found) == 21
    for (i, a), (j, b) in itertools.combinations(enumerate("abcdefg"), 2):
        pairs = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None and r[i] == r[i] and r[j] == r[j]]
        flat = len({x for x, _ in pairs}) < 2 or len({y for _, y in pairs}) < 2
        want = None if flat else np.corrcoef(np.array(pairs).T)[0, 1]
        assert (found[a, b] is None) if want is None else found[a, b] == pytest.approx(want, abs=1e-9)


def test_missing_tables(spark, rows):
    df = spark.createDataFrame([(1, 1), (None, 1), (2, 1), (3, 1)], "a int, b int")
    assert rows(profile.missing_values_table(df)) == [("a", "int", 1, 25.0)]
    assert rows(profile.missing_values_table(df, with_dtype=False)) == [("a", 1, 25.0)]
    assert profile.mostly_missing(df, 20) == ["a"] and profile.mostly_missing(df) == []
    target = spark.createDataFrame([(1, None), (0, None), (1, 5), (0, 6)], "TARGET int, a int")
    assert rows(profile.missing_vs_target(target, "TARGET", ["a"])) == [
        ("a_NA_FLAG", 0, 0.5, 2), ("a_NA_FLAG", 1, 0.5, 2),
    ]


def test_duplicates(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (None, 5), (None, 6)], "k int, o int")
    assert rows(duplicates.duplicate_keys(df, ["k"], ["o"])) == [(1, 2), (1, 3), (None, 6)]
    ties = spark.createDataFrame([(1, 5), (1, 5), (1, 5), (2, 1), (None, 3), (None, 3)], "k int, o int")
    assert rows(duplicates.duplicate_keys(ties, ["k"], ["o"])) == [(1, 5), (1, 5), (None, 3)]
    zeros = spark.createDataFrame([(0.0, 1), (-0.0, 2)], "k double, o int")
    assert duplicates.duplicate_keys(zeros, ["k"], ["o"]).count() == 1
    same = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b")], "k int, s string")
    repeats = duplicates.duplicate_rows(same)
    assert rows(repeats) == [(1, "a", 2)] and rows(duplicates.expand_copies(repeats)) == [(1, "a"), (1, "a")]


def test_ordinal_code(spark):
    df = spark.createDataFrame([("Closed",), ("Active",), ("Sold",), (None,)], "c string")
    out = df.select(ordinal_code("c", {"Closed": 0, "Active": 1}, 2).alias("v")).collect()
    assert [r.v for r in out] == [0, 1, 2, 2]


def test_stratified_split(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    first = None
    for _ in range(2):
        train, cv = stratified_split(df, "y", "id", 0.2, seed=3)
        assert (train.count(), train.where("y = 1").count()) == (80, 8)
        assert (cv.count(), cv.where("y = 1").count()) == (20, 2)
        assert train.join(cv, "id").count() == 0
        ids = sorted(r.id for r in train.collect())
        first = first or ids
        assert ids == first


def test_split_with_many_ties(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("y"))
    train, cv = stratified_split(df, "y", "id", 0.25, order=F.col("id") % 2, order_max=2)
    assert train.groupBy("y").count().orderBy("y").collect() == [(0, 251), (1, 250), (2, 250)] or (
        sorted(r["count"] for r in train.groupBy("y").count().collect()) == [250, 250, 251]
    )
    assert cv.count() == 1000 - train.count()


def test_anova_f(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 4.0), (1, 5.0), (1, 6.0)], "y int, f double")
    df = df.withColumn("flat", F.lit(1.0))
    scores = {r.feature: r.f_score for r in selection.anova_f(df, ["f", "flat"], "y").collect()}
    assert scores["f"] == pytest.approx(13.5) and scores["flat"] is None
    assert selection.select_k_best(df, ["flat", "f"], "y", 1) == ["f"]


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, same double")
    out = selection.scale(df, selection.fit_scaler(df, ["x", "same"])).collect()
    assert [r.x for r in out] == pytest.approx([-1.224745, 0.0, 1.224745], abs=1e-6)
    assert [r.same for r in out] == [0.0, 0.0, 0.0]


def test_metrics(spark):
    pairs = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4
    m = model.binary_metrics(spark.createDataFrame(pairs, "y int, p int"), "y", "p").first()
    assert (m.tp, m.fp, m.fn, m.tn) == (3, 1, 2, 4)
    assert (m.accuracy, m.precision, m.recall) == (0.7, 0.75, 0.6) and m.f1 == pytest.approx(2 / 3)


def test_finite_matrix(spark):
    df = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,), (2.0,)], "x double")
    top = sys.float_info.max
    assert [r.v for r in df.select(finite_or_zero("x").alias("v")).collect()] == [0.0, 0.0, top, -top, 2.0]


def test_target_percent(spark, rows):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("a", 1), ("b", 1)], "c string, t int")
    assert rows(profile.target_percent(df, "c", "t")) == [("a", 50.0, 50.0), ("b", 0.0, 100.0)]


def test_clip_and_flag_keep_missing_apart(spark):
    df = spark.createDataFrame([(-1,), (2,), (None,)], "x int")
    out = df.select(clip_at_zero("x").alias("c"), flag(F.col("x") > 0).alias("f")).collect()
    assert [tuple(r) for r in out] == [(0, 0), (2, 1), (None, 0)]


def test_first_of_each_name(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").select("a", "b", F.col("b").alias("a"))
    out = clean.first_of_each_name(df)
    assert out.columns == ["a", "b"] and out.first() == (1, 2)


def test_csv_and_cache(spark, rows):
    import uuid

    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, s string")
    df.write.option("header", True).csv(f"{base}/csv")
    assert rows(read_csv(spark, f"{base}/csv", df.schema)) == [(1, "x"), (2, None)]
    cache_or_load(df, f"{base}/pq")
    other = spark.createDataFrame([(9, "z")], "a int, s string")
    assert cache_or_load(other, f"{base}/pq").count() == 2
    assert cache_or_load(other, f"{base}/pq", refresh=True).count() == 1
    df.write.parquet(f"{base}/broken")
    (pathlib.Path(f"{base}/broken".removeprefix("file:")) / "_SUCCESS").unlink()
    assert rows(cache_or_load(other, f"{base}/broken")) == [(9, "z")]


def test_csv_markers_and_bad_fields(spark, rows):
    import uuid

    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    lines = [("1", "NaN", "x"), ("NA", "2.5", "n/a"), ("3", "xyz", "y")]
    spark.createDataFrame(lines, "a string, b string, s string").write.option("header", True).csv(base)
    schema = "a int, b double, s string"
    with pytest.raises(Exception, match="b is no double"):
        read_csv(spark, base, schema).collect()
    assert rows(read_csv(spark, base, schema, mode="PERMISSIVE")) == [(1, None, "x"), (3, None, "y"), (None, 2.5, None)]
    assert rows(read_csv(spark, base, schema, mode="DROPMALFORMED")) == [(1, None, "x"), (None, 2.5, None)]
    assert read_csv(spark, base, infer=True).dtypes == [("a", "int"), ("b", "string"), ("s", "string")]
    with pytest.raises(ValueError):
        read_csv(spark, base, "a int")


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 1.0), (2.0, nan), (None, 1.0), (2.0, 1.0)], "a double, b double")
    assert {r["column"]: r.n_miss for r in profile.missing_counts(df).collect()} == {"a": 2, "b": 1}
    assert profile.constant_columns(df) == ["a", "b"]
    assert [r.a for r in clean.fill_mode(df, ["a"]).collect()] == [2.0] * 4
    assert [r.a_NA_FLAG for r in encode.missing_flags(df, ["a"]).collect()] == [1, 0, 1, 0]


def test_one_hot_of_any_type(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (true, DATE'2020-01-02', 1.50BD), (false, DATE'2019-01-01', 2.25BD), (NULL, NULL, NULL) t(b, d, m)"
    )
    encoded, names = encode.one_hot(df, ["b", "d", "m"], missing=False)
    assert len(names) == 6 and encoded.agg(*[F.sum(n) for n in names]).first() == (1,) * 6


def test_small_shares_agree_with_counts(spark):
    df = spark.range(2000).select((F.col("id") % 400).alias("a"), F.when(F.col("id") < 30, 1).otherwise(F.col("id")).alias("b"))
    every = {r["column"]: (r.top_value, r.n) for r in profile.near_constants(df, 1e-6).collect()}
    assert every == {"a": ("0", 5), "b": ("1", 30)}
    assert [r["column"] for r in profile.near_constants(df, 0.01).collect()] == ["b"]


def test_unlabelled_rows_are_on_neither_side(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 50, F.col("id") % 2).alias("y"))
    train, cv = stratified_split(df, "y", "id", 0.2)
    assert train.count() == 40 and cv.count() == 10


def test_column_kinds(spark):
    df = spark.range(100).select(
        "id", (F.col("id") % 3).alias("few"), F.col("id").cast("string").alias("wide"), F.lit("x").alias("flat"),
        F.when(F.col("id") < 2, "y").otherwise("n").alias("yn"),
    )
    kinds = profile.grab_col_names(df)
    assert kinds == (["flat", "yn", "few"], ["id"], ["wide"], ["few"])
    assert encode.binary_columns(df) == ["yn"]
    assert profile.constant_columns(df) == ["flat"]
    assert [r["column"] for r in profile.near_constants(df, 0.9).orderBy("column").collect()] == ["flat", "yn"]


def test_modelling_a_matrix(spark):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.tuning import ParamGridBuilder

    from loanloom.plans.modelling import model_matrix

    rows = spark.range(400).selectExpr(
        "id", "CAST(id % 4 = 0 AS INT) AS y", "id % 4 + (id % 7) / 20 AS telling", "id % 11 AS noise", "id % 5 AS other",
        "CASE WHEN id % 6 > 0 THEN id % 13 END AS holes",
    )
    forest = RandomForestClassifier(labelCol="y", numTrees=3, maxDepth=2, seed=1)
    linear = LogisticRegression(labelCol="y", maxIter=20)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, [1, 2]).build()
    out = model_matrix(rows, "y", "id", k=2, estimators={"forest": forest, "linear": linear}, grids={"forest": grid}, folds=2)
    assert "telling" in out.features and len(out.features) == 2
    assert out.grids.keys() == out.tuned_scores.keys() == {"forest"} and out.grids["forest"].count() == 2
    assert out.vote_scores.count() == 2 and min(r.roc_auc for r in out.vote_scores.collect()) > 0.95
    assert {r["class"]: r.support for r in out.report.collect()} == {0: 60, 1: 20}
