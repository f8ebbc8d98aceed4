"""One fit pass per source, and blocks stored so that train and test join them in place."""

import math
import time

import pytest
from pyspark.sql import functions as F

from loanloom.operators.clean import most_frequent, sentinel_values
from loanloom.operators.encode import fit_vocabulary
from loanloom.operators.fit import fit_source, known_facts
from loanloom.plans import matrix
from loanloom.plans.application import clean_and_fit, clean_application, fit_application
from loanloom.plans.roles import CARD_SLICES, POS_TIE_BREAK, Roles, _spark_days, instalments
from loanloom.session import shuffles_dropped, together
from loanloom.sources import bucketed_or_load

SF = "/root/testdata/sf0.001"


@pytest.fixture
def facts(spark):
    rows = [
        (1, "b", 2.0, 7, "x"), (1, "a", 2.0, 0, None), (2, None, 3.0, 9, "x"), (2, "a", 3.0, None, "NaN"),
        (3, "c'\\", math.nan, 9, "y"), (None, "a", None, -1, "y"),
    ]
    return spark.createDataFrame(rows, "k int, s string, d double, n int, t string").repartition(3)


def test_fit_equals_the_single_operators(facts):
    fit = fit_source(facts, sentinel_values(["n"]) | {"least": -F.col("n")}, ["s", "d", "n", "t"], spread_of="n")
    assert fit.rows == 6 and fit.maxima == {"n": 9, "least": 1} and fit.spread == 2
    assert fit.modes == most_frequent(facts, ["s", "d", "n", "t"]) == {"s": "a", "d": 2.0, "n": 9, "t": "x"}
    assert fit.vocabulary == fit_vocabulary(facts) and fit.vocabulary.levels["t"] == ("NaN", "x", "y")
    zero = fit_source(facts, sentinel_values(["n"], zero_is_missing=True), levels=[])
    assert zero.maxima == {"n": 9} and zero.vocabulary.levels == {}
    with pytest.raises(ValueError, match="more than 3 levels"):
        fit_source(facts, max_levels=3)
    assert fit_source(facts, max_levels=6).vocabulary == fit.vocabulary


def test_fit_of_an_empty_source(facts):
    fit = fit_source(facts.limit(0), sentinel_values(["n"]), ["d"], spread_of="n")
    assert (fit.rows, fit.maxima, fit.modes, fit.spread) == (0, {"n": None}, {"d": None}, 0)
    assert fit.vocabulary.levels == {"s": (), "t": ()}


def test_hot_keys_only_where_there_can_be_any(spark):
    df = spark.createDataFrame([(1 if i < 40 else i, "a") for i in range(100)], "SK_ID_CURR int, s string")
    fit = fit_source(df)
    assert fit.hot(df, "SK_ID_CURR", min_rows=30) == [1] and fit.hot(df, "SK_ID_CURR") == []
    vocabulary, hot = known_facts(df, fit, None, [7])
    assert vocabulary is fit.vocabulary and hot == [7]


def test_applicants_are_cleaned_and_fitted_alike(spark, rows):
    raw = Roles(spark, SF).application
    cleaned, fit = clean_and_fit(raw)
    apart = clean_application(raw)
    assert rows(cleaned) == rows(apart)
    want = fit_application(apart)
    assert fit.vocabulary == want.vocabulary and rows(fit.medians) == rows(want.medians)


def test_calls_run_together(spark):
    assert together(spark, lambda: spark.range(5).count(), lambda: spark.range(7).count()) == [5, 7] and together(spark) == []

    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError):
        together(spark, fails, lambda: 1)


def test_bucketed_tables(spark, rows, tmp_path):
    df = spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    path = str(tmp_path / "t")
    first = bucketed_or_load(df, path, "k", 4)
    assert rows(first) == rows(df)
    changed = df.where("v < 10")
    assert bucketed_or_load(changed, path, "k", 4).count() == 200  # written once
    # Another session knows the files, not the table.
    spark.sql(f"DROP TABLE {first._jdf.queryExecution().analyzed().output().apply(0).qualifier().last()}")
    again = bucketed_or_load(changed, path, "k", 4)
    assert rows(again) == rows(df)
    plan = again.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert bucketed_or_load(changed, path, "k", 4, refresh=True).count() == 10
    assert bucketed_or_load(df.limit(0), str(tmp_path / "none"), "k", 4).count() == 0


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_matrices_join_stored_blocks_in_place(spark, rows, tmp_path, no_broadcasts):
    t = Roles(spark, SF)
    sources = matrix.Sources(t.bureau, t.bureau_balance, t.previous, t.pos, t.instalments, t.card)
    actions = spark._jsparkSession.sharedState().statusStore().executionsCount
    before = actions()
    blocks = matrix.side_blocks(sources, pos_tie_break=POS_TIE_BREAK, card_slices=CARD_SLICES)
    assert actions() - before <= 6  # one a source
    stored = matrix.write_blocks(blocks, str(tmp_path))
    files = {f for b in stored for f in b.inputFiles()}
    train, fit = matrix.train_matrix(t.application.where("SK_ID_CURR % 11 >= 3"), stored)
    test = matrix.test_matrix(t.application.where("SK_ID_CURR % 11 < 3"), matrix.write_blocks(blocks, str(tmp_path)), fit)
    for whole in (train, test):
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 5 and plan.count("Exchange hashpartitioning") == 1  # that of the applicants
        assert plan.count("Bucketed: true") == 5
        assert set(whole.inputFiles()) >= files
    columns = ["SK_ID_CURR", "BUREAU_DAYS_CREDIT_mean", "PREV_AMT_CREDIT_MAX_week", "POS_SK_DPD_MAX", "INSTALLATION_COUNT_year", "CREDIT_COUNT"]
    plain, _ = matrix.train_matrix(t.application.where("SK_ID_CURR % 11 >= 3"), blocks)
    assert rows(train, *columns) == rows(plain, *columns)


def test_blocks_are_stored_one_by_one_and_leave_no_shuffles(spark, tmp_path, monkeypatch):
    """The disk holds the shuffle of one block at a time, the narrow ones first; the session's setting is as it was."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles().iterator()
        found = set()
        while files.hasNext():
            found.add(files.next().getName())
        return {f for f in found if f.startswith("shuffle_")}

    def left(before):
        """Files are deleted soon after a query, not before it returns."""
        for _ in range(100):
            if not shuffles() - before:
                break
            time.sleep(0.1)
        return shuffles() - before

    def grouped(name, n):
        measures = [F.max("id").alias(f"{name}{i}") for i in range(n)]
        return spark.range(300).withColumn("SK_ID_CURR", F.col("id") % 40).groupBy("SK_ID_CURR").agg(*measures)

    stored, running = [], []

    def write(df, *args):
        running.append(1)
        assert len(running) == 1
        result = bucketed_or_load(df, *args)
        assert not left(before)
        running.pop()
        stored.append(df.columns[1])
        return result

    monkeypatch.setattr(matrix, "bucketed_or_load", write)
    before = shuffles()
    blocks = matrix.write_blocks([grouped("wide", 9), grouped("narrow", 1), grouped("mid", 4)], str(tmp_path))
    assert stored == ["narrow0", "mid0", "wide0"] and [len(b.columns) for b in blocks] == [10, 2, 5]
    assert all(b.count() == 40 and all(".zstd." in f for f in b.inputFiles()) for b in blocks)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(name, None) is None

    before = shuffles()
    t = Roles(spark, SF)
    matrix.side_blocks(matrix.Sources(t.bureau, t.bureau_balance, t.previous, t.pos, t.instalments, t.card))
    assert not left(before) and spark.conf.get(name, None) is None
    with pytest.raises(ValueError), shuffles_dropped(spark):
        spark.conf.set(name, "false")
        with shuffles_dropped(spark):
            frame = grouped("again", 1)
            assert frame.count() == 40 and len(frame.collect()) == len(frame.collect()) == 40
        assert spark.conf.get(name) == "false"
        raise ValueError
    assert spark.conf.get(name, None) is None


def test_instalments_are_derived_before_the_join(spark, rows):
    """The same rows as by deriving after it, with no raw amounts shipped."""
    t = Roles(spark, SF)
    after = t._derive(t._lines(), instalments(_spark_days))
    assert t.instalments.schema == after.schema and rows(t.instalments) == rows(after)
    above, below = t.instalments._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")
    assert "l_" not in above and "AS AMT_PAYMENT" in below
