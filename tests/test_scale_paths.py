"""The ways taken for large or skewed data, forced on small inputs and checked by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.functions import AggSpec
from loanloom.operators import attach, correlation, duplicates, encode, lookup, quantiles, recency
from loanloom.operators import table_profile
from loanloom.operators.recency import DAY_SLICES, MONTH_SLICES, Block, recency_features
from loanloom.operators.split import stratified_folds, stratified_split
from loanloom.plans import bureau, card, instalments, matrix, pos, previous
from loanloom.plans.roles import CARD_SLICES, POS_TIE_BREAK, Roles

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def roles(spark):
    return Roles(spark, FOLDER)


def cut(df):
    """Comparable rows: doubles to nine significant digits."""

    def plain(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v

    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


SLICED = {
    "previous": lambda r, **kw: previous.previous_recency(previous.clean_previous(r.previous), **kw),
    "pos": lambda r, **kw: pos.pos_recency(r.pos, tie_break=POS_TIE_BREAK, **kw),
    "instalments": lambda r, **kw: instalments.instalment_recency(r.instalments, **kw),
    "card": lambda r, **kw: card.card_recency(r.card, slices=CARD_SLICES, **kw),
}


@pytest.mark.parametrize("name", SLICED)
def test_strategies_agree(roles, name):
    build = SLICED[name]
    want = cut(build(roles, strategy="naive"))
    assert cut(build(roles, hot=[])) == want
    # Half the keys through the path of hot keys.
    assert cut(build(roles, hot=list(range(0, 150, 2)))) == want
    if name in ("previous", "card"):
        assert cut(build(roles, strategy="one_pass")) == want
        assert cut(build(roles, strategy="bands", hot=[])) == want
        assert cut(build(roles, strategy="bands", hot=list(range(0, 150, 2)))) == want
    else:
        for strategy in ("one_pass", "bands"):
            with pytest.raises(ValueError):
                build(roles, strategy=strategy)


def test_old_rows_are_filtered_before_the_shuffle(roles):
    slices = {"_half_year": 14, "_month": 3}
    wants = cut(card.card_recency(roles.card, slices=slices, strategy="naive"))
    for strategy in ("tagged", "one_pass", "bands"):
        out = card.card_recency(roles.card, slices=slices, strategy=strategy, hot=[])
        assert cut(out) == wants
        scan = plan_of(out).split("Exchange hashpartitioning")[-1]
        assert ">= -14" in scan


def test_bureau_hot_keys_agree(roles):
    plain = bureau.bureau_features(roles.bureau, roles.bureau_balance, hot=[])
    split = bureau.bureau_features(roles.bureau, roles.bureau_balance, hot=[1, 2, 3, 5, 8, 13])
    assert cut(plain) == cut(split)


def test_slices_are_nested(roles):
    out = SLICED["card"](roles).selectExpr(*[f"coalesce(CREDIT_COUNT{s}, 0) AS `n{s}`" for s in CARD_SLICES])
    names = out.columns
    wrong = None
    for wide, narrow in zip(names, names[1:]):
        bad = F.col(narrow) > F.col(wide)
        wrong = bad if wrong is None else wrong | bad
    assert out.where(wrong).count() == 0
    assert list(DAY_SLICES)[0] == list(MONTH_SLICES)[0] == ""


@pytest.mark.parametrize("name", ["previous", "card"])
def test_one_shuffle_per_source(spark, name):
    """All slices of a plain source table come out of a single exchange."""
    roles = Roles(spark, FOLDER)
    build = {
        "previous": lambda: previous.previous_recency(
            spark.read.parquet(f"{FOLDER}/orders.parquet").select(
                F.col("o_orderkey").alias("SK_ID_PREV"), F.col("o_custkey").alias("SK_ID_CURR"),
                F.col("o_orderstatus").alias("NAME_CONTRACT_STATUS"),
                *[
                    F.col("o_totalprice").alias(c)
                    for c in (*previous.STATS, "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE")
                    if not c.endswith(("_RATIO", "_TO_CREDIT", "_DIFF"))
                ],
            ),
            hot=[],
        ),
        "card": lambda: card.card_recency(roles.card, slices=CARD_SLICES, hot=[]),
    }[name]
    assert plan_of(build()).count("Exchange hashpartitioning") == 1


def test_scan_reads_only_needed_columns(spark):
    roles = Roles(spark, FOLDER)
    plan = plan_of(pos.pos_recency(roles.pos, tie_break=POS_TIE_BREAK, hot=[]))
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


def test_hot_key_detection(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("k"))
    assert lookup.hot_keys(df, "k", min_rows=1000) == [7]
    assert lookup.hot_keys(df, "k") == []
    assert lookup.hot_keys(df.select(F.lit(None).cast("long").alias("k")), "k", min_rows=1) == []


def test_hot_rows_are_joined_without_a_shuffle(spark):
    """One key and the missing key hold a third of the rows each."""
    df = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 500 + 100).alias("k"),
        F.col("id").alias("v"),
    )
    stats = {"n": F.count("v"), "top": F.max("v")}
    plain = attach.attach_stats(df, "k", stats)
    split = attach.attach_stats(df, "k", stats, min_hot_rows=5000)
    assert cut(plain) == cut(split)
    assert "Union" in plan_of(split) and "Union" not in plan_of(plain)
    repeats = duplicates.duplicate_keys(df, ["k"], ["v"])
    split = duplicates.duplicate_keys(df, ["k"], ["v"], min_hot_rows=5000)
    assert cut(repeats) == cut(split) and split.count() == 30_000 - 500 - 2
    pair = attach.attach_stats(df.withColumn("j", F.lit(1)), ["k", "j"], stats, min_hot_rows=5000)
    assert cut(pair.drop("j")) == cut(plain)


def test_many_copies_are_spread(spark):
    same = spark.range(2500).select((F.col("id") % 2).alias("k")).where("k = 0 OR k = 1")
    repeated = duplicates.duplicate_rows(same)
    expanded = duplicates.expand_copies(repeated, chunk=100)
    assert {r.k: r["count"] for r in expanded.groupBy("k").count().collect()} == {0: 1249, 1: 1249}


@pytest.mark.parametrize(("limit", "accuracy"), [(1_000_000, 100_000), (0, 100_000), (0, 200)])
def test_quantiles_by_brute_force(spark, limit, accuracy):
    """Built-in on counts, groups ranked whole, and groups that exceed the sketch."""
    random = np.random.default_rng(5)
    groups = {
        "smooth": random.normal(0, 1e4, 5000).round(3),
        "ties": random.integers(0, 4, 3000).astype(float),
        "tiny": np.array([5.0, 1.0]),
        "heavy": np.where(random.random(4000) < 0.4, 0.0, random.lognormal(3, 2, 4000)),
    }
    data = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None), (None, 1.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]
    out = {
        r.g: list(r.q)
        for r in quantiles.group_quantiles(
            df, "v", probs, ["g"], accuracy=accuracy, distinct_limit=limit
        ).collect()
    }
    assert out.keys() == groups.keys()
    for g, values in groups.items():
        assert out[g] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12, abs=1e-12), g


def test_column_quantiles_match_percentile(spark):
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    columns = ["l_extendedprice", "l_quantity", "l_tax"]
    out = {r["column"]: list(r.q) for r in quantiles.column_quantiles(lines, columns, [0.25, 0.5, 0.99]).collect()}
    want = lines.agg(*[F.percentile(c, [0.25, 0.5, 0.99]).alias(c) for c in columns]).first()
    for c in columns:
        assert out[c] == pytest.approx(list(want[c]), rel=1e-12)


def test_wide_label_domain(spark, monkeypatch):
    words = spark.range(500).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("s"))
    want = {w: i for i, w in enumerate(sorted(f"w{i}" for i in range(500)))}
    monkeypatch.setattr(encode, "bounded", lambda df: (df, False))
    got = {r["s"]: r["_code"] for r in encode.sorted_codes(words, "s").collect()}
    assert got == want


def test_lookup_join_beyond_the_limit(spark, rows):
    df = spark.createDataFrame([(i % 5, i) for i in range(20)], "k int, v int")
    table = spark.createDataFrame([(i, i * 10) for i in range(4)], "k int, t int")
    small = lookup.lookup_join(df, table, "k")
    large = lookup.lookup_join(df, table, "k", max_rows=2)
    assert rows(small) == rows(large) and small.count() == 20


def test_split_of_a_dominant_label(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 50 == 0).cast("int").alias("y"))
    train, cv = stratified_split(df, "y", "id", 0.2, seed=1)
    assert {r.y: r["count"] for r in train.groupBy("y").count().collect()} == {0: 23520, 1: 480}
    assert cv.count() == 6000


@pytest.mark.parametrize("max_prints", [0, 50_000])
def test_only_repeated_rows_move(spark, rows, max_prints):
    """Whole rows and keys, with missing fields in different places, whether the repeated prints are a short list or not."""
    values = [(1, None, "a"), (None, 1, "a"), (1, None, "a"), (2, 2, "b"), (2, 2, "c"), (3, 3, "d"), (0, 0, "e")]
    df = spark.createDataFrame(values, "k int, l int, v string").repartition(3)
    whole = duplicates.duplicate_rows(df, max_prints)
    assert rows(duplicates.expand_copies(whole)) == [(1, None, "a")]
    want = [(1, None, "a"), (2, 2, "c")]
    assert rows(duplicates.duplicate_keys(df, ["k", "l"], ["v"], max_prints=max_prints)) == want
    assert rows(duplicates.duplicate_keys(df, ["k", "l"], ["v"], min_hot_rows=2, max_prints=max_prints)) == want
    assert duplicates.duplicate_keys(df.limit(0), ["k", "l"], ["v"], max_prints=max_prints).count() == 0
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftSemi" in plan) == (max_prints > 0)


def test_folds_are_exact_within_labels(spark):
    data = [(i, i % 10 == 0, None) for i in range(1003)] + [(5000 + i, None, None) for i in range(7)]
    df = spark.createDataFrame(data, "id long, y boolean, z int").repartition(5)
    for folds, order in ((3, None), (10, None), (4, F.lit(1).cast("long")), (2, F.col("id") % 2)):
        extra = {} if order is None else {"order": order, "order_max": 2}
        got = stratified_folds(df, "y", "id", folds, **extra)
        assert got.columns == ["id", "y", "z", "fold"]
        sizes = {}
        for r in got.groupBy("y", "fold").count().collect():
            sizes.setdefault(r["y"], []).append(r["count"])
        assert set(sizes) == {True, False} and all(len(s) == folds and max(s) - min(s) <= 1 for s in sizes.values())
        assert got.count() == 1003
    few = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, y int")
    found = stratified_folds(few, "y", "id", 5).collect()
    assert len(found) == 3 and len({r.fold for r in found if r.y == 0}) == 2 and all(0 <= r.fold < 5 for r in found)
    again = stratified_folds(few.repartition(3), "y", "id", 5).collect()
    assert sorted(found) == sorted(again) and stratified_folds(few.limit(0), "y", "id", 5).collect() == []


def test_bands_read_a_table_with_hot_keys_once(spark, tmp_path):
    """A key with a third of the rows, its variance over many tasks, missing offsets and a segment without rows."""
    data = [(7 if i % 3 else i, float(i % 11) + 1e5, -(i % 500) if i % 17 else None, "x" if i % 2 else None, i) for i in range(6000)]
    spark.createDataFrame(data, "k int, v double, age int, s string, unread int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).drop("unread")
    spec = AggSpec({"v": ["min", "max", "mean", "sum", "var", "count", "size"]})
    block = Block.of(spec, prefix="A_", segments={"X_": (spec, "s = 'x'"), "N_": (spec, "s = 'none'")}, count_as="N")
    built = {
        (s, len(h)): recency_features(df, "k", "age", DAY_SLICES, block, s, h)
        for s, h in (("naive", []), ("bands", []), ("bands", [7]), ("bands", [7, 3, 6]))
    }
    want = cut(built["naive", 0])
    assert all(cut(b) == want for b in built.values())
    hot = built["bands", 1]
    hot.collect()
    plan = plan_of(hot)
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final and "unread" not in final
    # The halves share the one exchange of the rows; only the few states of hot keys are shuffled again.
    assert final.count("- Exchange hashpartitioning(_place") == 1
    with pytest.raises(ValueError, match="does not merge"):
        recency_features(df, "k", "age", DAY_SLICES, Block.of(AggSpec({"v": ["nunique"]})), "bands", [])


def _pairwise(frame):
    """Correlations by pandas, undefined where a column has one value on the shared rows."""
    want = frame.corr().to_numpy()
    seen = frame.notna().to_numpy()
    for i in range(frame.shape[1]):
        for j in range(i):
            both = seen[:, i] & seen[:, j]
            if any(frame.iloc[both, c].nunique() < 2 for c in (i, j)):
                want[i, j] = want[j, i] = np.nan
    return want


@pytest.mark.parametrize("sum_bytes", [48 * 9, 48 * 64])
def test_correlation_in_tiles(spark, monkeypatch, sum_bytes):
    """Any tile width and any step give the correlations of plain pairs; hardly varying, constant and empty columns too."""
    import pandas as pd

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 11))
    x[:, 1] = 2 * x[:, 0] + 0.1 * x[:, 1]
    x[:, 2] += 1e9
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 7], x[:, 8] = 4.25, np.nan
    x[:, 9] = np.where(np.isnan(x[:, 3]), x[:, 9], 0.1)  # constant wherever column 3 is known
    x[5, 10] = np.inf
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(11)])
    monkeypatch.setattr(correlation, "_STEP_BYTES", 700)
    monkeypatch.setattr(correlation, "_AGAIN", 3)
    df = spark.createDataFrame(frame).repartition(5)
    found = correlation.correlations(df, sum_bytes=sum_bytes).collect()
    assert len(found) == len({(r.col_a, r.col_b) for r in found}) == 55
    want = _pairwise(frame.replace(np.inf, np.nan).assign(c2=frame.c2 - 1e9))
    for r in found:
        a, b = int(r.col_a[1:]), int(r.col_b[1:])
        assert a < b
        if np.isnan(want[a, b]):
            assert r.r is None, (a, b)
        else:
            assert r.r == pytest.approx(want[a, b], abs=1e-9)


def test_correlation_of_the_wide_matrix(spark, roles, tmp_path):
    """Every numeric column of the matrix, in tiles whose sums stay within a bound, against numpy on the same rows."""
    path = str(tmp_path / "matrix")
    sources = matrix.Sources(roles.bureau, roles.bureau_balance, roles.previous, roles.pos, roles.instalments, roles.card)
    train, _ = matrix.train_matrix(roles.application, matrix.side_blocks(sources))
    train.write.parquet(path)
    stored = spark.read.parquet(path)
    columns = correlation.numeric_columns(stored)
    assert len(columns) > 1000
    bound = 8 << 20
    found = correlation.correlations(stored, columns, sum_bytes=bound).toPandas()
    assert len(found) == len(columns) * (len(columns) - 1) // 2
    x = stored.select(*columns).toPandas().astype(float)
    place = {c: i for i, c in enumerate(columns)}
    a, b = found.col_a.map(place).to_numpy(), found.col_b.map(place).to_numpy()
    assert (a < b).all() and len(set(zip(a, b))) == len(found)
    full = [c for c in columns if x[c].notna().all() and x[c].nunique() > 1 and np.isfinite(x[c]).all()]
    want = np.corrcoef(x[full].to_numpy().T)
    got = np.full((len(columns), len(columns)), np.nan)
    got[a, b] = found.r.to_numpy(dtype=float)
    places = [place[c] for c in full]
    upper = np.triu_indices(len(full), 1)
    np.testing.assert_allclose(got[np.ix_(places, places)][upper], want[upper], atol=1e-8)
    values = np.abs(got[~np.isnan(got)])
    assert values.max() <= 1 + 1e-9


@pytest.mark.parametrize("ranked", [1, 40, 5_000_000])
def test_quantiles_of_a_whole_table(spark, monkeypatch, ranked):
    """Narrow sketches and brackets that must be cut again give numpy's quantiles of every column."""
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 20_000
    frame = pd.DataFrame(
        {
            "normal": rng.normal(size=n) * 1e6,
            "ties": rng.integers(0, 3, n).astype(float),
            "spike": np.where(rng.random(n) < 0.97, 7.0, rng.random(n)),
            "gaps": np.where(rng.random(n) < 0.4, np.nan, rng.exponential(size=n)),
            "single": 5.0,
            "few": [1.5, 2.5, 9.0, 9.5] + [np.nan] * (n - 4),
            "none": np.full(n, np.nan),
        }
    )
    df = spark.createDataFrame(frame).repartition(6).withColumns({"text": F.lit("a"), "whole": F.col("ties").cast("int")})
    monkeypatch.setattr(table_profile, "_LEAST_SIZE", 64)
    made = table_profile.TableProfile(df, size=64)
    probs = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]
    found = made.quantiles(probs, ranked)
    frame["whole"] = frame["ties"]
    assert list(found) == list(frame)
    for c in frame:
        values = frame[c].dropna()
        want = [None] * len(probs) if values.empty else [pytest.approx(float(np.quantile(values, p)), rel=1e-12) for p in probs]
        assert found[c] == want, c
    assert made.constants() == ["single", "none", "text"] and made.shape == (n, 9)
    assert [tuple(r) for r in made.missing().collect()][:2] == [
        ("none", "double", n, 100.0), ("few", "double", n - 4, 99.98)
    ]


def test_profile_mends_brackets_and_empty_tables(spark, monkeypatch):
    """Brackets that miss their ranks are widened; infinities and a table without rows have a profile."""
    df = spark.range(5_000).selectExpr("cast(id * 7919 % 5000 as double) AS v", "if(id = 3, double('Infinity'), id) AS w", "'x' AS `a.b`")
    wrong = {(c, j): table_profile._Bracket(4_998.5, 4_998.6, 1) for c in "vw" for j in range(2)}
    monkeypatch.setattr(table_profile.TableProfile, "_first_brackets", lambda *a: dict(wrong))
    for ranked in (10, 10**6):
        assert table_profile.TableProfile(df).quantiles([0.25, 0.5], ranked) == {"v": [1249.75, 2499.5], "w": [1250.75, 2500.5]}
    monkeypatch.undo()
    assert table_profile.TableProfile(df).quantiles([0.0, 1.0]) == {"v": [0.0, 4999.0], "w": [0.0, float("inf")]}
    empty = table_profile.TableProfile(df.limit(0))
    assert empty.shape == (0, 3) and empty.constants() == ["v", "w", "a.b"] and empty.missing().count() == 0
    assert [tuple(r) for r in empty.check([0.5]).collect()] == [("v", "double", 0, None), ("w", "double", 0, None), ("a.b", "string", 0, None)]
    assert empty.describe([0.5]).first()["count"] == 0


@pytest.mark.parametrize("hot", [[], [1]])
def test_tasks_of_recency_go_by_rows(spark, monkeypatch, hot):
    df = spark.range(6000).selectExpr("id % 50 AS k", "-CAST(id % 400 AS INT) AS age", "CAST(id % 7 AS INT) AS v")
    block = Block.of(AggSpec({"v": ["sum", "max"]}))
    few = {s: recency_features(df, "k", "age", DAY_SLICES, block, s, hot) for s in ("tagged", "bands")}
    few["all"] = recency.roll_up(df, "k", block, hot)
    want = {s: sorted(map(tuple, f.collect())) for s, f in few.items()}
    monkeypatch.setattr(recency, "ROWS_PER_TASK", 500)
    many = {s: recency_features(df, "k", "age", DAY_SLICES, block, s, hot, rows=6000) for s in ("tagged", "bands")}
    many["all"] = recency.roll_up(df, "k", block, hot)
    for s, f in many.items():
        # 12 tasks of 500 rows, a multiple of the session's 4 partitions.
        assert f.rdd.getNumPartitions() >= 12, s
        assert sorted(map(tuple, f.collect())) == want[s], s


def test_models_spread_their_rows(spark, roles, monkeypatch):
    """150 applicants of one file in 5 tasks; scores from counts stay what they were, and every fit reads part of the rows a task."""
    from loanloom.catalog import binned_models, learning
    from loanloom.operators import spread as spreading

    assert learning._vectors(roles).rdd.getNumPartitions() == 1
    want = sorted(binned_models._base(roles).collect())
    monkeypatch.setattr(spreading, "ROWS_PER_TASK", 30)
    data = learning._vectors(roles)
    parts = [[r["SK_ID_CURR"] for r in p] for p in data.rdd.glom().collect()]
    assert len(parts) == 5 and max(map(len, parts)) < 60 and all(p == sorted(p) for p in parts)
    assert sorted(k for p in parts for k in p) == sorted(r[0] for r in roles.application.select("SK_ID_CURR").collect())
    assert binned_models._rows(roles, 0).rdd.getNumPartitions() == 5
    assert sorted(binned_models._base(roles).collect()) == want
    folded = sorted(binned_models._rows(roles, 3).select("SK_ID_CURR", "fold").collect())
    monkeypatch.undo()
    assert sorted(binned_models._rows(roles, 3).select("SK_ID_CURR", "fold").collect()) == folded


def test_payment_sums_ship_rows_once(spark, tmp_path):
    """Missing keys and payments, hot and cold keys; rows that lie by loan already are not shuffled again."""
    df = spark.range(0, 9000, 1, 4).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 11 > 0 THEN id % 900 END AS p", "CAST(nullif(id % 5, 4) AS INT) AS n",
        "CASE WHEN id % 2 = 0 THEN CAST(id AS DOUBLE) END AS v", "id",
    )
    stats = {"s": F.sum("v"), "c": F.count("v")}
    want = cut(attach.attach_stats(df, ["p", "n"], stats))
    cold = attach.attach_stats_in_place(df, ["p", "n"], stats)
    hot = attach.attach_stats_in_place(df, ["p", "n"], stats, min_hot_rows=500)
    assert cut(cold) == want and cut(hot) == want
    assert "Union" in plan_of(hot) and "Union" not in plan_of(cold)
    paid = df.selectExpr("p AS SK_ID_PREV", "n AS NUM_INSTALMENT_NUMBER", "v AS AMT_PAYMENT")
    assert plan_of(instalments.attach_payment_sum(paid)).count("Exchange hashpartitioning") == 1
    assert plan_of(instalments.attach_payment_sum(paid.repartition(5, "SK_ID_PREV"))).count("Exchange hashpartitioning") == 1
