"""Trees and cards out of bin counts against models fitted on rows one fold at a time."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loanloom.operators import binned
from loanloom.operators.binned import ALL, SplitSetting
from loanloom.operators.split import stratified_folds

FEATURES = ["a", "b", "flat", "void"]
SCHEMA = "id long, y int, a double, b double, flat double, void double, fold_note string"


def table():
    rng = random.Random(5)
    odd = [None, math.nan, math.inf, -math.inf]
    rows = []
    for i in range(240):
        y = rng.choice([0, 0, 1])
        a = rng.choice(odd) if i % 11 == 0 else rng.gauss(y, 1)
        rows.append((i, None if i % 40 == 7 else y, a, float(rng.randrange(6)), 3.0, None, "x"))
    return rows


@pytest.fixture(scope="module")
def placed(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    bins = binned.fit_bins(df, FEATURES, 8)
    rows = binned.binned(stratified_folds(df, "y", "id", 4), bins, ["id", "y", "fold"]).persist()
    return rows, [(r.id, r.y, r.fold, list(r["_bins"])) for r in rows.collect()]


def auc(pairs):
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in ones for n in zeros) / (len(ones) * len(zeros))


def gini(rows):
    share = sum(r[1] for r in rows) / len(rows)
    return 2 * share * (1 - share)


def best_tree(train, least_share):
    best = (0, -1, None)
    for place in range(len(FEATURES)):
        for cut in sorted({r[3][place] for r in train})[:-1]:
            left, right = [r for r in train if r[3][place] <= cut], [r for r in train if r[3][place] > cut]
            if min(len(left), len(right)) >= least_share * len(train):
                gain = gini(train) - (len(left) * gini(left) + len(right) * gini(right)) / len(train)
                best = min(best, (-math.floor(gain * 1e9 + 0.41421356), place, cut))
    return best


def share(rows):
    return sum(r[1] for r in rows) / len(rows)


def test_bins_take_every_value(spark, placed):
    rows, local = placed
    assert all(b[2] == 1 and b[3] == 0 and 0 <= b[0] <= 8 for _, _, _, b in local)
    odd = {r[0] for r in table() if r[2] is None or not math.isfinite(r[2])}
    assert {i for i, _, _, b in local if b[0] == 0} == odd & {i for i, *_ in local}
    beyond = spark.createDataFrame([(1, 1, 1e300, -1e300, 9.0, 1.0, "")], SCHEMA)
    bins = binned.fit_bins(spark.createDataFrame(table(), SCHEMA), FEATURES, 8)
    assert binned.binned(beyond, bins, ["id"]).first()["_bins"] == [8, 1, 1, 1]


@pytest.mark.parametrize("least", [0.0, 0.3])
def test_trees_match_rows(placed, least):
    rows, local = placed
    counts = binned.count_bins(rows, "y", 4)
    got = {r.fold: r for r in binned.cross_validate_splits(counts, [SplitSetting("gini", least)], FEATURES).collect()}
    assert len(got) == 4
    for fold, r in got.items():
        train, held = [x for x in local if x[2] != fold], [x for x in local if x[2] == fold]
        _, place, cut = best_tree(train, least)
        assert (r.feature, r.cut) == (FEATURES[place], cut)
        scores = [share([x for x in train if (x[3][place] <= cut) == side]) for side in (True, False)]
        for name, side in (("train_auc", train), ("roc_auc", held)):
            assert r[name] == pytest.approx(auc([(scores[0 if x[3][place] <= cut else 1], x[1]) for x in side]))
        right = [(scores[0 if x[3][place] <= cut else 1] > 0.5) == bool(x[1]) for x in held]
        assert r.accuracy == pytest.approx(sum(right) / len(right))


def test_no_split_where_none_is_allowed(placed):
    rows, local = placed
    counts = binned.count_bins(rows, "y", 4)
    got = binned.cross_validate_splits(counts, [SplitSetting("entropy", 0.6)], FEATURES).collect()
    assert len(got) == 4 and all(r.feature is None and r.cut is None and r.roc_auc == 0.5 and r.train_auc == 0.5 for r in got)


def test_cards_match_rows(placed):
    rows, local = placed
    counts = binned.count_bins(rows, "y", 4)
    got = {r.id: r.points for r in binned.card_points(rows, binned.fit_cards(counts)).collect()}
    kinds = [len({x[3][p] for x in local}) for p in range(len(FEATURES))]
    for i, _, fold, own in local:
        train = [x for x in local if x[2] != fold]
        ones, zeros = sum(x[1] for x in train), sum(1 - x[1] for x in train)
        points = math.floor(1000 * math.log((ones + 1) / (zeros + 1)) + 0.41421356)
        for place, b in enumerate(own):
            y = [x[1] for x in train if x[3][place] == b]
            odds = math.log((sum(y) + 1) / (ones + kinds[place])) - math.log((len(y) - sum(y) + 1) / (zeros + kinds[place]))
            points += math.floor(1000 * odds + 0.41421356)
        assert got[i] == points
    scores = {r.fold: r for r in binned.cross_validate_card(rows, binned.fit_cards(counts), "y").collect()}
    for fold, r in scores.items():
        assert r.roc_auc == pytest.approx(auc([(got[i], y) for i, y, f, _ in local if f == fold]))


def test_empty_table_and_plain_labels(spark, placed):
    rows, _ = placed
    none = rows.where("false")
    counts = binned.count_bins(none, "y", 4)
    assert counts.count() == 0 and binned.cross_validate_splits(counts, [SplitSetting()], FEATURES).count() == 0
    assert binned.base_scores(none.drop("fold"), binned.count_bins(none, "y"), FEATURES).collect() == []
    ones = rows.where("y = 1")
    only = binned.cross_validate_splits(binned.count_bins(ones, "y", 4), [SplitSetting()], FEATURES).collect()
    assert all(r.roc_auc is None and r.accuracy == 1.0 and r.feature is None for r in only)
    both = binned.base_scores(rows.drop("fold"), binned.count_bins(rows, "y"), FEATURES)
    assert both.where("score_split BETWEEN 0 AND 1 AND score_card BETWEEN 0 AND 1").count() == rows.count()
    with pytest.raises(ValueError):
        SplitSetting("none")


def test_scores_read_no_row_twice(placed):
    """Rows are shuffled once, as counts; everything about trees follows from those."""
    rows, _ = placed
    counts = binned.count_bins(rows, "y", 4)
    plan = binned.search_splits(counts, [SplitSetting("gini", s / 10) for s in range(5)], FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1 or plan.count("Scan ") == 1
    assert ALL not in {r.fold for r in binned.cross_validate_splits(counts, [SplitSetting()], FEATURES).select("fold").collect()}
