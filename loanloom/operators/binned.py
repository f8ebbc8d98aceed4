"""M5, M7-M9, M11, M12 on binned features: all settings and folds out of one pass over the rows.

Rows are counted once by (fold, feature, bin, label). The training side of a fold is the total less the fold, so
single-split trees of every setting are grown, judged and compared on these counts alone; their number is bounded by
folds, features and bins, and combined on the map side. Scorecards (smoothed log odds per bin, as whole points) come from the same counts;
one more pass gives every row the points of the card that was fitted without its fold.

Bins have equal width between a column's extremes. Bin 0 holds missing values (NULL, NaN, infinities), and values beyond the extremes of the
fitted rows fall in the outermost bins. A column without values has only bin 0; a constant one only bins 0 and 1. Labels
are 0 and 1; rows without a label are in no fold and take no part. An empty table has no folds, cards or scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions.expr import safe_div
from loanloom.operators.lookup import bounded, lookup_join

# The fold of what is fitted on all rows.
ALL = -1
# Gains and points are cut to whole numbers at a boundary that simple fractions never lie on.
_SHIFT = 0.41421356
_GAIN_UNIT = 1e9
# Arrays here are never empty. The outer forms of explode spare the optimizer a filter on them, whose consequences it takes minutes to infer.


@dataclass(frozen=True)
class Bins:
    """Extremes of the features, and the number of bins between them."""

    low: dict[str, float | None]
    high: dict[str, float | None]
    number: int

    @property
    def features(self) -> list[str]:
        return list(self.low)

    def of(self, feature: str) -> Column:
        x, low, high = _finite(feature), self.low[feature], self.high[feature]
        if low is None or low == high:
            return F.when(x.isNull(), 0).otherwise(1)
        place = (x - low) / F.lit(high - low) * F.lit(float(self.number))
        inside = F.greatest(F.lit(0.0), F.least(place, F.lit(self.number - 1.0)))  # before it is cut, since it may exceed a long
        return F.when(x.isNull(), 0).otherwise(F.floor(inside).cast("int") + 1)


@dataclass(frozen=True)
class SplitSetting:
    """How a single-split tree is grown: its impurity, and the least share of the rows on either side."""

    impurity: str = "gini"
    least_share: float = 0.0

    def __post_init__(self):
        if self.impurity not in ("gini", "entropy"):
            raise ValueError(f"impurity {self.impurity!r} is neither gini nor entropy")


def _finite(feature: str) -> Column:
    x = F.col(feature).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def fit_bins(df: DataFrame, features: Sequence[str], number: int = 32) -> Bins:
    """Extremes of all features in one aggregate."""
    found = df.agg(*[F.min(_finite(c)).alias(f"low_{i}") for i, c in enumerate(features)],
                   *[F.max(_finite(c)).alias(f"high_{i}") for i, c in enumerate(features)]).first()
    return Bins({c: found[f"low_{i}"] for i, c in enumerate(features)}, {c: found[f"high_{i}"] for i, c in enumerate(features)}, number)


def binned(df: DataFrame, bins: Bins, keep: Sequence[str]) -> DataFrame:
    """The kept columns and ``_bins``, the bins of the features in their order."""
    return df.select(*keep, F.array(*[bins.of(c) for c in bins.features]).alias("_bins"))


def count_bins(rows: DataFrame, label: str, folds: int = 0) -> DataFrame:
    """Per fold, feature and bin the rows and positives in the fold (``h_``) and on its training side (``t_``).

    ``rows`` come from ``binned`` with the label and, for folds, a column ``fold``. Fold ``ALL`` trains on all rows and
    holds none. Rows without a label are left out.
    """
    fold = ["fold"] if folds else []
    single = rows.where(F.col(label).isNotNull()).select(*fold, F.col(label).cast("long").alias("_y"), F.posexplode_outer("_bins").alias("place", "bin"))
    own = [(F.count_if(F.col("fold") == i).alias(f"n{i}"), F.sum(F.when(F.col("fold") == i, F.col("_y")).otherwise(0)).alias(f"p{i}"))
           for i in range(folds)]
    totals = single.groupBy("place", "bin").agg(F.count("_y").alias("n"), F.sum("_y").alias("p"), *[c for pair in own for c in pair])

    def side(fold: int, n: Column, p: Column) -> Column:
        return F.struct(F.lit(fold).alias("fold"), n.alias("h_n"), p.alias("h_p"), (F.col("n") - n).alias("t_n"), (F.col("p") - p).alias("t_p"))

    none = F.lit(0).cast("long")
    sides = F.array(side(ALL, none, none), *[side(i, F.col(f"n{i}"), F.col(f"p{i}")) for i in range(folds)])
    return totals.select("place", "bin", F.inline_outer(sides))


# --- single-split trees -----------------------------------------------------------------------


def _impurity(n: Column, p: Column) -> Column:
    """Gini impurity or entropy, as the column ``impurity`` of the setting says."""
    gini = 2 * safe_div(p, n) * safe_div(n - p, n)
    entropy = F.lit(0.0)
    for part in (p, n - p):
        entropy -= F.when(part > 0, safe_div(part, n) * F.log2(safe_div(part, n))).otherwise(0.0)
    return F.when(F.col("impurity") == "gini", gini).otherwise(entropy)


def _candidates(counts: DataFrame, settings: Sequence[SplitSetting]) -> DataFrame:
    """Every split of every fold and setting with its gain, and the tree without a split (``place`` -1)."""
    group = Window.partitionBy("fold", "place")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    names = ("h_n", "h_p", "t_n", "t_p")
    summed = counts.select(
        "fold", "place", "bin", *[F.sum(c).over(upto).alias(f"{c}_l") for c in names], *[F.sum(c).over(group).alias(c) for c in names],
        (F.max("bin").over(group) == F.col("bin")).alias("_last"),
    )
    n, p, left, left_p = (F.col(c) for c in ("t_n", "t_p", "t_n_l", "t_p_l"))
    each = [F.struct(F.lit(i).alias("setting"), F.lit(s.impurity).alias("impurity"), F.lit(float(s.least_share)).alias("least"))
            for i, s in enumerate(settings)]
    least = n * F.col("least")
    splits = (left > 0) & (left < n) & (left >= least) & (n - left >= least)
    whole = F.col("_last") & (F.col("place") == 0)
    # All rows to one side is the tree without a split; the last bin of one feature stands for it.
    found = summed.select("*", F.inline_outer(F.array(*each))).where(whole | ~F.col("_last") & splits)
    after = safe_div(left, n) * _impurity(left, left_p) + safe_div(n - left, n) * _impurity(n - left, p - left_p)
    gain = F.floor((_impurity(n, p) - after) * _GAIN_UNIT + _SHIFT)
    return found.withColumn("gain", F.when(F.col("_last"), 0).otherwise(gain)).withColumn(
        "place", F.when(F.col("_last"), -1).otherwise(F.col("place"))
    )


_SIDES = ["h_n", "h_p", "t_n", "t_p", "h_n_l", "h_p_l", "t_n_l", "t_p_l"]


def best_splits(counts: DataFrame, settings: Sequence[SplitSetting], features: Sequence[str]) -> DataFrame:
    """The split of the highest gain per fold and setting, ties to the earlier feature and lower bin.

    ``feature`` and ``cut`` (bins up to it go left) are NULL where no split gains anything; ``score_left`` and
    ``score_right`` are the shares of positives on the training side.
    """
    best = F.min(F.struct((-F.col("gain")).alias("loss"), "place", "bin", *_SIDES)).alias("_b")
    found = _candidates(counts, settings).groupBy("fold", "setting").agg(best).select("fold", "setting", "_b.*")
    split = F.col("place") >= 0
    left = safe_div(F.col("t_p_l"), F.col("t_n_l"))
    right = F.when(split, safe_div(F.col("t_p") - F.col("t_p_l"), F.col("t_n") - F.col("t_n_l"))).otherwise(left)
    names = F.array(*map(F.lit, features))
    return found.select(
        "fold", "setting", F.when(split, F.element_at(names, F.when(split, F.col("place") + 1).otherwise(1))).alias("feature"),
        F.when(split, F.col("bin")).alias("cut"), (-F.col("loss") / _GAIN_UNIT).alias("gain"),
        left.alias("score_left"), right.alias("score_right"), *_SIDES,
    )


def _split_auc(side: str) -> Column:
    """Area under the ROC curve of a tree with two leaves, out of its counts; ties count half."""
    n, p, left, left_p = (F.col(c) for c in (f"{side}_n", f"{side}_p", f"{side}_n_l", f"{side}_p_l"))
    right, right_p = n - left, p - left_p
    up = F.col("score_left") > F.col("score_right")
    even = F.col("score_left") == F.col("score_right")
    won = F.when(up, left_p * (right - right_p)).otherwise(right_p * (left - left_p))
    tied = left_p * (left - left_p) + right_p * (right - right_p)
    return F.when(even & (p * (n - p) > 0), 0.5).otherwise(safe_div(won + tied / 2, p * (n - p)))


def cross_validate_splits(counts: DataFrame, settings: Sequence[SplitSetting], features: Sequence[str]) -> DataFrame:
    """M7: the tree of every fold and setting, its AUC on the training side, and AUC, accuracy and F1 on the fold held out.

    A fold with one class has no AUC; one without rows no accuracy. F1 is 0 where nothing is or should be found.
    """
    trees = best_splits(counts.where(F.col("fold") != ALL), settings, features)
    left, right = F.col("score_left") > 0.5, F.col("score_right") > 0.5
    n_l, p_l, n_r, p_r = F.col("h_n_l"), F.col("h_p_l"), F.col("h_n") - F.col("h_n_l"), F.col("h_p") - F.col("h_p_l")
    guessed = F.when(left, n_l).otherwise(0) + F.when(right, n_r).otherwise(0)
    hit = F.when(left, p_l).otherwise(0) + F.when(right, p_r).otherwise(0)
    right_ones = hit + (F.col("h_n") - F.col("h_p")) - (guessed - hit)
    return trees.select(
        "fold", "setting", "feature", "cut", _split_auc("t").alias("train_auc"), _split_auc("h").alias("roc_auc"),
        safe_div(right_ones, F.col("h_n")).alias("accuracy"),
        F.coalesce(safe_div(2 * hit, guessed + F.col("h_p")), F.lit(0.0)).alias("f1"),
    )


def search_splits(counts: DataFrame, settings: Sequence[SplitSetting], features: Sequence[str]) -> DataFrame:
    """M8: mean accuracy of every setting over the folds, and its rank (ties to the earlier setting)."""
    means = cross_validate_splits(counts, settings, features).groupBy("setting").agg(F.avg("accuracy").alias("accuracy"))
    table = F.array(*[F.struct(F.lit(s.impurity).alias("impurity"), F.lit(float(s.least_share)).alias("least_share")) for s in settings])
    told = F.element_at(table, F.col("setting") + 1)
    # As many rows as there are settings; equal means must not be told apart by their last digit.
    order = Window.orderBy(F.floor(F.col("accuracy") * _GAIN_UNIT + _SHIFT).desc(), "setting")
    return means.select("setting", told["impurity"].alias("impurity"), told["least_share"].alias("least_share"), "accuracy",
                        F.row_number().over(order).alias("place"))


def split_curve(counts: DataFrame, shares: Sequence[float], features: Sequence[str], impurity: str = "gini") -> DataFrame:
    """Mean AUC on the training sides and the folds held out per least share of a leaf."""
    settings = [SplitSetting(impurity, s) for s in shares]
    scores = cross_validate_splits(counts, settings, features)
    value = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("setting") + 1)
    return scores.groupBy(value.alias("value")).agg(F.avg("train_auc").alias("train_score"), F.avg("roc_auc").alias("valid_score"))


def split_importance(counts: DataFrame, features: Sequence[str], setting: SplitSetting = SplitSetting()) -> DataFrame:
    """Each feature's best gain on all rows, as a share of all features' gains. Features of one value have none."""
    found = _candidates(counts.where(F.col("fold") == ALL), [setting]).where(F.col("place") >= 0)
    gains = found.groupBy("place").agg(F.greatest(F.max("gain"), F.lit(0)).alias("gain"))
    names = F.array(*map(F.lit, features))
    share = safe_div(F.col("gain"), F.sum("gain").over(Window.partitionBy(F.lit(1))))  # one row a feature
    return gains.select(F.element_at(names, F.col("place") + 1).alias("feature"), share.alias("value"))


# --- scorecards -------------------------------------------------------------------------------


def fit_cards(counts: DataFrame, scale: float = 1000.0) -> DataFrame:
    """One card per fold: ``start`` points and ``points`` per place of a feature and bin, from its training side.

    Points are the smoothed log odds of a bin against those of all rows, in units of ``1 / scale``, cut to whole numbers, so
    sums do not depend on their order. A bin without training rows has the points of its smoothing alone.
    """
    group = Window.partitionBy("fold", "place")
    n, p, t_n, t_p, kinds = F.sum("t_n").over(group), F.sum("t_p").over(group), F.col("t_n"), F.col("t_p"), F.count("bin").over(group)
    odds = F.log((t_p + 1) / (p + kinds)) - F.log((t_n - t_p + 1) / (n - p + kinds))
    start = F.log((p + 1) / (n - p + 1))

    def whole(x: Column) -> Column:
        return F.floor(x * F.lit(float(scale)) + _SHIFT)

    each = counts.select("fold", "place", "bin", whole(odds).alias("points"), whole(start).alias("start"))
    by_feature = each.groupBy("fold", "place").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "points"))).alias("points"), F.max("start").alias("start")
    )
    return by_feature.groupBy("fold").agg(
        F.max("start").alias("start"), F.map_from_entries(F.collect_list(F.struct("place", "points"))).alias("points")
    )


def card_points(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows of ``binned`` with a ``fold`` and the whole ``points`` its card gives them; an unknown bin gives none.

    A row whose fold is ``ALL`` is scored by the card of all rows.
    """
    joined = lookup_join(rows, cards.withColumnRenamed("points", "_card"), "fold", how="inner")
    none = F.lit(0).cast("long")
    own = F.transform("_bins", lambda b, place: F.coalesce(F.element_at(F.element_at("_card", place), b), none))
    total = F.aggregate(own, F.col("start").cast("long"), lambda a, b: a + b)
    return joined.select(*[c for c in rows.columns if c != "_bins"], total.alias("points"))


def cross_validate_card(rows: DataFrame, cards: DataFrame, label: str) -> DataFrame:
    """M7: AUC, accuracy and F1 of every fold under the card fitted without it. Class 1 is above zero points.

    Rows are combined per fold and points before they are ranked; there are as many groups as different sums of points.
    """
    y = F.col(label) == 1
    groups = card_points(rows, cards).groupBy("fold", "points").agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    below = F.sum("n").over(Window.partitionBy("fold").orderBy("points").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    up = F.col("points") > 0
    sums = groups.withColumn("won", F.col("p") * (below + F.col("n") / 2)).groupBy("fold").agg(
        F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"),
        F.sum(F.when(up, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(up, F.col("n")).otherwise(0)).alias("fp"),
    )
    p, n, tp, fp = (F.col(c) for c in ("p", "n", "tp", "fp"))
    return sums.select(
        "fold", safe_div(F.col("won"), p * n).alias("roc_auc"), safe_div(tp + n - fp, p + n).alias("accuracy"),
        F.coalesce(safe_div(2 * tp, tp + fp + p), F.lit(0.0)).alias("f1"),
    )


def base_scores(rows: DataFrame, counts: DataFrame, features: Sequence[str], setting: SplitSetting = SplitSetting(), scale: float = 1000.0) -> DataFrame:
    """M5: scores in 0 to 1 of the tree and the card fitted on all rows, for rows of ``binned``; both only read counts to fit."""
    everyone = rows.withColumn("fold", F.lit(ALL))
    counts, _ = bounded(counts.where(F.col("fold") == ALL))  # at most features by bins, and read twice
    tree = best_splits(counts, [setting], features).first()
    if tree is None:
        return everyone.drop("fold", "_bins").select("*", F.lit(0.0).alias("score_split"), F.lit(0.0).alias("score_card")).limit(0)
    left = F.lit(True) if tree["feature"] is None else F.col("_bins")[list(features).index(tree["feature"])] <= tree["cut"]
    scored = everyone.withColumn("score_split", F.when(left, tree["score_left"]).otherwise(tree["score_right"]))
    pointed = card_points(scored, fit_cards(counts, scale))
    return pointed.withColumn("score_card", 1 / (1 + F.exp(-F.col("points") / scale))).drop("fold", "points")
