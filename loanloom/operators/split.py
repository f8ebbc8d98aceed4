"""M1: exact stratified split and deterministic folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.operators.lookup import lookup_join

_BUCKETS = 65_536


def hash_order(key: str, seed: int = 0) -> Column:
    """A pseudo-random non-negative order for rows, the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 1)


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    test_share: float = 0.20,
    seed: int = 0,
    order: Column | None = None,
    order_max: int = 2**63,
) -> tuple[DataFrame, DataFrame]:
    """Train and held-out rows with the same share of every label, exact to the row.

    The n-th smallest hash of each label is found through a histogram of the
    hash (bounded per label) and a ranking of the one bucket it falls in, so a
    dominant label is never sorted in one task. ``key`` breaks ties and must be
    unique; ``order`` must lie in ``[0, order_max)``. Rows without a label cannot be
    stratified and are on neither side.
    """
    df = df.where(F.col(label).isNotNull())
    marked = df.withColumn("_h", hash_order(key, seed) if order is None else order)
    bucket = F.floor(F.col("_h") / F.lit(float(order_max)) * _BUCKETS)
    slim = marked.select(label, F.col(key).alias("_k"), "_h", bucket.alias("_b"))
    by_label = Window.partitionBy(label)
    upto = by_label.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    histogram = (
        slim.groupBy(label, "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_to", F.sum("_c").over(upto))
        .withColumn("_want", F.round(F.sum("_c").over(by_label) * (1 - test_share)))
    )
    before = F.col("_to") - F.col("_c")
    boundary = histogram.where((before < F.col("_want")) & (F.col("_want") <= F.col("_to"))).select(
        label, F.col("_b").alias("_edge"), (F.col("_want") - before).alias("_nth")
    )
    inside = lookup_join(slim, boundary, label, how="inner").where(F.col("_b") == F.col("_edge"))
    place = F.row_number().over(by_label.orderBy("_h", "_k"))
    last = inside.withColumn("_place", place).where(F.col("_place") == F.col("_nth")).select(
        label, F.struct("_h", "_k").alias("_last")
    )
    tagged = lookup_join(marked, last, label)
    train = F.coalesce(F.struct("_h", F.col(key).alias("_k")) <= F.col("_last"), F.lit(False))
    return (
        tagged.where(train).select(*df.columns),
        tagged.where(~train).select(*df.columns),
    )


def stratified_folds(
    df: DataFrame,
    label: str,
    key: str,
    folds: int = 3,
    seed: int = 0,
    order: Column | None = None,
    order_max: int = 2**63,
    column: str = "fold",
) -> DataFrame:
    """M7: fold number 0..folds-1, of sizes that differ by at most one within every label.

    The cut points of all folds come out of one histogram of the hash per label; only the buckets they fall in are
    ranked, as in ``stratified_split``. ``key`` breaks ties and must be unique. Rows without a label are in no fold and go.
    """
    df = df.where(F.col(label).isNotNull())
    marked = df.withColumn("_h", hash_order(key, seed) if order is None else order)
    slim = marked.select(label, F.col(key).alias("_k"), "_h", F.floor(F.col("_h") / F.lit(float(order_max)) * _BUCKETS).alias("_b"))
    by_label = Window.partitionBy(label)
    upto = by_label.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    histogram = (
        slim.groupBy(label, "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
        .withColumn("_n", F.sum("_c").over(by_label))
    )
    # The last row of fold i - 1 is the label's n * i / folds-th, which lies in one bucket.
    wanted = F.transform(F.sequence(F.lit(1), F.lit(folds - 1)), lambda i: F.floor(F.col("_n") * i / F.lit(folds)) - F.col("_before"))
    cuts = histogram.withColumn("_nth", F.filter(wanted, lambda n: (n > 0) & (n <= F.col("_c")))).where(F.size("_nth") > 0)
    cuts = cuts.select(label, "_b", "_nth")
    inside = lookup_join(slim, cuts, [label, "_b"], how="inner")
    placed = inside.withColumn("_place", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", "_k")))
    hits = F.size(F.filter("_nth", lambda n: n == F.col("_place")))
    lasts = placed.where(hits > 0).groupBy(label).agg(F.flatten(F.collect_list(F.array_repeat(F.struct("_h", "_k"), hits))).alias("_lasts"))
    # A cut before the first row is the end of no row, so every row of the label lies beyond it.
    tagged = lookup_join(marked, lasts, label)
    known = F.coalesce("_lasts", F.array())
    beyond = F.size(F.filter(known, lambda last: last < F.struct(F.col("_h"), F.col(key).alias("_k"))))
    return tagged.select(*df.columns, (F.lit(folds - 1) - F.size(known) + beyond).cast("int").alias(column))


def with_fold(df: DataFrame, key: str, folds: int = 3, seed: int = 0, column: str = "fold") -> DataFrame:
    """M7: fold number 0..folds-1 from a hash of the key."""
    return df.withColumn(column, F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)).cast("int"))
