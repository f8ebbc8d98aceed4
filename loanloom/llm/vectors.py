"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes, learnt on a bounded sample (``SAMPLE_ROWS``) around its mean, gives every vector a balanced
binary code. Further codes are signs along random directions through the origin, where two vectors differ in a bit with a
probability that depends on their angle alone, whatever direction all vectors share. Codes are filed in several tables under
windows of their bits, no bit in two windows. Vectors that share a window are compared twice: first by the Hamming
distance of a random code, which rules most rows out while only codes have been shuffled, then the rows that are
left are reranked by the cosine of the original vectors in double precision.

Equal vectors are one class, compared once. A bucket of more than ``BLOCK`` classes is split into blocks and all pairs
of blocks become tasks of bounded size; what a task gives is a count of links per row and the components it
sees, never pairs. A pair is counted in the first table its codes share, so no pair counts twice.

The windows widen with the largest group compared, so that buckets stay small, and the tables of random codes become more, so
that a pair at the threshold shares one of their windows with probability ``RECALL`` at every width. Tables of the learnt code come
on top. Where all vectors lie in one direction, buckets grow with the crowd and are compared in full, block by block. Vectors are compared only with vectors of the same label and
length. Labels that are
no whole numbers are told by a 64-bit hash. Those that are null, empty or zero or hold null or non-finite components, and rows without label or id, link
with nothing. Rows that repeat an id count as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import ship_package, stash
from loanloom.llm.components import components

BITS = 64
# Least share of the pairs at the threshold that share a window, at every width.
RECALL = 0.995
SAMPLE_ROWS = 4_096
# Classes of a bucket compared in one block.
BLOCK = 512
# Share of bits that two codes may differ in: over four deviations beyond the mean at a cosine of 0.93.
DIFFERING = 0.3125


Model = tuple[np.ndarray, np.ndarray]  # directions (length x bits) and the value beyond which a bit is set


def learn_rotation(sample: np.ndarray, rounds: int = 40) -> Model:
    """Iterative quantisation: the rotation of the principal axes around the mean that is nearest to balanced signs."""
    length = sample.shape[1]
    bits = min(BITS, length)
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    rotation = np.linalg.qr(np.random.default_rng(length).standard_normal((bits, bits)))[0]
    projected = centred @ axes
    for _ in range(rounds):
        code = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ code)
        rotation = left @ right
    directions = axes @ rotation
    return directions, mean @ directions


def random_directions(length: int, codes: int) -> np.ndarray:
    """``BITS`` directions per code, at right angles as far as the length allows."""
    rng, found = np.random.default_rng(length + 1), []
    for _ in range(codes):
        turns = [np.linalg.qr(rng.standard_normal((length, min(length, BITS))))[0] for _ in range(-(-BITS // length))]
        found.append(np.hstack(turns)[:, :BITS])
    return np.hstack(found)


def learn_model(sample: np.ndarray, codes: int) -> Model:
    """The learnt code, its unused bits never set, and random codes after it."""
    learnt, limit = learn_rotation(sample)
    length, bits = learnt.shape
    unused = BITS - bits
    directions = np.hstack([learnt, np.zeros((length, unused)), random_directions(length, codes)])
    return directions, np.r_[limit, np.full(unused, np.inf), np.zeros(codes * BITS)]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def codes_of(vectors: np.ndarray, model: Model) -> np.ndarray:
    """A row of codes per vector, as 64-bit integers; the learnt one first."""
    directions, limit = model
    set_bits = (unit(vectors) @ directions >= limit).astype(np.uint64).reshape(len(vectors), -1, BITS)
    return (set_bits << np.arange(BITS, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def windows(bits: int, width: int, tables: int, first: int = 0) -> list[tuple[int, np.uint64]]:
    """Code and mask of every table's window; as many windows as fit lie side by side in a code, from code ``first`` on."""
    width = min(width, bits)
    per_code = bits // width
    return [(first + t // per_code, np.uint64(((1 << width) - 1) << t % per_code * width)) for t in range(tables)]


def window_width(largest_group: int) -> int:
    """Bits by which a bucket of the largest group holds some tens of classes."""
    return min(20, max(8, ceil(log2(max(1, largest_group) / 32))))


def _shared(cosine: float, width: int) -> float:
    """Probability that a pair at a cosine shares a window of independent bits."""
    return (1 - acos(max(-1.0, min(1.0, cosine))) / pi) ** width


def tables_for(width: int, cosine: float = 0.93) -> int:
    """The least number of tables in which a pair at a cosine shares a window with probability ``RECALL``."""
    shared = _shared(cosine, width)
    return 1 if shared >= RECALL else ceil(log(1 - RECALL) / log(1 - shared))


def expected_recall(cosine: float, width: int, tables: int | None = None) -> float:
    """Share of pairs at a cosine that share a window, for independent bits."""
    return 1 - (1 - _shared(cosine, width)) ** (tables_for(width) if tables is None else tables)


_KEYS = ["label", "length", "table", "bucket", "low", "high"]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys, which come sorted; the last run of a batch waits for the next."""
    waiting = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        keys = rows[_KEYS].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for start, end in zip(np.r_[0, cuts[:-1]], cuts) if len(cuts) else ():
            yield rows.iloc[start:end]
        waiting = rows.iloc[cuts[-1] if len(cuts) else 0 :]
    if waiting is not None:
        yield waiting


def _compared(group: pd.DataFrame) -> np.ndarray:
    """Which pairs a unit compares: all of one block, or those across two."""
    if group["low"].iloc[0] == group["high"].iloc[0]:
        return ~np.eye(len(group), dtype=bool)
    block = group["block"].to_numpy()
    return block[:, None] != block[None, :]


def _near_in_code(batches: Iterator[pd.DataFrame], most: dict[int, int]) -> Iterator[pd.DataFrame]:
    """Rows of each unit that have a partner within the Hamming distance."""
    found = []
    for group in _groups(batches):
        if len(group) < 2:
            continue
        code = group["code"].to_numpy(np.int64).view(np.uint64)
        distance = np.bitwise_count(code[:, None] ^ code[None, :])
        close = ((distance <= most[int(group["length"].iloc[0])]) & _compared(group)).any(axis=1)
        if close.any():
            found.append(group[close])
        if sum(map(len, found)) > 20_000:
            yield pd.concat(found)
            found = []
    if found:
        yield pd.concat(found)


def _components_within(linked: np.ndarray) -> np.ndarray:
    """The smallest row each row is connected to."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        if (least == label).all():
            return label
        label = least


def _reranked(
    batches: Iterator[pd.DataFrame], cosine: float, tables: dict[int, list[tuple[int, np.uint64]]]
) -> Iterator[pd.DataFrame]:
    """Links per row of each unit, and the row it is connected to."""
    for group in _groups(batches):
        if len(group) < 2:
            continue
        group = group.sort_values("rep")
        rep, copies = group["rep"].to_numpy(np.int64), group["copies"].to_numpy(np.int64)
        vectors = unit(np.stack(group["vector"].to_list()).astype(np.float64))
        linked = (vectors @ vectors.T >= cosine) & _compared(group)
        if not linked.any():
            continue
        codes = np.stack(group["codes"].to_list()).astype(np.int64).view(np.uint64)
        a, b = np.nonzero(linked)
        seen = np.zeros(len(a), dtype=bool)
        for number, mask in tables[int(group["length"].iloc[0])][: int(group["table"].iloc[0])]:
            seen |= ((codes[a, number] ^ codes[b, number]) & mask) == 0
        links = np.bincount(a[~seen], weights=copies[b[~seen]], minlength=len(rep)).astype(np.int64)
        root = rep[_components_within(linked)]
        given = (links > 0) | (root != rep)
        yield pd.DataFrame({"rep": rep[given], "links": links[given], "root": root[given]})


def _tables(length: int, width: int, cosine: float) -> list[tuple[int, np.uint64]]:
    """Windows of the learnt code, then those of random codes that alone reach the recall."""
    bits = min(BITS, length)
    learnt = windows(bits, width, bits // min(width, bits))
    return learnt + windows(BITS, width, tables_for(width, cosine), first=1)


def _fit(classes: DataFrame, width: int, cosine: float) -> dict[int, Model]:
    """Directions per vector length; the rotation of a length that the sample misses is learnt from random vectors."""
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("length", "vector").toPandas()
    lengths = [r["length"] for r in classes.select("length").distinct().collect()]
    models = {}
    for length in lengths:
        own = sample["vector"][sample["length"] == length].to_list()
        rng = np.random.default_rng(length)
        rows = np.stack(own).astype(np.float64) if len(own) > 1 else rng.standard_normal((2 * length, length))
        models[length] = learn_model(unit(rows), _tables(length, width, cosine)[-1][0])
    return models


def _codes_column(vector: Column, models: dict[int, Model]) -> Column:
    @F.pandas_udf("array<long>")
    def coded(values: pd.Series) -> pd.Series:
        out = np.empty(len(values), object)
        lengths = values.map(len).to_numpy()
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            codes = codes_of(np.stack(values.iloc[own].to_list()).astype(np.float64), models[int(length)]).view(np.int64)
            for place, row in zip(own, codes):
                out[place] = row
        return pd.Series(out)

    return coded(vector)


def _units(classes: DataFrame, tables: dict[int, list[tuple[int, np.uint64]]]) -> DataFrame:
    """A row per class, table and unit of work of its bucket; codes only."""
    per_length = F.lit(None).cast("array<struct<number:int,mask:long>>")
    for n, own in tables.items():
        places = [F.struct(F.lit(c).alias("number"), F.lit(int(m.view(np.int64))).alias("mask")) for c, m in own]
        per_length = F.when(F.col("length") == n, F.array(*places)).otherwise(per_length)
    filed = classes.select("label", "length", "rep", "code", "codes", F.posexplode(per_length).alias("table", "place"))
    bucket = F.get("codes", F.col("place.number")).bitwiseAND(F.col("place.mask"))
    filed = stash(filed.select("label", "length", "table", bucket.alias("bucket"), "rep", "code"), "filed")
    keys = _KEYS[:4]
    large = stash(filed.groupBy(*keys).count().where(F.col("count") > BLOCK), "large")
    sized = filed.join(large, keys, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int"))
    own = sized.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(
        *keys, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "code"
    )


def _label_number(embeddings: DataFrame) -> Column:
    label = F.col("label")
    if embeddings.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return label.cast("long")
    return F.when(label.isNotNull(), F.xxhash64(label))


def near_vectors(embeddings: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``."""
    ship_package(embeddings.sparkSession)
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))
    rows = embeddings.select("vec_id", _label_number(embeddings).alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = finite & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    valid = F.coalesce(usable, F.lit(False))
    key = [F.when(valid, F.xxhash64("label", "vector", F.lit(s))).alias(f"print_{s}") for s in (1, 2)]
    rows = rows.select("vec_id", "label", "vector", *key)
    classes = stash(
        rows.where("print_1 IS NOT NULL")
        .groupBy("print_1", "print_2")
        .agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
            F.first("vector").alias("vector"),
        )
        .withColumn("length", F.size("vector")),
        "vector-classes",
    )
    largest = classes.groupBy("label", "length").count().agg(F.max("count")).first()[0] or 0
    width = window_width(largest)
    models = _fit(classes, width, cosine)
    tables = {n: _tables(n, width, cosine) for n in models}
    coded = classes.withColumn("codes", _codes_column(F.col("vector"), models)).withColumn("code", F.get("codes", F.lit(1)))
    coded = stash(coded, "codes")
    most = dict.fromkeys(models, int(DIFFERING * BITS) + 1)
    units = _units(coded, tables).repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    near = stash(units.mapInPandas(lambda batches: _near_in_code(batches, most), units.schema), "near-codes")
    with_vectors = near.join(coded.select("rep", "copies", "vector", "codes"), "rep").repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    found = stash(
        with_vectors.mapInPandas(lambda batches: _reranked(batches, cosine, tables), "rep long, links long, root long"), "reranked"
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = stash(
        coded.select("print_1", "print_2", "rep", "copies")
        .join(links, "rep", "left")
        .join(reached.withColumnRenamed("node", "rep"), "rep", "left")
        .select("print_1", "print_2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "known",
    )
    return (
        rows.select("vec_id", "print_1", "print_2")
        .join(known, ["print_1", "print_2"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
