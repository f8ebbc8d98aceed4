"""Near-duplicate documents by a MinHash LSH forest.

A text's set holds the distinct runs of ``shingle`` words (its whole word sequence if it is shorter). Texts with
equal sets are one class. Each class has a signature of ``TREES * OWN_LEVELS`` MinHash values; every tree of the
forest orders the classes by the signature read from another place, ``LEVELS`` values long. In each order,
neighbours with a common prefix of at least ``LEAST_DEPTH`` values are candidates. The depth adapts to
the region: where more than ``REACH`` classes in a row share a prefix, only those that share a longer one count,
besides the two nearest and, at every depth, the region's leader: the class nearest to the majority of its
sketches, which is what the copies of one text descend from. So a region of any size gives a number of candidates in proportion to its rows, and
pairs are never listed group by group. Sizes and a bit sketch rule out hopeless candidates (a true pair is lost to
the sketch with probability below 1e-6); the others are confirmed on full sets: first each class with its
best neighbour, then every candidate between classes that are not connected yet.

Crowds are then compared in full: where more than ``REACH`` classes share ``LEAST_DEPTH`` values and are not all
connected yet, every two of different components are judged, block by block in tasks of bounded size, first by their
whole signatures, then on full sets. A crowd of copies is connected by then and costs nothing; one of texts that
resemble each other just below the similarity costs its square.

At a similarity of 0.85 an isolated pair escapes all trees with probability 4e-7.

Texts without words have an empty set and link with nothing, as do rows without an id, whose component is NULL and
which are kept. Rows that repeat an id are judged each by its own text. Equal texts link with one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import checked_broadcast, released, ship_package, stash
from loanloom.llm.components import components
from loanloom.llm.vectors import _components_within

TREES, OWN_LEVELS, LEVELS, LEAST_DEPTH, REACH = 20, 6, 12, 4, 8
HASHES = TREES * OWN_LEVELS
# Five standard deviations of the sketch's estimate at a similarity of 0.8.
SKETCH_MARGIN = 0.27
# Five standard deviations of the signature's estimate at a similarity of 0.8.
SIGNATURE_MARGIN = 0.19
# Classes of a crowd in one block, and distinct shingles of two blocks counted at a time.
CROWD_BLOCK, CROWD_COLUMNS = 256, 4_096
_REMEMBERED = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()
_rng = np.random.default_rng(20)
_SCALE = _rng.integers(1 << 8, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; words end at ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    run = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(size, len(run))
    count = len(run) - width + 1
    hashed = np.full(count, 0x5851F42D4C957F2D ^ (width < size) * width, np.uint64)
    for j in range(width):
        hashed = _mixed(hashed + run[j : j + count])
    return np.unique(hashed)


def set_print(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist())


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 512):
        values = low[start : start + 512] * _SCALE
        values += _SHIFT
        np.minimum(least, values.min(axis=0), out=least)
    return least


_SIGNED = "doc_id long, n_shingles long, print_a long, print_b long, levels binary, sketch binary, text_a long, text_b long"


def _sign(texts: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch["text"]:
            shingles = shingle_set(text, size)
            if not len(shingles):
                rows.append((0, 0, 0, b"", b""))
                continue
            values = _mixed(signature(shingles).astype(np.uint64))
            print_a, print_b = set_print(shingles)
            levels = (values >> np.uint64(40)).astype(">u2").tobytes()
            sketch = np.packbits((values & np.uint64(1)).astype(np.uint8)).tobytes()
            rows.append((len(shingles), print_a, print_b, levels, sketch))
        frame = pd.DataFrame(rows, columns=["n_shingles", "print_a", "print_b", "levels", "sketch"])
        frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
        yield frame.assign(text_a=batch["text_a"].to_numpy(), text_b=batch["text_b"].to_numpy())


def text_prints() -> list[Column]:
    """128 bits that tell the text of a row, where an id stands on several."""
    return [F.xxhash64(F.coalesce("text", F.lit("")), F.lit(s)).alias(f"text_{n}") for s, n in ((1, "a"), (2, "b"))]


def signed(docs: DataFrame, size: int) -> DataFrame:
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *text_prints()
    )
    return text.mapInPandas(lambda batches: released(_sign(batches, size), _words), _SIGNED)


_FOUND = "a long, b long, score int, tree int, key binary, rep long, n_shingles long, sketch binary"


def _neighbours(batches: Iterator[pd.DataFrame], similarity: float, bounds: bool) -> Iterator[pd.DataFrame]:
    """Candidates among rows in forest order; with ``bounds``, also the rows at both ends of the partition."""
    columns = ["tree", "key", "rep", "n_shingles", "sketch"]
    kept, first = None, True
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        old = 0 if kept is None else len(kept)
        if bounds and first:
            yield batch.head(REACH)[columns]
        first = False
        kept = rows.tail(REACH)
        found = _pairs(rows, old, similarity)
        if len(found):
            yield found
    if bounds and kept is not None:
        yield kept[columns]


def _pairs(rows: pd.DataFrame, old: int, similarity: float) -> pd.DataFrame:
    """Candidate pairs with a row from ``old`` on."""
    tree, rep = rows["tree"].to_numpy(), rows["rep"].to_numpy()
    sizes = rows["n_shingles"].to_numpy(np.float64)
    key = np.frombuffer(b"".join(rows["key"]), np.uint16).reshape(len(rows), LEVELS)
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
    depth = np.zeros((REACH + 1, len(rows)), np.int64)
    for j in range(1, min(REACH, len(rows) - 1) + 1):
        same = (key[j:] == key[:-j]) & (tree[j:] == tree[:-j])[:, None]
        depth[j, j:] = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    needed = np.maximum(depth[REACH] + 1, LEAST_DEPTH)
    firsts, seconds = [], []
    for j in range(1, REACH + 1):
        later = np.flatnonzero(depth[j] >= (LEAST_DEPTH if j <= 2 else needed))
        firsts.append(later[later >= j] - j)
        seconds.append(later[later >= j])
    for level in range(LEAST_DEPTH, LEVELS + 1, 2):
        member, leader = _led(depth[1] >= level, sketch)
        firsts.append(member)
        seconds.append(leader)
    first, second = np.concatenate(firsts), np.concatenate(seconds)
    new = (np.maximum(first, second) >= old) & (rep[first] != rep[second])
    first, second = first[new], second[new]
    ratio = np.minimum(sizes[first], sizes[second]) >= similarity * np.maximum(sizes[first], sizes[second])
    first, second = first[ratio], second[ratio]
    differ = np.bitwise_count(sketch[first] ^ sketch[second]).sum(axis=1, dtype=np.int64)
    close = 1 - 2 * differ / HASHES >= similarity - SKETCH_MARGIN
    first, second, differ = rep[first[close]], rep[second[close]], differ[close]
    found = pd.DataFrame({"a": np.minimum(first, second), "b": np.maximum(first, second), "score": (HASHES - differ).astype(np.int32)})
    return found.drop_duplicates(["a", "b"])


def _led(joined: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of every run of more than ``REACH``, each with its run's leader, the row nearest to the majority of their sketches.

    ``joined``: whether a row shares the prefix with the row before it.
    """
    starts = np.flatnonzero(~joined)
    sizes = np.diff(np.r_[starts, len(joined)])
    large = sizes > REACH
    if not large.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, sizes = starts[large], sizes[large]
    member = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    run = np.repeat(np.arange(len(starts)), sizes)
    bits = np.unpackbits(sketch[member], axis=1)
    offsets = np.r_[0, np.cumsum(sizes)[:-1]]
    majority = np.packbits(2 * np.add.reduceat(bits, offsets, axis=0, dtype=np.int64) > sizes[:, None], axis=1)
    distance = np.bitwise_count(sketch[member] ^ majority[run]).sum(axis=1, dtype=np.int64)
    nearest = np.lexsort((member, distance, run))[offsets]
    return member, member[nearest][run]


def _filled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _FOUND.split(", ")]
    whole = {"a": "Int64", "b": "Int64", "score": "Int32", "tree": "Int32", "rep": "Int64", "n_shingles": "Int64"}
    for frame in frames:
        yield frame.reindex(columns=names).astype(whole)


def forest_candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """``a, b, score``: distinct candidate pairs of classes (``rep, n_shingles, levels, sketch``)."""
    order = ["tree", "key", "rep"]
    wrapped = F.concat("levels", F.substring("levels", 1, 2 * LEVELS))
    in_trees = classes.select("rep", "n_shingles", "sketch", wrapped.alias("levels"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = in_trees.select(
        "tree", F.substring("levels", F.col("tree") * (2 * OWN_LEVELS) + 1, F.lit(2 * LEVELS)).alias("key"), "rep", "n_shingles", "sketch"
    )
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stash(
        sorted_rows.mapInPandas(lambda b: _filled(_neighbours(b, similarity, True)), _FOUND), "neighbours"
    )
    # Neighbours that a partition's end separates: a few rows per partition, met once more in order.
    ends = found.where("a IS NULL").select("tree", "key", "rep", "n_shingles", "sketch").distinct()
    across = ends.repartition(1).sortWithinPartitions(*order).mapInPandas(
        lambda b: _filled(_neighbours(b, similarity, False)), _FOUND
    )
    pairs = found.where("a IS NOT NULL").select("a", "b", "score").unionByName(across.select("a", "b", "score"))
    return pairs.groupBy("a", "b").agg(F.max("score").alias("score"))


def _shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """``print_a, print_b, shingles`` of ``text``."""

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch["text"]]
            prints = [set_print(s) for s in sets]
            yield pd.DataFrame(
                {"print_a": [p[0] for p in prints], "print_b": [p[1] for p in prints], "shingles": [s.tobytes() for s in sets]}
            )

    return texts.mapInPandas(lambda batches: released(shingled(batches), _words), "print_a long, print_b long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a")
    with_both = with_a.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b")
    return with_both.where(similar("set_a", "set_b")).select("a", "b")


_UNIT = ["tree", "prefix", "low", "high"]


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Units of sorted rows, with the places of their two blocks (the same for a block with itself)."""

    def placed(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        block = rows["block"].to_numpy()
        return rows, np.flatnonzero(block == rows["low"].iloc[0]), np.flatnonzero(block == rows["high"].iloc[0])

    waiting = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        keys = rows[_UNIT].to_numpy()
        cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1]
        for start, end in zip(cuts[:-1], cuts[1:]):
            yield placed(rows.iloc[start:end])
        waiting = rows.iloc[cuts[-1] :]
    if waiting is not None:
        yield placed(waiting)


def _near_in_signature(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Rows of each unit with a partner of another component that their signatures do not rule out."""
    for rows, left, right in _units(batches):
        component, sizes = rows["component"].to_numpy(), rows["n_shingles"].to_numpy(np.float64)
        apart = component[left][:, None] != component[right][None, :]
        a, b = sizes[left][:, None], sizes[right][None, :]
        apart &= np.minimum(a, b) >= similarity * np.maximum(a, b)
        levels = np.frombuffer(b"".join(rows["levels"]), np.uint16).reshape(len(rows), HASHES)
        for tree in range(int(rows["tree"].iloc[0])):
            # Judged in that tree.
            prefix = np.ascontiguousarray(levels[:, tree * OWN_LEVELS :][:, :LEAST_DEPTH]).view(np.uint64).ravel()
            apart &= prefix[left][:, None] != prefix[right][None, :]
        left, right, apart = left[apart.any(axis=1)], right[apart.any(axis=0)], apart[apart.any(axis=1)][:, apart.any(axis=0)]
        if not len(left):
            continue
        equal = np.zeros(apart.shape, np.uint8)
        for x, y in zip(levels[left].T, levels[right].T):
            equal += x[:, None] == y[None, :]
        near = apart & (equal >= (similarity - SIGNATURE_MARGIN) * HASHES)
        kept = np.union1d(left[near.any(axis=1)], right[near.any(axis=0)])
        if len(kept):
            yield rows.iloc[kept][[*_UNIT, "block", "rep", "component"]]


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common shingles of two blocks' sets."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(shared.sum()), CROWD_COLUMNS):
        low, high = np.searchsorted(column, [start, start + CROWD_COLUMNS])
        held = np.zeros((len(sets), CROWD_COLUMNS), np.float32)
        held[owner[low:high], column[low:high] - start] = 1
        common += (held[left] @ held[right].T).astype(np.int64)
    return common


def _crowd_links(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Links that connect the rows of each unit which similar pairs connect."""
    for rows, left, right in _units(batches):
        if not len(left) or not len(right):
            continue
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        sizes, component, rep = np.array([len(x) for x in sets]), rows["component"].to_numpy(), rows["rep"].to_numpy()
        common = _common(sets, left, right)
        similar = 100 * common >= percent * (sizes[left][:, None] + sizes[right][None, :] - common)
        similar &= component[left][:, None] != component[right][None, :]
        if not similar.any():
            continue
        linked = np.zeros((len(rows), len(rows)), dtype=bool)
        linked[np.ix_(left, right)] = similar
        root = _components_within(linked | linked.T)
        moved = np.flatnonzero(root != np.arange(len(rows)))
        yield pd.DataFrame({"a": rep[root[moved]], "b": rep[moved]})


def crowd_links(docs: DataFrame, classes: DataFrame, links: DataFrame, size: int, percent: int) -> DataFrame | None:
    """``a, b``: links that connect what similar pairs within crowds connect beyond the given links."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    prefix = F.substring("levels", F.col("tree") * (2 * OWN_LEVELS) + 1, F.lit(2 * LEAST_DEPTH)).alias("prefix")
    run = ["tree", "prefix"]
    filed = classes.select("rep", "levels", trees).select("rep", "tree", prefix)
    runs = stash(filed.groupBy(*run).count().where(F.col("count") > REACH).select(*run), "runs")
    if runs.isEmpty():
        return None
    labels = components(links).withColumnRenamed("node", "rep")
    crowded = filed.join(runs, run).join(labels, "rep", "left")
    members = stash(crowded.select(*run, "rep", F.coalesce("component", "rep").alias("component")), "crowded")
    several = members.groupBy(*run).agg(F.count(F.lit(1)).alias("count"), F.min("component").alias("first"), F.max("component").alias("last"))
    several = stash(several.where("first <> last").select(*run, F.ceil(F.col("count") / CROWD_BLOCK).cast("int").alias("blocks")), "crowds")
    own = members.join(several, run).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    own = own.join(classes.select("rep", "n_shingles", "levels"), "rep")
    units = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *run, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "component",
        "n_shingles", "levels",
    )
    kept = "tree int, prefix binary, low int, high int, block int, rep long, component long"
    sorted_units = units.repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    near = stash(sorted_units.mapInPandas(lambda b: _near_in_signature(b, percent / 100), kept), "near-signatures")
    wanted = stash(near.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    if wanted.isEmpty():
        return None
    with_sets = near.join(_sets_of(docs, classes, wanted, size), "rep").repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    return with_sets.mapInPandas(lambda b: _crowd_links(b, percent), "a long, b long")


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``rep, shingles`` of the classes whose ids are wanted."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = text.join(checked_broadcast(wanted), "doc_id", "left_semi").select("text")
    # An id may stand on several rows, so a set finds its class by its print.
    of_class = classes.select("print_a", "print_b", "rep")
    return stash(_shingle_sets(texts, size).join(of_class, ["print_a", "print_b"]).select("rep", "shingles"), "sets")


def linked_classes(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links ``a, b`` that connect all classes a candidate pair connects."""
    pairs = stash(forest_candidates(classes, percent / 100), "candidates")
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("near"), "score").unionByName(
        pairs.select(F.col("b").alias("rep"), F.col("a").alias("near"), "score")
    )
    best = ends.groupBy("rep").agg(F.max_by("near", F.struct("score", -F.col("near"))).alias("near"))
    first = stash(best.select(F.least("rep", "near").alias("a"), F.greatest("rep", "near").alias("b")).distinct(), "best")
    wanted = stash(ends.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sets = _sets_of(docs, classes, wanted, size)
    links = stash(_confirmed(first, sets, percent), "confirmed")
    known = components(links)
    rest = pairs.join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    apart = rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    links = stash(links.unionByName(_confirmed(apart, sets, percent)), "confirmed")
    in_crowds = crowd_links(docs, classes, links, size, percent)
    return links if in_crowds is None else stash(links.unionByName(in_crowds), "confirmed")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept, text_a, text_b``; similarity is at least ``percent`` hundredths.

    The last two tell the row's text, so that rows which share an id can be told apart.
    """
    ship_package(docs.sparkSession)
    rows = stash(signed(docs, shingle), "signed")
    known = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stash(
        known.groupBy("print_a", "print_b").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("levels").alias("levels"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    found = components(linked_classes(docs, classes, shingle, percent))
    reached = stash(
        classes.select("print_a", "print_b", F.col("rep").alias("node"))
        .join(found, "node", "left")
        .select("print_a", "print_b", F.coalesce("component", "node").alias("component")),
        "reached",
    )
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return (
        rows.select("doc_id", "n_shingles", "print_a", "print_b", "text_a", "text_b")
        .join(reached, ["print_a", "print_b"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), "text_a", "text_b")
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
