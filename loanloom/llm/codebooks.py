"""Vector compression: a codebook per part of the vector, with distances read from tables over value dictionaries.

Components become integers ``floor(256 * x)`` and vectors are cut into ``PARTS`` consecutive parts. Vectors are stored
once as blocks: per dimension a dictionary of the distinct integers of the block, and a code per vector into it. To
assign a block's parts, the squared differences of every distinct integer to all entries are tabulated per dimension;
the distance of a part to every entry is then a sum of gathered table rows, and the nearest entry (ties to the lower
index) is its code. The sums that move an entry come from counts of (entry, integer), so they are exact as well.

The codebook of a part starts as that part of the ``ENTRIES`` vectors of smallest id. Every round is one pass over the
blocks: a task returns sums per part, entry and dimension, which Spark adds up; what reaches the driver is as large as the
codebooks. A lost executor's blocks are read again from the shared folder.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors of different lengths have
codebooks of their own. Where a length is no multiple of ``PARTS``, part i reaches from floor(i * length / PARTS) to
floor((i + 1) * length / PARTS), so parts may be empty; an empty part has code 0 and error 0. With fewer vectors than
entries, the codebook is shorter. Rows that repeat an id count each for themselves (as starting entries in order of their
components); missing ids come last. Integers beyond 2^62 are held at it, and errors beyond a long at its largest. An empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom.llm.common import looked_up, ship_package, stash

PARTS = 16
ENTRIES = 64
ROUNDS = 2
# Components held in one block.
BLOCK_VALUES = 1 << 20
_LARGEST = 2**63 - 1

Book = np.ndarray  # entries x length


def bounds(length: int, parts: int = PARTS) -> list[int]:
    return [i * length // parts for i in range(parts + 1)]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as dictionaries and codes, a row per block."""
    for batch in batches:
        lengths = batch["vector"].map(len).to_numpy()
        for length in np.unique(lengths):
            own = batch[lengths == length]
            step = max(1, BLOCK_VALUES // max(1, int(length)))
            for start in range(0, len(own), step):
                rows = own.iloc[start : start + step]
                values = np.stack(rows["vector"].to_list()).astype(np.int64)
                coded = [np.unique(values[:, d], return_inverse=True) for d in range(length)]
                codes = np.stack([c.ravel() for _, c in coded]) if length else np.zeros((0, len(rows)))
                yield pd.DataFrame(
                    {
                        "length": [int(length)],
                        "ids": [rows["vec_id"].astype("Int64").astype(object).where(rows["vec_id"].notna(), None).to_list()],
                        "labels": [rows["label"].astype(object).where(rows["label"].notna(), None).to_list()],
                        "dictionary": [[d.tolist() for d, _ in coded]],
                        "codes": [codes.astype(np.uint32).tobytes()],
                    }
                )


_BLOCK = "length int, ids array<long>, labels array<string>, dictionary array<array<long>>, codes binary"


def _unpacked(row) -> tuple[list[np.ndarray], np.ndarray]:
    dictionary = [np.asarray(d, dtype=np.int64) for d in row.dictionary]
    codes = np.frombuffer(row.codes, dtype=np.uint32).reshape(len(dictionary), len(row.ids))
    # Integers whose squares would not fit are taken as numbers of any size.
    largest = max((int(np.abs(d).max()) for d in dictionary if len(d)), default=0)
    if largest >= 2**28:
        dictionary = [d.astype(object) for d in dictionary]
    return dictionary, codes


def assign(dictionary: list[np.ndarray], codes: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every part, parts x vectors, and the summed squared distances of every vector."""
    n, cuts = codes.shape[1], bounds(len(dictionary))
    nearest, error = np.zeros((PARTS, n), dtype=np.int64), 0
    for part, (low, high) in enumerate(zip(cuts, cuts[1:])):
        if low == high:
            continue
        distance = 0
        for d in range(low, high):
            table = (dictionary[d][:, None] - book[:, d][None, :]) ** 2
            distance = distance + table[codes[d]]
        nearest[part] = distance.argmin(axis=1)
        error = error + distance[np.arange(n), nearest[part]]
    return nearest, np.broadcast_to(np.asarray(error), n)


def _sums(batches: Iterator[pd.DataFrame], books: dict[int, Book]) -> Iterator[pd.DataFrame]:
    """Sum and count per entry and dimension of all blocks of a task."""
    sums = {n: np.zeros(b.shape, dtype=object) for n, b in books.items()}
    counts = {n: np.zeros((PARTS, len(b)), dtype=np.int64) for n, b in books.items()}
    seen = set()
    for batch in batches:
        for row in batch.itertuples(index=False):
            dictionary, codes = _unpacked(row)
            book, cuts = books[row.length], bounds(row.length)
            nearest, _ = assign(dictionary, codes, book)
            seen.add(row.length)
            for part, (low, high) in enumerate(zip(cuts, cuts[1:])):
                counts[row.length][part] += np.bincount(nearest[part], minlength=len(book))
                for d in range(low, high):
                    size = len(dictionary[d])
                    held = np.bincount(nearest[part] * size + codes[d], minlength=len(book) * size).reshape(len(book), size)
                    sums[row.length][:, d] += (held.astype(dictionary[d].dtype) @ dictionary[d]).astype(object)
    for length in sorted(seen):
        cuts = bounds(length)
        for part, (low, high) in enumerate(zip(cuts, cuts[1:])):
            used = np.flatnonzero(counts[length][part])
            for d in range(low, high):
                yield pd.DataFrame(
                    {
                        "length": length, "place": d, "entry": used,
                        "total": [Decimal(int(s)) for s in sums[length][used, d]], "n": counts[length][part][used],
                    }
                )


def _coded(batches: Iterator[pd.DataFrame], books: dict[int, Book]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            nearest, error = assign(*_unpacked(row), books[row.length])
            code = [bytes(c).hex() for c in nearest.T.astype(np.uint8)]
            yield pd.DataFrame(
                {
                    "vec_id": pd.array([None if i is None or i != i else int(i) for i in row.ids], dtype="Int64"),
                    "label": list(row.labels), "length": row.length, "code": code,
                    "error": [min(int(e), _LARGEST) for e in error],
                }
            )


def fixed_point(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of integers for every usable row."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("wide", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), wide.alias("wide"))
    held = F.transform("wide", lambda x: F.greatest(F.least(F.floor(x * 256.0), F.lit(2**62)), F.lit(-(2**62))))
    return rows.where(F.coalesce(finite, F.lit(False))).select("vec_id", "label", held.alias("vector"))


def _first_books(vectors: DataFrame, entries: int) -> dict[int, Book]:
    """Vectors of smallest id per length."""
    order = Window.partitionBy("length").orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    ranked = vectors.select("vec_id", "vector", F.size("vector").alias("length")).withColumn("place", F.row_number().over(order))
    books: dict[int, list] = {}
    for r in ranked.where(F.col("place") <= entries).orderBy("length", "place").collect():
        books.setdefault(r["length"], []).append(r["vector"])
    return {n: np.array(rows, dtype=object).reshape(len(rows), n) for n, rows in books.items()}


def _small(books: dict[int, Book]) -> dict[int, Book]:
    """Machine integers where no square can overflow."""
    return {n: b.astype(np.int64) if all(abs(int(x)) < 2**28 for x in b.flat) else b for n, b in books.items()}


def train_codebooks(vectors: DataFrame, blocks: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, Book]:
    """Codebooks per vector length: nearest entries, then entries moved to the floor of their parts' mean."""
    books = _first_books(vectors, entries)
    for _ in range(rounds):
        held = _small(books)
        schema = "length int, place int, entry int, total decimal(38,0), n long"
        sums = blocks.mapInPandas(lambda batches: _sums(batches, held), schema)  # noqa: B023
        moved = sums.groupBy("length", "place", "entry").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in moved.collect():  # a row per component of the codebooks
            books[r["length"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return _small(books)


def digest(book: Book) -> str:
    cuts = bounds(book.shape[1])
    parts = [book[:, low:high].ravel() for low, high in zip(cuts, cuts[1:])]
    return hashlib.sha256(",".join(str(int(x)) for p in parts for x in p).encode()).hexdigest()


def compress_vectors(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per usable row: ``vec_id, code, error, label_error, codebooks_sha256``."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so there are 1 to 256 entries")
    ship_package(embeddings.sparkSession)
    vectors = fixed_point(embeddings)
    blocks = stash(vectors.mapInPandas(_blocks, _BLOCK), "vector-blocks")
    books = train_codebooks(vectors, blocks, entries, rounds)
    coded = blocks.mapInPandas(lambda batches: _coded(batches, books), "vec_id long, label string, length int, code string, error long")
    # Missing labels are one label.
    keys = [F.col("label").isNotNull().alias("labelled"), F.coalesce("label", F.lit("")).alias("label")]
    coded = stash(coded.select("vec_id", *keys, "length", "code", "error"), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LARGEST)).cast("long")
    errors = stash(coded.groupBy("labelled", "label").agg(total.alias("label_error")), "label-errors")
    digests = coded.sparkSession.createDataFrame([(n, digest(b)) for n, b in books.items()], "length int, codebooks_sha256 string")
    found = looked_up(coded, errors, ["labelled", "label"]).join(F.broadcast(digests), "length", "left")
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
