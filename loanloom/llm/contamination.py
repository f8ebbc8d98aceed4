"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may occur in a document with up to ``k = BUDGET * n`` edits. Cut into k + 1 pieces, at
least one piece then occurs unchanged, so exact hits of pieces, found by one automaton over all pieces, are the
only places to look at. Each is verified with Myers' bit-parallel distance of the whole item within the window it implies.

Texts are compared in lower case with runs of ASCII punctuation and white space as one blank. The items are the query
set: they are taken in blocks of bounded size, each of which meets all documents; the documents are never shuffled.

Missing and empty texts match nothing, as do empty items. Items too short for an edit match where they stand unchanged
between word boundaries. Repeated rows and repeated items give a result each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import released, ship_package, stash

BUDGET = 0.06
# Characters of test items whose pieces go into one automaton.
BLOCK_CHARS = 4_000_000

_BLANKED = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def normalised(text: str) -> str:
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_BLANKED)
    return b" ".join(raw.split()).decode("utf-8", "surrogatepass")


def pieces_of(item: str, budget: float = BUDGET) -> list[tuple[int, str]]:
    """Offsets and texts of the error budget plus one pieces, of equal length up to one."""
    count = int(budget * len(item)) + 1
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_occurrence(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """Least distance of the pattern to a substring of the text and the first end of one, if within the limit.

    Myers' vertical difference vectors, one whole-pattern bit vector per column.
    """
    n = len(pattern)
    if not n:
        return None
    full, top = (1 << n) - 1, 1 << (n - 1)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    plus, minus, distance = full, 0, n
    best, end = limit + 1, -1
    for place, c in enumerate(text):
        mask = masks.get(c, 0)
        zero = (((mask & plus) + plus) ^ plus) | mask | minus
        up = minus | (full & ~(zero | plus))
        down = plus & zero
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(zero | up))
        minus = up & zero
        if distance < best:
            best, end = distance, place + 1
    return (best, end) if best <= limit else None


class Decontaminator:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], budget: float = BUDGET):
        self._items = [(i, normalised(t)) for i, t in items]
        self._budget = budget
        self._pieces: list[list[tuple[int, int]]] = []
        self._automaton = ahocorasick.Automaton()
        numbers: dict[str, int] = {}
        for number, (item_id, item) in enumerate(self._items):
            if not item:
                continue
            for offset, piece in pieces_of(item, budget):
                place = numbers.setdefault(piece, len(numbers))
                if place == len(self._pieces):
                    self._pieces.append([])
                    self._automaton.add_word(piece, (place, len(piece)))
                self._pieces[place].append((number, offset))
        if numbers:
            self._automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of each item's best place in the normalised text; the start is implied."""
        doc = normalised(text)
        found: list[tuple[int, int, int, int]] = []
        if not len(self._automaton):
            return found
        # Where each item would start, by item.
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (place, size) in self._automaton.iter(doc):
            for number, offset in self._pieces[place]:
                starts[number].add(last + 1 - size - offset)
        for number, places in sorted(starts.items()):
            item_id, item = self._items[number]
            limit, best = int(self._budget * len(item)), None
            exact = min((p for p in places if p >= 0 and doc.startswith(item, p) and (limit or _stands_alone(doc, p, len(item)))), default=None)
            if exact is not None:
                found.append((item_id, 0, exact, exact + len(item)))
                continue
            if not limit:
                continue
            for low, high in _windows(sorted(places), len(item), limit):
                low = max(0, low)
                hit = best_occurrence(item, doc[low:high], limit)
                if hit and (best is None or hit[0] < best[1]):
                    end = low + hit[1]
                    best = (item_id, hit[0], max(0, end - len(item)), end)
            if best:
                found.append(best)
        return found


def _stands_alone(doc: str, start: int, size: int) -> bool:
    """Whether a place in a normalised text begins and ends with a word."""
    return (start == 0 or doc[start - 1] == " ") and (start + size == len(doc) or doc[start + size] == " ")


def _windows(places: list[int], size: int, limit: int) -> Iterator[tuple[int, int]]:
    """Windows around the implied starts, joined where they overlap by more than half an item."""
    low = high = None
    for place in places:
        a, b = place - limit, place + size + limit
        if low is None:
            low, high = a, b
        elif a <= low + 2 * limit + size // 2:
            high = b
        else:
            yield low, high
            low, high = a, b
    if low is not None:
        yield low, high


_built: dict[int, Decontaminator] = {}


def _decontaminator(items: list[tuple[int, str]], budget: float) -> Decontaminator:
    """One automaton per block and worker process."""
    key = hash((tuple(items), budget))
    if key not in _built:
        _built.clear()
        _built[key] = Decontaminator(items, budget)
    return _built[key]


def item_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of about ``chars`` characters, one at a time on the driver."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = total // chars + 1
    for block in range(count):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0], r[1]))


_MATCHES = "array<struct<item_id:long,distance:int,start:int,end:int>>"


def matches_column(text: Column, items: list[tuple[int, str]], budget: float = BUDGET) -> Column:
    @F.pandas_udf(_MATCHES)
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = _decontaminator(items, budget)
        yield from released(
            pd.Series([[{"item_id": i, "distance": d, "start": s, "end": e} for i, d, s, e in finder.matches(t)] for t in texts], dtype=object)
            for texts in batches
        )

    return matched(F.coalesce(text, F.lit("")))


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``doc_id, item_id, distance, start, end`` for every item found in a document, positions in the normalised text.

    Each block of items but the last is written before the next one is fetched, so the driver holds one.
    """
    ship_package(docs.sparkSession)
    found = None
    for items in item_blocks(benchmark):
        own = docs.select("doc_id", F.explode(matches_column(F.col("text"), items, budget)).alias("found"))
        own = own.select("doc_id", "found.*")
        found = own if found is None else stash(found, "matches").unionByName(own)
    return found


def uncontaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found; block by block, each looking only at what the last one left."""
    ship_package(docs.sparkSession)
    clean = None
    for items in item_blocks(benchmark):
        left = docs if clean is None else stash(clean, "uncontaminated")
        clean = left.where(F.size(matches_column(left["text"], items, budget)) == 0)
    return clean
