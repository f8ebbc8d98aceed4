"""Source divergence audit: which sources of a language differ most, and by which terms.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased. A language keeps the terms that
occur in at least ``LEAST_DOCS`` of its documents. Every group (language, source) and every language as a whole gives each kept
term a smoothed probability in billionths; ``(p - q)^2 div (p + q)`` of two such probabilities is the term's
divergence. All arithmetic is on integers.

*Pairs of sources.* Most terms are absent from most sources, where p takes one value per group. So the divergence summed
over all kept terms is that of two groups without any term, plus what each group's own terms change against the
other's value for absent terms (by distinct counts, which are few), plus what the terms present in both change.

*Terms of a source.* A term's divergence grows with its count in the group and falls with its count in the language, as
long as p > q. So a term that ``TOP`` others dominate (a count in the group at least as high, one in the
language at most as high, and an earlier place in UTF-8 order) cannot be among the first ``TOP``. Every partition keeps the terms of
its skyband, those dominated by fewer than ``TOP`` others; skybands of a group are merged, and what is left is ranked exactly.

Missing texts, languages and sources count as empty strings, and an empty language or source is one like any other. Groups
without kept terms give pairs with the value 0 where the language keeps none. Repeated rows are documents of their own; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.llm.common import looked_up, ship_package, stash

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
# Distinct (language, source, term) a task holds before it passes their counts on.
_HELD = 400_000

_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() and b < 0x80 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences and documents per language, source and term, combined before the shuffle."""
    counts: dict[tuple[str, str], dict[bytes, int]] = {}  # occurrences in the high half, documents in the low
    held = 0

    def passed_on() -> pd.DataFrame:
        rows = [(*group, t.decode("utf-8", "surrogatepass"), n >> 32, n & 0xFFFFFFFF) for group, own in counts.items() for t, n in own.items()]
        counts.clear()
        return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
            known = counts.setdefault((lang, source), {})
            held -= len(known)
            for term, n in Counter(terms_of(text)).items():
                known[term] = known.get(term, 0) + (n << 32 | 1)
            held += len(known)
            if held > _HELD:
                yield passed_on()
                held = 0
    if held:
        yield passed_on()


def _probability(count: Column, total: Column, vocabulary: Column) -> Column:
    """In billionths, for a kept term; decimals, since counts times a billion outgrow a long."""
    over = total.cast("decimal(20,0)") + 2 * vocabulary.cast("decimal(18,0)")
    share = F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), over)
    return (F.lit(1) + share).cast("long")


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class _Kept:
    """The rows of a group kept so far; terms are compared by their first eight bytes, then whole where those are equal."""

    def __init__(self):
        self.total, self.start, self.term = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, object)

    def add(self, total: np.ndarray, start: np.ndarray, term: np.ndarray) -> None:
        self.total, self.start, self.term = np.r_[self.total, total], np.r_[self.start, start], np.r_[self.term, term]

    def dominators(self, total: np.ndarray, start: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
        """How many rows dominate each given one, or k if there are more."""
        found = np.zeros(len(total), dtype=np.int64)
        for low in range(0, len(self.total), 256):
            rows = np.flatnonzero(found < k)
            held = slice(low, low + 256)
            near = self.total[held][None, :] <= total[rows, None]
            less = near & (self.start[held][None, :] < start[rows, None])
            same = near & (self.start[held][None, :] == start[rows, None])
            for i, j in zip(*np.nonzero(same)):
                less[i, j] = self.term[low + j] < term[rows[i]]
            found[rows] += less.sum(axis=1)
        return np.minimum(found, k)


def _starts(terms: np.ndarray) -> np.ndarray:
    """The first eight bytes of each term as a number; missing bytes count as zero, which no term holds."""
    return np.array([int.from_bytes(t.encode("utf-8", "surrogatepass")[:8].ljust(8, b"\0"), "big") for t in terms], dtype=np.uint64)


def _skyband(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Of rows sorted by group, count (falling), count in the language and term, those dominated by fewer than k.

    Whoever dominates a row comes before it. It is enough to compare with rows kept so far, since a row that was left out has k
    dominators among them, and they dominate whatever it dominates.
    """
    group, kept = None, _Kept()
    for batch in batches:
        out = []
        for key, rows in batch.groupby(["lang", "source"], sort=False):
            if key != group:
                group, kept = key, _Kept()
            for first in range(0, len(rows), 512):
                step = rows.iloc[first : first + 512]
                total, term = step["lang_n"].to_numpy(np.int64), step["term"].to_numpy(object)
                start = _starts(term)
                # Rows that those kept before the step already rule out; then the few others one by one.
                ruled = kept.dominators(total, start, term, k)
                picked = []
                for i in np.flatnonzero(ruled < k):
                    more = sum(1 for j in picked if total[j] <= total[i] and term[j] < term[i])
                    if ruled[i] + more < k:
                        picked.append(i)
                kept.add(total[picked], start[picked], term[picked])
                out.append(step.iloc[picked])
        if out:
            yield pd.concat(out)


_GROUP = ["lang", "source"]


def _top_terms(rated: DataFrame, top: int) -> DataFrame:
    # Whoever dominates a term with p > q has p > q too, so the others can go first.
    own = rated.where("p > q")
    order = [*_GROUP, F.col("n").desc(), "lang_n", "term"]
    local = own.sortWithinPartitions(*order).mapInPandas(lambda batches: _skyband(batches, top), own.schema)
    merged = stash(local, "skybands").repartition(*_GROUP).sortWithinPartitions(*order)
    merged = merged.mapInPandas(lambda batches: _skyband(batches, top), own.schema)
    value = _divergence(F.col("p"), F.col("q"))
    best = merged.select(*_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    return _ranked(best).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order).cast("int"))


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Divergence of every two sources of a language, summed over its kept terms."""
    kept = F.col("vocabulary") > 0
    absent = F.when(kept, _probability(F.lit(0).cast("long"), F.col("group_total"), F.greatest("vocabulary", F.lit(1))))
    groups = stash(groups.select(*_GROUP, "vocabulary", F.coalesce(absent, F.lit(0)).alias("absent")), "absent")
    one = groups.select("lang", F.col("source").alias("g"), F.col("absent").alias("g0"), "vocabulary")
    other = groups.select("lang", F.col("source").alias("h"), F.col("absent").alias("h0"))

    def change(p: Column) -> Column:
        """What a term of probability p in g, absent from h, adds to that of a term absent from both."""
        return _divergence(p, F.col("h0")) - _divergence(F.col("g0"), F.col("h0"))

    terms = counts.select("lang", "term", F.col("source").alias("g"), "p")
    levels = looked_up(stash(terms.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("n")), "levels"), one, ["lang", "g"])
    alone = levels.join(other, "lang").where("g <> h").select("lang", "g", "h", (F.col("n") * change(F.col("p"))).alias("value"))
    mirrored = alone.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value")
    absent_too = one.join(other, "lang").where("g <> h").select(
        "lang", "g", "h", F.when(kept, F.col("vocabulary") * _divergence(F.col("g0"), F.col("h0"))).otherwise(F.lit(0)).alias("value")
    )
    left = looked_up(terms, one.select("lang", "g", "g0"), ["lang", "g"])
    right = looked_up(terms, one.select("lang", "g", "g0"), ["lang", "g"]).select(
        "lang", "term", F.col("g").alias("h"), F.col("p").alias("q"), F.col("g0").alias("h0")
    )
    p, q, g0, h0 = map(F.col, ("p", "q", "g0", "h0"))
    both = _divergence(p, q) - _divergence(p, h0) - _divergence(g0, q) + _divergence(g0, h0)
    shared = left.join(right, ["lang", "term"]).where("g < h").groupBy("lang", "g", "h").agg(F.sum(both).alias("value"))
    shared = stash(shared, "shared-terms")
    shared = shared.unionByName(shared.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    summed = shared.unionByName(alone).unionByName(mirrored).unionByName(absent_too).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    return _ranked(summed.select("lang", F.col("g").alias("source"), F.lit("pair").alias("part"), F.col("h").alias("item"), "value"))


def divergence_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` of all pairs of sources and the first terms of every source."""
    ship_package(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = texts.mapInPandas(_counted, "lang string, source string, term string, n long, docs long")
    # One exchange, by language and term, serves the counts per source, the counts per language and their join.
    found = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = stash(found, "term-counts")
    of_lang = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    of_lang = stash(of_lang.select("lang", "term", "lang_n"), "kept-terms")
    counts = stash(found.select(*_GROUP, "term", "n").join(of_lang, ["lang", "term"]), "kept-counts")
    langs = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    sizes = counts.groupBy(*_GROUP).agg(F.sum("n").alias("group_total"))
    groups = texts.select(*_GROUP).distinct().join(sizes, _GROUP, "left").join(langs, "lang", "left")
    groups = stash(groups.fillna(0, ["group_total", "vocabulary", "lang_total"]), "groups")
    rated = looked_up(counts, groups, _GROUP)
    p = _probability(F.col("n"), F.col("group_total"), F.col("vocabulary"))
    q = _probability(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    rated = stash(rated.select(*_GROUP, "term", "n", "lang_n", p.alias("p"), q.alias("q")), "rated")
    return _pairs(rated, groups).unionByName(_top_terms(rated, top))
