"""Token counts of a byte-pair vocabulary by rank-synchronous merging of ragged arrays.

A text is cut at white space; what a piece contributes depends on the piece alone,
so every distinct piece of a batch is merged once. The merging holds all symbols of
all pending pre-tokens in one flat array: in every round each pre-token finds its
lowest-ranked adjacent pair and all of them apply theirs at once, until no pair is left.

Missing and empty texts have no tokens; equal rows are counted each for itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pieces remembered by a task before it starts afresh.
REMEMBERED = 1_000_000
_NO_RANK = np.iinfo(np.int32).max
# The code points that the tokenizer's \s covers.
_SPACE = " \t\n\v\f\r\x85\xa0  -     　"
_UNSPACED = re.compile(f"[^{_SPACE}]+")
# str.split() also splits at these.
_SEPARATORS = re.compile("[\x1c-\x1f]")


@dataclass(frozen=True)
class Vocabulary:
    """Arrays of one byte-level vocabulary with word ends: small, and shipped to every task."""

    pattern: str
    special: tuple[str, ...]
    size: int
    inner: np.ndarray  # symbol of a byte inside a pre-token
    final: np.ndarray  # symbol of a pre-token's last byte
    pairs: np.ndarray  # sorted left * size + right
    ranks: np.ndarray
    merged: np.ndarray


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    letters = dict(zip(shown, map(chr, shown))) | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a ``tokenizers`` file whose steps are NFC, white space, lower case, a split pattern and byte-level pairs."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
    split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
    if steps != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or byte_level["use_regex"] or not split["invert"]:
        raise ValueError("the file names steps that this counter does not take")
    ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
    size = max(ids.values()) + 1
    letters = byte_letters()
    pairs, ranks, merged = [], [], []
    for rank, (left, right) in enumerate(model["merges"]):
        pairs.append(ids[left] * size + ids[right])
        ranks.append(rank)
        merged.append(ids[left + right])
    order = np.argsort(np.array(pairs, dtype=np.int64), kind="stable")
    return Vocabulary(
        split["pattern"]["Regex"],
        tuple(t["content"] for t in spec["added_tokens"]),
        size,
        np.array([ids[c] for c in letters], dtype=np.int64),
        np.array([ids[c + suffix] for c in letters], dtype=np.int64),
        np.array(pairs, dtype=np.int64)[order],
        np.array(ranks, dtype=np.int32)[order],
        np.array(merged, dtype=np.int64)[order],
    )


def surviving_symbols(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """How many symbols each non-empty pre-token keeps when no pair can be merged any more."""
    v = vocabulary
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts = lengths.copy()
    if not len(words):
        return counts
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    symbols = v.inner[raw]
    last = np.cumsum(lengths) - 1
    symbols[last] = v.final[raw[last]]
    owner = np.repeat(np.arange(len(words)), lengths)
    while len(symbols) > 1:
        pair = symbols[:-1] * v.size + symbols[1:]
        place = np.minimum(np.searchsorted(v.pairs, pair), len(v.pairs) - 1)
        rank = np.where((v.pairs[place] == pair) & (owner[:-1] == owner[1:]), v.ranks[place], _NO_RANK)
        starts = np.flatnonzero(np.r_[True, owner[1:-1] != owner[:-2]])
        lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(rank)]))
        chosen = np.flatnonzero((rank == lowest) & (rank != _NO_RANK))
        if not len(chosen):
            break
        # In a run of overlapping pairs, as in "aaa", every other one is applied from the left.
        run_start = np.r_[True, np.diff(chosen) != 1]
        in_run = np.arange(len(chosen)) - np.maximum.accumulate(np.where(run_start, np.arange(len(chosen)), 0))
        chosen = chosen[in_run % 2 == 0]
        symbols[chosen] = v.merged[place[chosen]]
        counts -= np.bincount(owner[chosen], minlength=len(counts))
        active = np.zeros(len(counts), dtype=bool)
        active[owner[chosen]] = True
        stays = active[owner]
        stays[chosen + 1] = False
        symbols, owner = symbols[stays], owner[stays]
    return counts


class TokenCounter:
    """Counts texts; remembers a bounded number of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self._vocabulary = vocabulary
        self._pattern = regex.compile(vocabulary.pattern)
        self._special = re.compile("|".join(map(re.escape, vocabulary.special))) if vocabulary.special else None
        self._known: dict[str, int] = {}
        self._words: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        extra, cut = [], []
        for text in texts:
            special = 0
            if self._special is not None and "<" in text:
                text, special = self._special.subn(" ", text)
            extra.append(special)
            cut.append(text.split() if _SEPARATORS.search(text) is None else _UNSPACED.findall(text))
        fresh = set().union(*cut).difference(self._known)
        if len(self._known) + len(fresh) > REMEMBERED:
            self._known.clear()
            fresh = set().union(*cut)
        self._learn(list(fresh))
        known = self._known.__getitem__
        return [special + sum(map(known, pieces)) for special, pieces in zip(extra, cut)]

    def _learn(self, pieces: list[str]) -> None:
        cut = []
        for piece in pieces:
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            piece = piece.lower()
            if piece.isalpha():
                cut.append((piece,))
            elif piece[-1] in ".,;:!?" and piece[:-1].isalpha():
                cut.append((piece[:-1], piece[-1]))
            else:
                cut.append(self._pattern.findall(piece))
        fresh = list(set().union(*cut).difference(self._words))
        if len(self._words) + len(fresh) > REMEMBERED:
            self._words.clear()
            fresh = list(set().union(*cut))
        counts = surviving_symbols([word.encode("utf-8") for word in fresh], self._vocabulary)
        self._words.update(zip(fresh, counts.tolist()))
        known = self._words.__getitem__
        self._known.update((piece, sum(map(known, parts))) for piece, parts in zip(pieces, cut))


_counters: dict[int, TokenCounter] = {}


def counter_of(vocabulary: Vocabulary) -> TokenCounter:
    """One counter per vocabulary and worker process, so that tasks profit from each other's pieces."""
    key = hash((vocabulary.pattern, vocabulary.special, vocabulary.pairs.tobytes(), vocabulary.ranks.tobytes()))
    if key not in _counters:
        _counters.clear()
        _counters[key] = TokenCounter(vocabulary)
    return _counters[key]


# Texts counted at once: bounds what one step holds next to the Arrow batch.
_STEP_CHARS = 4_000_000


def _steps(texts: list[str]) -> Iterator[list[str]]:
    step, size = [], 0
    for text in texts:
        step.append(text)
        size += len(text)
        if size >= _STEP_CHARS:
            yield step
            step, size = [], 0
    if step:
        yield step


def token_count(text: Column, vocabulary: Vocabulary) -> Column:
    """Tokens of a text column."""
    shipped = vocabulary

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(shipped)
        for texts in batches:
            yield pd.Series([n for step in _steps(texts.tolist()) for n in counter.counts(step)], dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, vocabulary: Vocabulary, limit: int = 2048) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_tokens`` and whether they are over the limit.

    A missing text counts as empty, a missing id is kept, an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, vocabulary).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
