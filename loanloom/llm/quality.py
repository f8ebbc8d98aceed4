"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are covered whole by overlapping chunks of two cells each, every cell belonging to two chunks.
Learned filters run over the bytes, are max-pooled in each chunk, and the chunks' activations are combined, by
their mean and by their maximum, into one probability. Nothing but the text enters a score.

Training takes a bounded sample of labelled rows (``SAMPLE_ROWS``, whole texts of at most ``SAMPLE_BYTES``),
half of each class where there are enough, weighted back to the share of the classes. Every text is scored whole.

Missing and empty texts are scored as texts of no bytes. Repeated rows get equal scores. Where the labels do not
hold both classes, every score is the share of label 1 (0.5 without labels). A document with several labels counts
with the lowest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import released, ship_package

SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 20_000
FILTERS, WIDTH, STRIDE, CELL = 16, 8, 2, 128
EPOCHS, BATCH, RATE = 6, 32, 0.02
ACCEPTED = 0.7
# Bytes convolved at once.
_STEP = 1 << 18


@dataclass
class Network:
    """``filters``: weight of each byte value at each place of each filter."""

    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    mean_weight: np.ndarray
    max_weight: np.ndarray
    offset: float

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(
            draw(WIDTH, 256, FILTERS, scale=0.15), np.zeros(FILTERS, np.float32),
            draw(FILTERS, scale=0.3), draw(FILTERS, scale=0.1), 0.0,
        )


def padded(raw: bytes) -> np.ndarray:
    """The bytes, then zeros up to whole cells and at least a filter's width."""
    cells = max(2, -(-(len(raw) + WIDTH) // CELL))
    return np.frombuffer(raw.ljust(cells * CELL, b"\0"), dtype=np.uint8)


def convolve(data: np.ndarray, last: np.ndarray, net: Network) -> np.ndarray:
    """Filter responses at every other byte of whole cells: (cells, places, FILTERS).

    In a text's last cell, which ``last`` tells, places that would reach beyond the text do not count.
    """
    data = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    places = (len(data) - WIDTH) // STRIDE
    total = np.tile(net.bias, (places, 1))
    for j in range(WIDTH):
        total += net.filters[j].take(data[j : j + places * STRIDE : STRIDE], axis=0)
    response = total.reshape(-1, CELL // STRIDE, FILTERS)
    response[last, (CELL - WIDTH) // STRIDE + 1 :] = -np.inf
    return response


def cell_peaks(texts: list[np.ndarray], net: Network) -> np.ndarray:
    """The largest response of each filter in every cell of all texts, computed in bounded steps."""
    data = np.concatenate(texts)
    last = np.zeros(len(data) // CELL, dtype=bool)
    last[np.cumsum([len(t) // CELL for t in texts]) - 1] = True
    whole = _STEP // CELL * CELL
    # A step reads a filter's width into the next one, so the cuts change nothing.
    peaks = []
    for start in range(0, len(data), whole):
        piece = data[start : start + whole + CELL]
        response = convolve(piece, last[start // CELL :][: len(piece) // CELL], net).max(axis=1)
        peaks.append(response[: min(whole, len(data) - start) // CELL])
    return np.concatenate(peaks)


def scores(texts: list[bytes], net: Network) -> np.ndarray:
    rows = [padded(t) for t in texts]
    peaks = cell_peaks(rows, net)
    ends = np.cumsum([len(r) // CELL for r in rows])
    out = np.empty(len(rows))
    for i, (start, end) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
        chunks = np.maximum(np.maximum(peaks[start : end - 1], peaks[start + 1 : end]), 0)
        out[i] = chunks.mean(0) @ net.mean_weight + chunks.max(0) @ net.max_weight + net.offset
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _gradients(data: np.ndarray, label: float, weight: float, net: Network, grad: Network) -> None:
    """Adds one text's gradients."""
    response = convolve(data, np.arange(len(data) // CELL) == len(data) // CELL - 1, net)
    peak = response.argmax(axis=1)
    cells = np.take_along_axis(response, peak[:, None, :], axis=1)[:, 0, :]
    later = cells[1:] > cells[:-1]
    chunks = np.maximum(np.where(later, cells[1:], cells[:-1]), 0)
    top = chunks.argmax(0)
    mean, largest = chunks.mean(0), chunks.max(0)
    z = float(mean @ net.mean_weight + largest @ net.max_weight + net.offset)
    slope = np.float32(weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label))
    grad.mean_weight += slope * mean
    grad.max_weight += slope * largest
    grad.offset += float(slope)
    back = np.repeat((slope * net.mean_weight / len(chunks))[None, :], len(chunks), axis=0)
    back[top, np.arange(FILTERS)] += slope * net.max_weight
    back *= chunks > 0
    cell = np.arange(len(chunks))[:, None] + later
    place = cell * CELL + STRIDE * np.take_along_axis(peak, cell, axis=0)
    filters = np.broadcast_to(np.arange(FILTERS), place.shape)
    grad.bias += back.sum(0)
    data = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    for j in range(WIDTH):
        np.add.at(grad.filters[j], (data[place + j], filters), back)


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Network:
    """Minimises the weighted cross-entropy with adaptive moments."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    names = ["filters", "bias", "mean_weight", "max_weight", "offset"]
    first = {n: 0.0 for n in names}
    second = {n: 0.0 for n in names}
    rows, step = [padded(t) for t in texts], 0
    rounds = EPOCHS * max(1, -(-len(rows) // BATCH))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            grad = Network(*[np.zeros_like(getattr(net, n)) for n in names[:-1]], 0.0)
            batch = order[start : start + BATCH]
            for i in batch:
                _gradients(rows[i], labels[i], weights[i] / len(batch), net, grad)
            step += 1
            rate = RATE * (1 - step / (rounds + 1))
            for n in names:
                g = getattr(grad, n)
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                move = rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-6)
                moved = getattr(net, n) - move
                setattr(net, n, moved.astype(np.float32) if isinstance(moved, np.ndarray) else float(moved))
    return net


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> tuple[pd.DataFrame, dict[int, int]]:
    """At most ``rows`` texts outside the held-out fold, half of each class, and the classes' counts in that fold."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("label = 0").orderBy(*by_hash).limit(rows // 2).unionByName(
        known.where("label = 1").orderBy(*by_hash).limit(rows // 2)
    )
    texts = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .where(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )
    return texts.toPandas().sort_values("doc_id", ignore_index=True), counts


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    ship_package(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels, label)
    drawn = sample["label"].value_counts().to_dict()
    if len(drawn) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        net = Network.fresh()
        net.mean_weight[:], net.max_weight[:] = 0, 0
        net.offset = float(np.log(share / (1 - share)))
        return net
    total = sum(counts.values())
    weight = {c: (counts[c] / total) / (drawn[c] / len(sample)) for c in drawn}
    # The rarer class is learnt with at least a third of the weight; the offset then returns to the true shares.
    lifted = {c: max(weight[c], len(sample) / drawn[c] / 3) for c in drawn}
    y = sample["label"].to_numpy(float)
    net = train([t.encode("utf-8", "surrogatepass") for t in sample["text"]], y, np.array([lifted[int(c)] for c in y]))
    net.offset += float(np.log(weight[1] / weight[0]) - np.log(lifted[1] / lifted[0]))
    return net


def score_column(text: Column, net: Network) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(_scored(batches, net))

    return scored(F.coalesce(text, F.lit("")))


def _scored(batches: Iterator[pd.Series], net: Network) -> Iterator[pd.Series]:
    for texts in batches:
        found, step, size = [], [], 0
        for text in texts:
            step.append(text.encode("utf-8", "surrogatepass"))
            size += len(step[-1])
            if size >= 4 * _STEP:
                found.append(scores(step, net))
                step, size = [], 0
        if step:
            found.append(scores(step, net))
        yield pd.Series(np.concatenate(found) if found else [], dtype="float64")
