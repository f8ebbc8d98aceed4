"""Quality network and mixing."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loanloom.llm import mixing, quality
from loanloom.llm.common import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled():
    labels = {r["doc_id"]: r for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    docs = pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text"]).to_pylist()
    return [(d["doc_id"], d["text"], labels[d["doc_id"]]) for d in docs if d["doc_id"] in labels]


# --- quality ----------------------------------------------------------------------------------


def test_held_out_accuracy(spark, labelled):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    net = quality.fit_quality(docs, labels)
    held = [(t, la["quality"]) for i, t, la in labelled if zlib.crc32(str(i).encode()) % 4 == 2]
    score = quality.scores([t.encode() for t, _ in held], net)
    truth = np.array([q for _, q in held])
    assert ((score >= quality.ACCEPTED) == truth).mean() > 0.97
    assert (score[truth == 1] >= quality.ACCEPTED).mean() > 0.99


def test_held_out_rows(spark):
    ids = spark.range(200).select(F.col("id").alias("doc_id"))
    for r in ids.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_whole_texts_are_convolved(monkeypatch):
    """Scores equal a plain computation over every window, whatever the steps."""
    rng = np.random.default_rng(2)
    net = quality.Network.fresh(3)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 7, 127, 128, 129, 1000, 5000)]

    def plain(raw):
        data = quality.padded(raw)
        places = range(0, len(data) - quality.WIDTH + 1, quality.STRIDE)
        response = np.array([sum(net.filters[j][data[p + j]] for j in range(quality.WIDTH)) + net.bias for p in places])
        per_cell = quality.CELL // quality.STRIDE
        cells = [response[i : i + per_cell].max(0) for i in range(0, len(response), per_cell)]
        chunks = np.array([np.maximum(np.maximum(a, b), 0) for a, b in zip(cells, cells[1:])])
        z = chunks.mean(0) @ net.mean_weight + chunks.max(0) @ net.max_weight + net.offset
        return 1 / (1 + np.exp(-z))

    whole = quality.scores(texts, net)
    alone = np.array([quality.scores([t], net)[0] for t in texts])
    assert whole == pytest.approx(alone, abs=1e-5)
    assert alone == pytest.approx([plain(t) for t in texts], abs=1e-5)
    monkeypatch.setattr(quality, "_STEP", 256)
    assert quality.scores(texts, net) == pytest.approx(whole, abs=1e-5)


def test_gradients_by_differences():
    rng = np.random.default_rng(5)
    net = quality.Network.fresh(1)
    data = quality.padded(bytes(rng.integers(97, 123, 700, dtype=np.uint8)))
    grad = quality.Network(*[np.zeros_like(getattr(net, n)) for n in ("filters", "bias", "mean_weight", "max_weight")], 0.0)
    quality._gradients(data, 1.0, 1.0, net, grad)

    def loss():
        p = quality.scores([bytes(data[:700])], net)[0]
        return -np.log(p)

    for name, place in (("mean_weight", 3), ("max_weight", 5), ("bias", 2), ("filters", (2, 101, 4))):
        array, step = getattr(net, name), 1e-2
        kept = array[place]
        array[place] = kept + step
        up = loss()
        array[place] = kept - step
        down = loss()
        array[place] = kept
        assert (up - down) / (2 * step) == pytest.approx(float(getattr(grad, name)[place]), abs=2e-3)


def test_without_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit_quality(odd_docs, none)
    scored = odd_docs.select(quality.score_column(F.col("text"), net).alias("s")).collect()
    assert [r.s for r in scored] == pytest.approx([0.5] * 8)
    assert no_docs.select(quality.score_column(F.col("text"), net)).collect() == []


# --- mixing -----------------------------------------------------------------------------------


def test_domains_of_documents(labelled):
    number = [2 if la["quality"] == 0 else la["toxic"] for _, _, la in labelled]
    cut = len(labelled) * 3 // 4
    words = [mixing.features_of(t, mixing.words_of(t)) for _, t, _ in labelled]
    train = np.array(number[:cut])
    model = mixing.train_domains(words[:cut], train, np.bincount(train, minlength=3) / cut)
    posterior = np.stack([model.posterior(w) for w in words[cut:]])
    assert (posterior.argmax(1) == np.array(number[cut:])).mean() > 0.85


def test_rates_meet_targets(spark):
    """The distributed solution equals projected gradient over all documents at once."""
    rng = np.random.default_rng(1)
    posterior = rng.dirichlet([0.3, 0.3, 0.3], 500)
    tokens = rng.integers(0, 3000, 500)
    rows = [(int(n), p.tolist()) for n, p in zip(tokens, posterior)]
    members = spark.createDataFrame(rows, "n_tokens long, posterior array<double>").repartition(4)
    targets = {"clean": 0.6, "toxic": 0.3, "junk": 0.1}
    residuals = mixing.solve_rates(members, targets)
    rate = mixing.rates_of(posterior, residuals)
    total = tokens.sum()
    share, wanted = tokens @ posterior / total, np.array([0.6, 0.3, 0.1])
    plain = np.ones(500)
    for _ in range(len(residuals)):
        miss = (tokens * plain) @ posterior / total - wanted
        plain = np.maximum(0, plain - (posterior @ (miss / share) + mixing.RIDGE * (plain - 1)) / (1 + mixing.RIDGE))
    assert rate == pytest.approx(plain, abs=1e-9) and (rate >= 0).all()
    assert (tokens * rate) @ posterior / total == pytest.approx(wanted, abs=5e-3)


def test_targets_out_of_reach(spark):
    """Hardly any junk to meet its target with: the rates are those of the converged least squares."""
    rng = np.random.default_rng(5)
    clean = rng.random(1500) < 0.93
    posterior = np.stack([rng.dirichlet([40, 0.5, 0.1] if c else [0.5, 40, 0.1]) for c in clean])
    tokens = rng.integers(1, 3000, 1500)
    rows = [(int(n), p.tolist()) for n, p in zip(tokens, posterior)]
    members = spark.createDataFrame(rows, "n_tokens long, posterior array<double>").repartition(4)
    rate = mixing.rates_of(posterior, mixing.solve_rates(members, mixing.TARGETS))
    total, wanted = tokens.sum(), np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    share, plain = tokens @ posterior / total, np.ones(1500)
    for _ in range(40_000):
        miss = (tokens * plain) @ posterior / total - wanted
        plain = np.maximum(0, plain - (posterior @ (miss / share) + mixing.RIDGE * (plain - 1)) / (1 + mixing.RIDGE))
    assert rate == pytest.approx(plain, abs=1e-3)


def test_mixture_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 1), (5, 0, 0), (5, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    out = mixing.mixture(odd_docs.withColumn("mix_rate", F.lit(9)), labels)
    rows = out.collect()
    assert out.columns[: len(odd_docs.columns)] == odd_docs.columns and len(rows) == 8
    assert all(r.mix_rate >= 0 and abs(sum(r.mix_posterior) - 1) < 1e-9 for r in rows)
    assert all(abs(r.mix_copies - r.mix_rate) < 1 for r in rows)
    assert mixing.mixture(no_docs, labels).collect() == []
    bare = mixing.mixture(odd_docs, labels.limit(0)).collect()
    assert {tuple(r.mix_posterior) for r in bare} == {(1 / 3, 1 / 3, 1 / 3)}
