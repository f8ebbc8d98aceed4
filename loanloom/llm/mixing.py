"""Mixing sources to target weights with soft membership.

A classifier trained on the labelled table gives every document a posterior over domains, ``clean``, ``toxic`` and
``junk``. A document of n tokens and rate r adds r * n * posterior to the expected tokens of the domains. The rates
are found by weighted least squares: with e the difference between the domains' shares and
their targets and s their shares at rate 1,

    minimise  sum_k e_k^2 / (2 s_k)  +  ridge / 2 * sum_d n_d (r_d - 1)^2 / total     over r >= 0.

In the metric of token counts the curvature is at most 1 + ridge, so projected gradient with the step 1 / (1 + ridge)
converges. A round is one aggregation of as many sums as there are domains; a document's rate follows from its
posterior and the rounds' residuals, so no rates are stored between rounds and a lost executor's part is simply
computed again. After the rounds, Newton steps on the dual, which has one unknown z per domain, begin from their end.
The duality gap bounds how far the rounds' rates are from the solution: once it shows them within ``RATE_ERROR``, they
stand; else, as with targets that cannot be met, the steps go on to the solution r = max(0, 1 - posterior . z). If
even they do not converge, an error is raised.

The classifier takes a bounded sample of labelled rows (see ``quality.SAMPLE_ROWS``). Documents without words have
no tokens and the posterior of the intercepts. Without labels the posteriors are uniform, and targets that cannot be
met are met as nearly as least squares can. Repeated rows count each for themselves; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import stash
from loanloom.llm.licenses import words_of
from loanloom.llm.quality import SAMPLE_BYTES, SAMPLE_ROWS

DOMAINS = ["clean", "toxic", "junk"]
TARGETS = {"clean": 0.95, "toxic": 0.03, "junk": 0.02}
RIDGE = 1e-3
ROUNDS, TOLERANCE = 40, 1e-5
# Root mean square over tokens by which the rates of the gradient rounds may miss the solution.
RATE_ERROR = 0.01
# Newton rounds, each one aggregation for all its step lengths, and the like error they end at.
NEWTON_ROUNDS, NEWTON_ERROR, HALVINGS = 50, 1e-6, 12
# A feature enters the classifier if some domain's documents hold it this many deviations more often than all do.
LEAST_DEVIATION = 3.5


@dataclass(frozen=True)
class DomainModel:
    weights: dict[bytes, np.ndarray]
    intercept: np.ndarray

    def posterior(self, features: set[bytes]) -> np.ndarray:
        score = self.intercept.copy()
        for feature in sorted(self.weights.keys() & features):
            score += self.weights[feature]
        score = np.exp(score - score.max())
        return score / score.sum()


_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = b"!#$%&*+/<=>?@[\\]^_`{|}~"


def features_of(text: str, words: list[bytes]) -> set[bytes]:
    """The distinct words of a text, and marks of its make-up, which no word can equal."""
    found, raw = set(words), text.encode("utf-8", "surrogatepass")
    for name, share in (
        (b"\x01capitals", 1 - len(raw.translate(None, _CAPITALS)) / max(1, len(raw))),
        (b"\x01symbols", 1 - len(raw.translate(None, _SYMBOLS)) / max(1, len(raw))),
        (b"\x01repeats", 1 - len(found) / max(1, len(words))),
    ):
        found.update(name + str(step).encode() for step in (1, 2, 4, 8) if share * 16 >= step)
    return found


def domain(quality: Column, toxic: Column) -> Column:
    """Number of the domain of a labelled document; NULL where its labels are missing."""
    return F.when(quality == 0, 2).when(toxic == 1, 1).when((quality == 1) & (toxic == 0), 0)


def telling_features(texts: list[set[bytes]], domains: np.ndarray) -> list[bytes]:
    held: list[Counter[bytes]] = [Counter() for _ in DOMAINS]
    for features, number in zip(texts, domains):
        held[number].update(features)
    total = sum(held, Counter())
    shares = np.bincount(domains, minlength=len(DOMAINS)) / max(1, len(domains))

    def tells(feature: bytes) -> bool:
        n = total[feature]
        return any(
            own[feature] - n * share > LEAST_DEVIATION * np.sqrt(n * share * (1 - share) + 1)
            for own, share in zip(held, shares)
        )

    return sorted(filter(tells, total))


def train_domains(texts: list[set[bytes]], domains: np.ndarray, shares: np.ndarray, epochs: int = 12) -> DomainModel:
    """Softmax regression on which features a text holds, with adaptive steps; intercepts moved to the true shares."""
    index = {w: i for i, w in enumerate(telling_features(texts, domains))}
    rows = [np.array(sorted(index[w] for w in index.keys() & features), dtype=np.int64) for features in texts]
    k, rng = len(DOMAINS), np.random.default_rng(11)
    weight, bias = np.zeros((len(index), k)), np.zeros(k)
    square, bias_square = np.full((len(index), 1), 1e-2), 1e-2
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            row = rows[i]
            z = bias + weight[row].sum(0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[domains[i]] -= 1
            scale = float(p @ p)
            bias_square += scale
            square[row, 0] += scale
            weight[row] -= 0.3 * (p + 1e-4 * weight[row]) / np.sqrt(square[row])
            bias -= 0.1 * p / np.sqrt(bias_square)
    drawn = np.bincount(domains, minlength=k) + 0.5
    bias += np.log(np.maximum(shares, 1e-6)) - np.log(drawn / drawn.sum())
    return DomainModel({w: weight[i] for w, i in index.items()}, bias)


def fit_domains(docs: DataFrame, labels: DataFrame) -> DomainModel:
    known = (
        labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain"))
        .where("domain IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("domain").alias("domain"))
    )
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    if not counts:
        return DomainModel({}, np.zeros(len(DOMAINS)))
    picked = None
    for number in range(len(DOMAINS)):
        own = known.where(F.col("domain") == number).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS // len(DOMAINS))
        picked = own if picked is None else picked.unionByName(own)
    sample = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .where(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "domain")
        .agg(F.min("text").alias("text"))
        .toPandas()  # at most SAMPLE_ROWS texts of SAMPLE_BYTES
        .sort_values("doc_id", ignore_index=True)
    )
    shares = np.array([counts.get(d, 0) for d in range(len(DOMAINS))], dtype=float) + 0.5
    return train_domains([features_of(t, words_of(t)) for t in sample["text"]], sample["domain"].to_numpy(np.int64), shares / shares.sum())


def rates_of(posterior: np.ndarray, residuals: list[np.ndarray], ridge: float = RIDGE) -> np.ndarray:
    """The rates after the rounds whose weighted residuals are given."""
    rate = np.ones(len(posterior))
    for residual in residuals:
        rate = np.maximum(0.0, rate - (posterior @ residual + ridge * (rate - 1)) / (1 + ridge))
    return rate


def _tokens_and_posteriors(text: Column, model: DomainModel) -> Column:
    @F.pandas_udf("n_tokens long, posterior array<double>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sizes, posteriors = [], []
            for text in texts:
                words = words_of(text)
                sizes.append(len(words))
                posteriors.append(model.posterior(features_of(text, words)))
            yield pd.DataFrame({"n_tokens": sizes, "posterior": posteriors})

    return judged(F.coalesce(text, F.lit("")))


def _rate_column(posterior: Column, residuals: list[np.ndarray], ridge: float) -> Column:
    @F.pandas_udf("double")
    def rated(values: pd.Series) -> pd.Series:
        return pd.Series(rates_of(np.stack(values.to_list()), residuals, ridge) if len(values) else [], dtype="float64")

    return rated(posterior)


def solve_rates(members: DataFrame, targets: dict[str, float], ridge: float = RIDGE) -> list[np.ndarray]:
    """Weighted residuals of each round, or one that stands for the Newton solution, over ``n_tokens, posterior``; ``rates_of`` turns them into rates."""
    wanted = np.array([targets.get(d, 0.0) for d in DOMAINS])
    wanted = wanted / wanted.sum()

    def tokens(rate: Column) -> np.ndarray:
        sums = [F.sum(F.col("n_tokens") * rate * F.element_at("posterior", k + 1)) for k in range(len(DOMAINS))]
        return np.array([v or 0.0 for v in members.agg(*sums).first()])

    natural = tokens(F.lit(1.0))
    total, residuals, current = natural.sum(), [], natural
    if not total:
        return residuals
    share = natural / total
    for _ in range(ROUNDS):
        miss = current / total - wanted
        if np.abs(miss[share > 0]).max() < TOLERANCE:
            break
        residuals.append(np.where(share > 0, miss / np.maximum(share, 1e-12), 0.0))
        before = current
        current = tokens(_rate_column(F.col("posterior"), residuals, ridge))
        if np.abs(current - before).max() < TOLERANCE * 0.1 * total:
            break
    rate = _rate_column(F.col("posterior"), residuals, ridge)
    moved = (members.agg(F.sum(F.col("n_tokens") * (rate - 1) * (rate - 1))).first()[0] or 0.0) / total
    held = share > 0
    miss = np.where(held, current / total - wanted, 0.0)
    weighted = np.where(held, miss / np.where(held, share, 1.0), 0.0)
    primal = miss @ weighted / 2 + ridge / 2 * moved
    z = _newton(members, weighted / ridge, primal, share, wanted, total, ridge)
    # From the rate 1, a single round with this residual gives max(0, 1 - posterior . z).
    return residuals if z is None else [(1 + ridge) * z]


_Dual = tuple[float, np.ndarray, np.ndarray]


def _dual(
    members: DataFrame, points: list[np.ndarray], share: np.ndarray, wanted: np.ndarray, total: float, ridge: float
) -> list[_Dual]:
    """Value, gradient and curvature of the dual, to be minimised, at every point; one aggregation for all."""
    k = len(DOMAINS)
    names = [f"s{i}" for i in range(1 + k + k * k)]

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(points), len(names)))
        for batch in batches:
            if not len(batch):
                continue
            n, posterior = batch["n_tokens"].to_numpy(np.float64), np.stack(batch["posterior"].to_list())
            for i, z in enumerate(points):
                rate = np.maximum(0.0, 1 - posterior @ z)
                active = n * (rate > 0)
                sums[i] += np.r_[n @ rate**2, (n * rate) @ posterior, ((active[:, None] * posterior).T @ posterior).ravel()]
        yield pd.DataFrame(sums, columns=names).assign(point=np.arange(len(points)))

    parts = members.select("n_tokens", "posterior").mapInPandas(summed, ", ".join(f"{c} double" for c in names) + ", point int")
    rows = parts.groupBy("point").agg(*[F.sum(c).alias(c) for c in names]).orderBy("point").collect()
    found = []
    for z, row in zip(points, rows):
        sums = np.array([row[c] for c in names]) / total
        value = ridge * (share @ z**2) / 2 + np.where(share > 0, wanted, 0.0) @ z + sums[0] / 2
        found.append((value, ridge * share * z + wanted - sums[1 : 1 + k], sums[1 + k :].reshape(k, k) + ridge * np.diag(share)))
    return found


def _newton(
    members: DataFrame, z: np.ndarray, primal: float, share: np.ndarray, wanted: np.ndarray, total: float, ridge: float
) -> np.ndarray | None:
    """The minimum of the dual, or None once it shows that rates of this primal value are near enough.

    Domains that no document belongs to keep 0.
    """
    held = np.flatnonzero(share > 0)
    scale = 1 / np.sqrt(share[held])
    at = _dual(members, [z], share, wanted, total, ridge)[0]
    for _ in range(NEWTON_ROUNDS):
        value, gradient, curvature = at
        if 2 * (primal - ridge * (0.5 - value)) <= ridge * RATE_ERROR**2:
            return None
        own = scale[:, None] * curvature[np.ix_(held, held)] * scale
        step = np.zeros_like(z)
        step[held] = scale * np.linalg.solve(own, scale * gradient[held])
        # Bounds the mean square change of the rates.
        if gradient[held] @ step[held] <= NEWTON_ERROR**2:
            return z
        points = [z - step / 2**i for i in range(HALVINGS)]
        tried = _dual(members, points, share, wanted, total, ridge)
        best = min(range(HALVINGS), key=lambda i: tried[i][0])
        z, at = points[best], tried[best]
    raise RuntimeError(f"mixing rates did not converge in {NEWTON_ROUNDS} Newton rounds")


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies that equal the rate on average, decided by the id alone."""
    drawn = F.pmod(F.xxhash64(doc_id, F.lit("mixing")), F.lit(1_000_000)) / 1_000_000.0
    return F.floor(rate + drawn).cast("long")


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, ridge: float = RIDGE) -> DataFrame:
    """All rows and columns of ``docs`` (but any of these names) with ``mix_tokens, mix_posterior, mix_rate, mix_copies``."""
    model = fit_domains(docs, labels)
    judged = docs.select("doc_id", _tokens_and_posteriors(F.col("text"), model).alias("found"))
    members = stash(judged.select("found.n_tokens", "found.posterior"), "members")
    residuals = solve_rates(members, targets, ridge)
    held = "mix_found"
    while held in {c.lower() for c in docs.columns}:
        held += "_"
    found = docs.withColumn(held, _tokens_and_posteriors(F.col("text"), model))
    rated = found.withColumn("mix_rate", _rate_column(F.col(f"{held}.posterior"), residuals, ridge))
    return rated.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("mix_tokens", "mix_posterior", "mix_rate", "mix_copies")],
        F.col(f"{held}.n_tokens").alias("mix_tokens"), F.col(f"{held}.posterior").alias("mix_posterior"),
        "mix_rate", copies(F.col("mix_rate"), F.col("doc_id")).alias("mix_copies"),
    )
