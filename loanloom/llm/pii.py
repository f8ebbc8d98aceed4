"""Personal data by weak supervision.

Base spans follow fixed patterns and are always kept. Further candidate spans come from looser patterns. Labelers
(pattern, checksum, gazetteer, context words, surroundings) vote for, against or abstain on every base and
candidate span. Expectation-maximisation estimates each labeler's reliability per kind without any labels. Its
posteriors are the soft labels of a logistic span classifier, which sees the votes and the span itself: shape, digit
groups, length, ends and neighbouring words, hashed. Candidates it takes for personal data are added.

Every text is surveyed once. Votes are small integers packed into one number, so the whole corpus enters the estimation as
counts of (kind, votes): at most ``len(KINDS) * 3 ** LABELERS`` rows, whatever the corpus holds. The classifier learns from
at most ``SAMPLE_SPANS`` distinct spans of each of them, those of the smallest hash, which stand for all of their pattern.

Missing and empty texts have no spans; repeated rows are scanned each for itself; with no spans at all there is
nothing to estimate and nothing is added. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.llm.common import released, ship_package, stash

KINDS = ["email", "ip", "card", "phone"]
LABELERS = 5
FOR, AGAINST, ABSTAIN = 2, 1, 0
# Distinct spans of each kind and vote pattern that the classifier learns from.
SAMPLE_SPANS = 64
# Places of hashed span features, after one per labeler and vote.
HASHED = 1 << 11

# The base patterns. A digit run can only match from its first digit, which the look-behind says.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

# Looser patterns of further candidates.
_LOOSE = {
    0: re.compile(r"\b[A-Za-z0-9._-]{2,64}[\x20]?(?:\[at\]|\(at\)|\sat\s)[\x20]?[A-Za-z0-9-]{2,63}[\x20]?(?:\[dot\]|\(dot\)|\sdot\s)[\x20]?[A-Za-z]{2,10}\b"),
    2: re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])"),
    3: re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}

# Gazetteers: top-level domains, first digits of card issuers, and first digits of country calling codes (all other
# two-digit beginnings are unassigned).
_DOMAINS = frozenset(
    """com org net edu gov mil int info biz name pro dev app io co ai me tv
    ar at au be bg br ca ch cl cn cz de dk ee es eu fi fr gr hk hr hu id ie il in ir is it jp ke kr lt lu lv ma mx my
    ng nl no nz pe ph pk pl pt ro rs ru sa se sg si sk th tr tw ua uk us vn za""".split()
)
_ISSUERS = ("4", "34", "37", "36", "38", "62", "65", "6011", *map(str, range(51, 56)), *map(str, range(644, 650)),
            *map(str, range(2221, 2721)), *map(str, range(3528, 3590)))
_COUNTRY_CODES = (
    "1", "7", *map(str, range(20, 28)), "29", *map(str, range(30, 50)), *map(str, range(50, 70)),
    *map(str, range(80, 83)), *map(str, range(84, 89)), *map(str, range(90, 100)),
)
_CONTEXT = [
    re.compile(r"(?i)\b(e-?mails?|mail|contact|write|reply|correo|courriel|kontakt)\b"),
    re.compile(r"(?i)\b(ip|ipv4|host|server|address|adresse|client|remote|login|from)\b"),
    re.compile(r"(?i)\b(card|credit|visa|mastercard|amex|karte|kreditkarte|carte|tarjeta|payment|paid)\b"),
    re.compile(r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|telefon|handy|whatsapp|sms|tel[eé]fono)\b"),
]
CONTEXT_CHARS = 40


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches found from each ``@``: the local part is the run before it, back to the match before."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            floor = found.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def _valid(kind: int, match: str) -> bool:
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in match.split("."))
    digits = _DIGITS.sub("", match)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans as (kind, start, end), by kind and start."""
    spans = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        if kind == 3 and "+" not in text:
            continue
        spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return spans


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans by start, those that overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """Base spans and looser candidates that overlap none of their kind: (kind, start, end, is base)."""
    base = base_spans(text)
    found = [(k, s, e, True) for k, s, e in base]
    for kind, pattern in _LOOSE.items():
        if kind == 0 and "dot" not in text:
            continue
        taken = _joined([(s, e) for k, s, e in base if k == kind or k == 2])
        place = 0
        for match in pattern.finditer(text):
            while place < len(taken) and taken[place][1] <= match.start():
                place += 1
            if not any(s < match.end() and match.start() < e for s, e in taken[place : place + 1]):
                found.append((kind, match.start(), match.end(), False))
    return sorted(found)


def votes(text: str, kind: int, start: int, end: int) -> int:
    """The labelers' votes on a span, packed in base three."""
    match = text[start:end]
    digits = _DIGITS.sub("", match)
    strict = AGAINST
    if kind == 0:
        strict = FOR if "@" in match and len(match) <= 254 else AGAINST
        known = FOR if re.split(r"[^A-Za-z]+", match)[-1].lower() in _DOMAINS else AGAINST
        check = AGAINST if ".." in match else ABSTAIN
    elif kind == 1:
        parts = match.split(".")
        strict = FOR if all(p == "0" or p[0] != "0" for p in parts) else AGAINST
        known = AGAINST if parts[0] in ("0", "255") else ABSTAIN
        check = FOR if _valid(kind, match) else AGAINST
    elif kind == 2:
        strict = FOR if 16 <= len(digits) <= 19 else AGAINST
        known = FOR if digits.startswith(_ISSUERS) else AGAINST
        check = FOR if luhn(digits) else AGAINST
    else:
        strict = FOR if match.startswith("+") else AGAINST
        known = FOR if match.startswith("+") and digits.startswith(_COUNTRY_CODES) else ABSTAIN
        check = FOR if 8 <= len(digits) <= 15 else AGAINST
    around = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    context = FOR if _CONTEXT[kind].search(around) else ABSTAIN
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = AGAINST if left.isalnum() or right.isalnum() or left == "." and kind == 1 else FOR
    packed = 0
    for vote in (strict, known, check, context, edges):
        packed = packed * 3 + vote
    return packed


def unpack(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed // 3**p % 3 for p in reversed(range(LABELERS))], axis=1)


_LETTERS = re.compile(r"[^\W\d_]+")
_NUMBERS = re.compile(r"[0-9]+")
_WORDS = re.compile(r"\w+")


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS]


def span_features(text: str, start: int, end: int, packed: int) -> list[int]:
    """Places of a span's features: its votes, and its hashed shape, digit groups, length, ends and neighbouring words."""
    match = text[start:end]
    before, after = _around(text, start, end)
    left, right = _WORDS.findall(before.lower())[-2:], _WORDS.findall(after.lower())[:1]
    told = [
        "shape " + _NUMBERS.sub("9", _LETTERS.sub("a", match)),
        "groups " + "-".join(str(len(g)) for g in _NUMBERS.findall(match)),
        f"length {min((end - start) // 3, 20)}",
        "first " + match[:2].lower(),
        "last " + match[-3:].lower(),
        "beside " + before[-1:] + " " + after[:1],
        *(f"left {i} {w}" for i, w in enumerate(reversed(left))),
        *(f"right {w}" for w in right),
    ]
    voted = [3 * j + int(v) for j, v in enumerate(unpack(np.array([packed]))[0])]
    return voted + [3 * LABELERS + zlib.crc32(t.encode("utf-8", "surrogatepass")) % HASHED for t in told]


def _draw(text: str, start: int, end: int) -> int:
    """A hash of the span and its surroundings; the same spans have the same one in every task."""
    seen = "\0".join((text[start:end], *_around(text, start, end)))
    return int.from_bytes(hashlib.blake2b(seen.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


@dataclass(frozen=True)
class SpanModel:
    """Per kind the labelers' estimated reliabilities and the classifier's weights; posteriors of every seen (kind, votes)."""

    reliability: dict[int, np.ndarray]
    probability: dict[tuple[int, int], float]
    weights: dict[int, np.ndarray]

    def accepts(self, text: str, kind: int, start: int, end: int) -> bool:
        if kind not in self.weights:
            return False
        active = [span_features(text, start, end, votes(text, kind, start, end))]
        return bool(span_probability(self.weights[kind], active)[0] > 0.5)


def expectation_maximisation(seen: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every vote pattern and P(vote | class) per labeler, from weighted patterns."""
    score = (seen == FOR).sum(1) - (seen == AGAINST).sum(1)
    posterior = np.where(score > 0, 0.9, np.where(score < 0, 0.1, 0.5))
    table = np.zeros((2, LABELERS, 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        # A vote is believed to point the right way somewhat before it is seen to.
        for c in (0, 1):
            for j in range(LABELERS):
                hits = np.bincount(seen[:, j], weights=weight[c], minlength=3) + np.array([1.0, 1.0 + (c == 0), 1.0 + (c == 1)])
                table[c, j] = hits / hits.sum()
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        log = [np.log(table[c][np.arange(LABELERS), seen]).sum(1) for c in (0, 1)]
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log(1 - share) - np.log(share), -50, 50)))
    return posterior, table


def _sums(weights: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[flat], starts) + weights[-1]


def _flat(active: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.asarray(a) for a in active]), np.cumsum([0] + [len(a) for a in active[:-1]])


def span_probability(weights: np.ndarray, active: list[list[int]]) -> np.ndarray:
    """Probability of class 1 for rows of active features."""
    return 1 / (1 + np.exp(-np.clip(_sums(weights, *_flat(active)), -50, 50)))


def train_classifier(active: list[list[int]], posterior: np.ndarray, counts: np.ndarray, decay: float = 1e-3, steps: int = 600) -> np.ndarray:
    """Logistic regression on active features with posteriors as soft labels, by accelerated gradient steps; the last weight is the constant."""
    flat, starts = _flat(active)
    sizes = np.diff(np.append(starts, len(flat)))
    row, share = np.repeat(np.arange(len(active)), sizes), counts / counts.sum()
    step = 1 / (0.25 * (sizes.max() + 1) + decay)
    weights = ahead = np.zeros(3 * LABELERS + HASHED + 1)
    for k in range(steps):
        slope = share * (1 / (1 + np.exp(-np.clip(_sums(ahead, flat, starts), -50, 50))) - posterior)
        gradient = np.bincount(flat, weights=slope[row], minlength=len(weights)) + decay * ahead
        gradient[-1] += slope.sum()
        moved = ahead - step * gradient
        ahead = moved + k / (k + 3) * (moved - weights)
        weights = moved
    return weights


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's counts of (kind, votes), and its spans of the smallest hash for each of them."""
    counts: Counter[int] = Counter()
    drawn: dict[int, dict[int, list[int]]] = {}
    for batch in batches:
        for text in batch["text"]:
            for kind, start, end, _ in candidates(text):
                packed = votes(text, kind, start, end)
                pattern = kind * 3**LABELERS + packed
                counts[pattern] += 1
                own, draw = drawn.setdefault(pattern, {}), _draw(text, start, end)
                if draw in own or len(own) == SAMPLE_SPANS and draw > max(own):
                    continue
                own[draw] = span_features(text, start, end, packed)
                if len(own) > SAMPLE_SPANS:
                    del own[max(own)]
    rows = [(p, n, None, None) for p, n in counts.items()]
    rows += [(p, 0, d, f) for p, own in drawn.items() for d, f in own.items()]
    frame = pd.DataFrame(rows, columns=["pattern", "n", "draw", "active"])
    yield frame.astype({"pattern": "int32", "n": "int64", "draw": "Int64"})


def fit_span_model(docs: DataFrame) -> SpanModel:
    """Estimate from the votes on every candidate of every text, and train on spans that stand for all of them."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = stash(
        texts.mapInPandas(lambda batches: released(_survey(batches)), "pattern int, n long, draw long, active array<int>"), "spans"
    )
    counted = found.groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most len(KINDS) * 3 ** LABELERS rows
    place = F.row_number().over(Window.partitionBy("pattern").orderBy("draw"))
    drawn = found.where(F.col("draw").isNotNull()).groupBy("pattern", "draw").agg(F.min("active").alias("active"))
    kept = drawn.withColumn("place", place).where(F.col("place") <= SAMPLE_SPANS)
    spans = sorted((r["pattern"], r["draw"], list(r["active"])) for r in kept.select("pattern", "draw", "active").collect())
    reliability, probability, weights = {}, {}, {}
    for kind in range(len(KINDS)):
        own = sorted((r["pattern"] % 3**LABELERS, r["n"]) for r in counted if r["pattern"] // 3**LABELERS == kind)
        if not own:
            continue
        packed, counts = np.array([o[0] for o in own]), np.array([float(o[1]) for o in own])
        posterior, reliability[kind] = expectation_maximisation(unpack(packed), counts)
        probability |= {(kind, int(v)): float(p) for v, p in zip(packed, posterior)}
        drawn_of = Counter(p % 3**LABELERS for p, _, _ in spans if p // 3**LABELERS == kind)
        stands_for = {int(v): n / drawn_of[int(v)] for v, n in zip(packed, counts)}
        sample = [(p % 3**LABELERS, active) for p, _, active in spans if p // 3**LABELERS == kind]
        weights[kind] = train_classifier(
            [a for _, a in sample], np.array([probability[kind, v] for v, _ in sample]), np.array([stands_for[v] for v, _ in sample])
        )
    return SpanModel(reliability, probability, weights)


def personal_spans(text: str, model: SpanModel) -> list[tuple[int, int, int, bool]]:
    return [c for c in candidates(text) if c[3] or model.accepts(text, *c[:3])]


_SPANS = "array<struct<kind:int,start:int,end:int,base:boolean>>"


def span_column(text: Column, model: SpanModel) -> Column:
    """All spans of a text, by kind and start."""

    @F.pandas_udf(_SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in personal_spans(t, model)] for t in texts],
                dtype=object,
            )

    return spans(F.coalesce(text, F.lit("")))


def mask(text: str, model: SpanModel) -> str:
    """The text with every span replaced by its kind; of overlapping spans, the outermost reach is replaced."""
    out, upto = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in personal_spans(text, model)):
        if start >= upto:
            out += [text[upto:start], f"[{KINDS[kind].upper()}]"]
        upto = max(upto, end)
    return "".join([*out, text[upto:]])


def masked_column(text: Column, model: SpanModel) -> Column:
    """The text without personal data; a missing text stays missing."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(pd.Series([t if t is None else mask(t, model) for t in texts], dtype=object) for texts in batches)

    return masked(text)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
