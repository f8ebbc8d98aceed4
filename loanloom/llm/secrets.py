"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong spans (``assign``, ``access``, ``hex``) stand by themselves. Weak ones (an account name ``login``,
a short password ``pass``, an ``endpoint``) are common in harmless text, so they are reported only where the
parts that complete a credential lie within the same scope, ``SCOPE`` code points to either side:

* a ``login`` beside any secret, a ``pass`` beside any identifier,
* an ``endpoint`` beside both an identifier and a secret.

The interval join of identifiers, secrets and endpoints is a range frame over the parts of a text ordered by
position: it sees, for every part, the parts whose start lies in its scope, and makes no pairs.

Each row of the table is scanned for itself, so repeated rows and ids give one result each. Missing and empty
texts have no spans. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 400

_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Kind, pattern, group whose length counts, least and most characters of it. The first three are fixed values.
KINDS: list[tuple[str, str, int, int, int]] = [
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)" + _VALUE, 2, 12, 1 << 30),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, 1 << 30),
    ("hex", r"[0-9a-f]+", 0, 16, 1 << 30),
    ("login", r"(?i)\b(user|username|login|account|client_?id|access_?key_?id)" + _VALUE, 2, 3, 1 << 30),
    ("pass", r"(?i)\b(password|passwd|passphrase|pass|pwd|secret|token|api_?key|auth)" + _VALUE, 2, 4, 11),
    ("endpoint", r"(?i)\b(https?|ftp|ssh|postgres|postgresql|mysql|redis|mongodb|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", 0, 10, 1 << 30),
]
STRONG = 3
NAMES = [k[0] for k in KINDS]
# A run as long as required is found at the same places without listing every short run in prose.
_SEARCHED = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}


def _parts(text: Column, kind: int) -> Column:
    """Matches of one kind in order, each with the gap before it, so that positions follow by summing lengths."""
    name, pattern, group, least, most = KINDS[kind]
    pattern = _SEARCHED.get(name, pattern)
    pieces = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        F.split(text, pattern, -1).alias("gap"),
    )

    def part(piece: Column, place: Column) -> Column:
        size = F.length(piece["value"])
        return F.struct(
            F.lit(kind).alias("kind"),
            place.alias("place"),
            F.length(piece["gap"]).alias("gap"),
            F.length(piece["found"]).alias("size"),
            ((size >= least) & (size <= most)).alias("valid"),
        )

    matched = F.filter(pieces, lambda p: p["found"].isNotNull())
    return F.when(text.rlike(pattern), F.transform(matched, part))


def credential_parts(docs: DataFrame) -> DataFrame:
    """One row per part, or one without a part for a text that has none: ``row, doc_id, kind, start, end``."""
    scanned = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    none = F.array().cast("array<struct<kind:int,place:int,gap:int,size:int,valid:boolean>>")
    found = [F.coalesce(_parts(F.col("text"), k), none) for k in range(len(KINDS))]
    exploded = scanned.select("row", "doc_id", F.explode_outer(F.concat(*found)).alias("part"))
    upto = Window.partitionBy("row", "part.kind").orderBy("part.place").rowsBetween(Window.unboundedPreceding, 0)
    located = exploded.repartition("row").withColumn("end", F.sum(F.col("part.gap") + F.col("part.size")).over(upto))
    return located.select(
        "row",
        "doc_id",
        F.when(F.col("part.valid"), F.col("part.kind")).alias("kind"),
        (F.col("end") - F.col("part.size")).alias("start"),
        "end",
    )


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``parts`` with ``reported``: strong parts, and weak ones whose complements lie within the scope."""
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)

    def beside(*names: str) -> Column:
        kinds = [NAMES.index(n) for n in names]
        return F.coalesce(F.max(F.col("kind").isin(kinds)).over(near), F.lit(False))

    identifier, secret = beside("access", "login"), beside("assign", "hex", "pass")
    weak = (
        F.when(F.col("kind") == NAMES.index("login"), secret)
        .when(F.col("kind") == NAMES.index("pass"), identifier)
        .when(F.col("kind") == NAMES.index("endpoint"), identifier & secret)
    )
    return parts.withColumn("reported", F.coalesce((F.col("kind") < STRONG) | weak, F.lit(False)))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: ``doc_id``, ``n_<strong kind>``, ``spans`` as an array of (start, kind, end), base spans flagged."""
    span = F.when(F.col("reported"), F.struct("start", F.col("kind").alias("kind_no"), "end"))
    counts = [
        F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{NAMES[k]}") for k in range(STRONG)
    ]
    return (
        linked(credential_parts(docs), scope)
        .groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), *counts, F.sort_array(F.collect_list(span)).alias("spans"))
        .drop("row")
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
