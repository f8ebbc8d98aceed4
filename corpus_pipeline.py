"""From raw documents to a weighted training mixture.

Each stage takes all rows its predecessor kept. All but the last return the columns of ``documents``:

1. ``quality``: documents the byte-level network scores under 0.7 go.
2. ``near_duplicates``: of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the one with the
   smallest id stays. Rows without an id stay, and an id on several texts is judged text by text.
3. ``decontamination``: documents that hold a benchmark item within the edit budget go.
4. ``personal_data``: spans of personal data are replaced by their kind; ``n_chars`` follows the text.
5. ``mixture``: every document gets the rate and the whole copies that bring the domains to their target weights.

Missing texts count as empty and stay missing. Empty tables give no rows. Further columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm import contamination, mixing, near_duplicates, pii, quality
from loanloom.llm.common import checked_broadcast, ship_package, stash, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(docs["text"], net) >= quality.ACCEPTED)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # An id may stand on several texts, so rows are told by both.
    row = ["doc_id", "text_a", "text_b"]
    copies = near_duplicates.near_duplicates(docs).where("NOT kept").select(*row).distinct()
    copies = stash(copies.toDF("copy_id", "copy_a", "copy_b"), "copies")
    own_a, own_b = near_duplicates.text_prints()
    same = (docs["doc_id"] == copies["copy_id"]) & (own_a == copies["copy_a"]) & (own_b == copies["copy_b"])
    return docs.join(checked_broadcast(copies), same, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = docs.withColumn("text", pii.masked_column(docs["text"], pii.fit_span_model(docs)))
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def weight_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("mixture", weight_sources),
]

ORACLE_SQL = None  # trained models and candidate searches have no SQL form; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each stage's rows are written and reread."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
