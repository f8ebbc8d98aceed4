"""One wide row per applicant from all sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from loanloom.operators.attach import left_join_blocks
from loanloom.operators.recency import DAY_SLICES, MONTH_SLICES
from loanloom.plans.application import (
    ApplicationFit,
    application_features,
    clean_and_fit,
    clean_application,
    fit_application,
)
from loanloom.plans.bureau import bureau_features
from loanloom.plans.card import card_recency
from loanloom.plans.instalments import instalment_recency
from loanloom.plans.pos import pos_recency
from loanloom.plans.previous import clean_previous, fit_previous, previous_recency
from loanloom.session import shuffles_dropped, together
from loanloom.sources.io import bucketed_or_load, fingerprint


@dataclass(frozen=True)
class Sources:
    """The side tables; they do not depend on the applicants."""

    bureau: DataFrame
    bureau_balance: DataFrame
    previous: DataFrame
    pos: DataFrame
    instalments: DataFrame
    card: DataFrame


def side_blocks(
    sources: Sources,
    pos_tie_break: tuple[str, ...] = (),
    card_offset: str = "MONTHS_BALANCE",
    card_slices: Mapping[str, int | None] = MONTH_SLICES,
    day_slices: Mapping[str, int | None] = DAY_SLICES,
    month_slices: Mapping[str, int | None] = MONTH_SLICES,
    hot: Sequence[object] | None = None,
    mode: str = "null",
) -> list[DataFrame]:
    """Five blocks with one row per applicant, to be built once and joined to train and test."""

    def earlier() -> DataFrame:
        facts = fit_previous(sources.previous)
        previous = clean_previous(sources.previous, facts)
        return previous_recency(previous, slices=day_slices, hot=hot, mode=mode, fit=facts)

    spark = sources.bureau.sparkSession
    with shuffles_dropped(spark):
        built = together(
            spark,
            lambda: bureau_features(sources.bureau, sources.bureau_balance, hot=hot),
            earlier,
            lambda: pos_recency(sources.pos, tie_break=pos_tie_break, slices=month_slices, hot=hot),
            lambda: instalment_recency(sources.instalments, slices=day_slices, hot=hot, mode=mode),
            lambda: card_recency(sources.card, offset=card_offset, slices=card_slices, hot=hot, mode=mode),
        )
    # Frames of their own, so that the caller's queries on them are as any other.
    return [block.select("*") for block in built]


def write_blocks(
    blocks: Sequence[DataFrame], folder: str, refresh: bool = False, settings: str = "", buckets: int | None = None
) -> list[DataFrame]:
    """S3: blocks as bucketed tables in a shared folder, so train and test join them without computing or shuffling them again.

    A block is found again only if its columns, its source files with their sizes and
    times, and ``settings`` (say, the bounds of the slices) are what they were.

    The disk holds the shuffle of one block at a time beside those already stored, so the widest, which take the most, come last.
    """

    def stored(place: int, block: DataFrame) -> DataFrame:
        path = f"{folder}/block-{place}-{fingerprint(block, settings)}"
        return bucketed_or_load(block, path, "SK_ID_CURR", buckets, refresh)

    if not blocks:
        return []
    with shuffles_dropped(blocks[0].sparkSession):
        found = {i: stored(i, blocks[i]) for i in sorted(range(len(blocks)), key=lambda i: len(blocks[i].columns))}
    return [found[i] for i in range(len(blocks))]


def train_matrix(
    application: DataFrame, blocks: Sequence[DataFrame], clean: bool = True
) -> tuple[DataFrame, ApplicationFit]:
    """F8: applicant features with every block joined; also what the test side reuses."""
    if clean:
        application, fit = clean_and_fit(application)
    else:
        fit = fit_application(application)
    return left_join_blocks(application_features(application, fit), blocks, "SK_ID_CURR"), fit


def test_matrix(application: DataFrame, blocks: Sequence[DataFrame], fit: ApplicationFit | None = None) -> DataFrame:
    """the same for new applicants, with medians and levels from train (or refitted)."""
    application = clean_application(application)
    return left_join_blocks(application_features(application, fit), blocks, "SK_ID_CURR")


test_matrix.__test__ = False
