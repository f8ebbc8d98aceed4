"""M1-M10 on a feature matrix: split, selection, filling and scaling, models, tuning, voting and the report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param
from pyspark.sql import DataFrame

from loanloom.operators import model, selection
from loanloom.operators.clean import finite_matrix
from loanloom.operators.profile import numeric_columns
from loanloom.operators.split import stratified_split
from loanloom.operators.spread import spread


@dataclass(frozen=True)
class Modelled:
    """What was fitted, and how it does on the training folds and the rows held out."""

    features: list[str]
    models: dict[str, Model]
    base_scores: dict[str, DataFrame]
    tuned_scores: dict[str, DataFrame]
    grids: dict[str, DataFrame]
    vote_scores: DataFrame
    report: DataFrame


def model_matrix(
    matrix: DataFrame,
    label: str,
    key: str,
    k: int = 20,
    estimators: Mapping[str, Estimator] | None = None,
    grids: Mapping[str, Sequence[Mapping[Param, object]]] | None = None,
    folds: int = 3,
    test_share: float = 0.20,
    seed: int = 0,
) -> Modelled:
    """The k best features of the training side, filled and scaled as there, and models on them.

    ``estimators`` default to the two base models; those with a grid are tuned on it and scored again.
    The matrix is read many times, so it should be a stored table.
    """
    train, held = stratified_split(matrix, label, key, test_share, seed)
    candidates = [c for c in numeric_columns(matrix) if c not in (label, key)]
    features = selection.select_k_best(train, candidates, label, k)
    filled = finite_matrix(train.select(key, label, *features), features)
    scaler = selection.fit_scaler(filled, features)

    def vectors(rows: DataFrame) -> DataFrame:
        same = finite_matrix(rows.select(key, label, *features), features)
        return model.assemble(selection.scale(same, scaler), features, keep=[key, label])

    train_vectors = vectors(spread(train.select(key, label, *features), key)).persist()
    held_vectors = vectors(held)
    try:
        estimators = dict(estimators or model.base_models(label, seed))
        base = {n: model.cross_validate(e, train_vectors, label, key, folds, seed) for n, e in estimators.items()}
        fitted, searched, tuned = {}, {}, {}
        for name, estimator in estimators.items():
            if grids and name in grids:
                fitted[name], searched[name] = model.grid_search(estimator, grids[name], train_vectors, label, key, folds, seed)
                best = searched[name].orderBy(searched[name]["accuracy"].desc(), "setting").first()["setting"]
                estimators[name] = estimator.copy(dict(grids[name][best]))
                tuned[name] = model.cross_validate(estimators[name], train_vectors, label, key, folds, seed)
            else:
                fitted[name] = estimator.fit(train_vectors)
        votes = model.cross_validate_vote(estimators, train_vectors, label, key, folds, seed)
    finally:
        train_vectors.unpersist()
    report = model.classification_report(model.soft_vote(fitted, held_vectors), label, "prediction")
    return Modelled(features, fitted, base, tuned, searched, votes, report)
