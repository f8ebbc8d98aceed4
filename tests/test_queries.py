"""Every query against its SQL twin, and the shape of those without one."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent / "tools"))

from compare import compare, duck  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from loanloom.catalog import REGISTRY  # noqa: E402
from loanloom.operators import model  # noqa: E402
from loanloom.plans.roles import Roles  # noqa: E402

FOLDER = pathlib.Path("/root/testdata/sf0.001")
# Their twins list category levels that a sample this small need not contain.
FULL_LEVELS = {"f1_application", "f8_matrix", "f9_test_matrix"}


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in FULL_LEVELS])
def test_query_matches_twin(spark, connection, name):
    agrees, note = compare(spark, connection, name, str(FOLDER))
    assert agrees, note


@pytest.mark.parametrize("name", sorted(FULL_LEVELS))
def test_applicant_features_match_twin(spark, name):
    folder = FOLDER.parent / "sf0.01"
    agrees, note = compare(spark, duck(folder), name, str(folder))
    assert agrees, note


def test_contract(spark):
    assert contract.oracle_sql().keys() <= contract.queries().keys()
    assert contract.entry(spark).count() == Roles(spark, str(FOLDER)).application.count()


def test_param_grid_sizes():
    from pyspark.ml.classification import LogisticRegression

    models = model.base_models("y")
    grids = model.param_grids(models["boosted"], models["forest"], LogisticRegression(), 1000)
    assert {n: len(g) for n, g in grids.items()} == {
        "forest": 108, "boosted_deep": 48, "boosted_light": 18, "linear": 54,
    }
