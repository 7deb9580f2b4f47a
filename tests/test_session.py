from pathlib import Path

import pytest

import probeloom.contracts
import probeloom.functions
import probeloom.operators
import probeloom.plans
import probeloom.sources
import probeloom.streaming
from probeloom.operators import ModelState, Scorer
from probeloom.session import intermediate_tables, materialize


def folder(df):
    return Path(df.inputFiles()[0].removeprefix("file://")).parent


def test_tables_go_with_their_block(spark):
    first = materialize(spark.range(3))
    with pytest.raises(ZeroDivisionError), intermediate_tables(spark):
        inner = materialize(spark.range(5))
        assert inner.count() == 5 and folder(inner).exists()
        where = folder(inner)
        1 / 0
    assert not where.exists() and first.count() == 3


@pytest.mark.parametrize("package", [probeloom.contracts, probeloom.functions, probeloom.operators, probeloom.plans, probeloom.sources, probeloom.streaming])
def test_exports_are_there(package):
    assert package.__all__ and all(hasattr(package, n) for n in package.__all__)


def test_plug_in_points():
    class State:
        state_id = "s"

        def score_target(self, prompt, target):
            return 1

    assert isinstance(State(), ModelState) and isinstance(lambda b: b, Scorer) and not isinstance(3, ModelState)
