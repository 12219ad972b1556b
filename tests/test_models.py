"""What the model queries learn from."""

import pytest

from tidemark.operators import learning as M
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def trained(monkeypatch):
    """(series, forest) of every training; the forests grown are small ones."""
    seen, train = [], M.train

    def small(df, features, label, forest):
        seen.append((df.select("symbol").distinct().count(), forest))
        return train(df, features, label, M.Forest(2, 2))

    monkeypatch.setattr(M, "train", small)
    return seen


@pytest.mark.parametrize("name, forest", [("best_strategy_predictions", M.BEST_STRATEGY), ("selected_strategies", M.SELECTOR)])
def test_strategy_models_learn_from_the_supplier_panel(spark, trained, name, forest):
    predicted = QUERIES[name](spark, SF)
    assert trained == [(10, forest)]
    assert predicted.select("symbol").distinct().count() == 10


def test_switching_follows_the_strategy_selector(spark, trained):
    QUERIES["model_switching"](spark, SF)
    assert trained == [(10, M.SELECTOR)]
