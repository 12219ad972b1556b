"""Forests on many rows: the tasks that grow whole trees, against plain counts and the library's own models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import growing as G
from tidemark.operators import learning as M
from tidemark.operators import trees as R
from tidemark.plans import models as P

FEATURES = ("a", "b", "c", "d")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=(3, 4000)).round(2)
    d = (rng.random(4000) < 0.02).astype(int)
    names = np.array(["low", "mid", "top"])[np.clip((a + b * c + 2 * d + rng.normal(size=4000) / 3).round() + 1, 0, 2).astype(int)]
    data = [(i, float(x), float(y), None if i % 50 == 0 else float(z), int(f), n, int(x + y > 0)) for i, (x, y, z, f, n) in enumerate(zip(a, b, c, d, names))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, d int, name string, up int").repartition(4, "id")


@pytest.fixture
def many(monkeypatch):
    """All rows are many; the library's trainer must not be asked."""
    monkeypatch.setattr(M, "LIBRARY_PAIRS", 0)
    monkeypatch.setattr(M, "_classifier", None)


def hits(df, label):
    return df.select(F.avg((F.col("strategy") == F.col(label)).cast("double"))).first()[0]


@pytest.mark.parametrize("forest", [M.Forest(20, 5), M.Forest(20, 30, leaves=200)])
def test_many_rows_are_learnt_as_well_as_by_the_library(rows, forest, monkeypatch):
    early, late = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    expected = hits(M.predict_strategy(late, M.train(early, FEATURES, "name", forest)), "name")
    monkeypatch.setattr(M, "LIBRARY_PAIRS", 0)
    monkeypatch.setattr(M, "_classifier", None)
    model = M.train(early, FEATURES, "name", forest)
    assert isinstance(model, R.Trees) == forest.deep
    scored = M.predict_strategy(late, model)
    assert scored.count() == late.dropna().count() and abs(hits(scored, "name") - expected) < 0.04


def test_the_model_of_many_rows_is_the_librarys(spark, rows, many):
    model = M.train(rows, FEATURES, "up", M.Forest(12, 5))
    table = M.score_direction(rows, M.node_table(spark, model), 0.4).select("id", "proba", "signal")
    assert sorted(table.collect()) == sorted(M.score_direction(rows, model, 0.4).select("id", "proba", "signal").collect())
    ranked = M.importances(spark, model).collect()
    assert {r["feature"] for r in ranked[:2]} == {"a", "b"} and abs(sum(r["importance"] for r in ranked) - 1) < 1e-9


def _planned(rows, **more):
    known = rows.dropna().withColumn("k", F.expr("array_position(array('low', 'mid', 'top'), name) - 1"))
    return G.prepare(known, FEATURES, "k", **{"trees": 5, "depth": 12, "leaf": 20, "seed": 9, **more})


def test_nodes_count_the_rows_that_reach_them(rows):
    plan = _planned(rows)
    blocks = [b.reshape(-1, 4) for b in G._blocks(plan)]
    assert sum(map(len, blocks)) == plan.rows == 3920 and plan.cuts[3] == (0.0,)
    for tree in G.grow_trees(plan, [0, 3]):
        counted = [np.zeros(3) for _ in tree.counts]
        for number, block in enumerate(blocks):
            for codes, times in zip(block.tolist(), tree.bag(number, len(block)).tolist()):
                node = 0
                while True:
                    counted[node][codes[0] % 3] += times
                    if tree.feature[node] < 0:
                        break
                    node = (tree.left if codes[tree.feature[node]] // 3 <= tree.cut[node] else tree.right)[node]
        assert len(tree.counts) > 50 and all((x == y).all() for x, y in zip(counted, tree.counts))
        assert all(f >= 0 or c.sum() >= 20 for f, c in zip(tree.feature, tree.counts))


def test_a_level_in_several_passes_is_the_same(rows):
    plan = _planned(rows)
    small = G.Plan(**{**plan.__dict__, "cells": 2 * plan.tried * G.BINS * plan.classes})
    assert [t.rows() for t in G.grow_trees(small, [1, 2])] == [t.rows() for t in G.grow_trees(plan, [1, 2])]
    assert G.grow_trees(plan, [2])[0].rows() == G.grow_trees(plan, [1, 2])[1].rows()


def test_ends_of_bins_are_near_the_quantiles(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 700)
    df = spark.range(20000).select((F.col("id") * 7919 % 20000).cast("double").alias("x"), (F.col("id") == 5).cast("int").alias("k")).repartition(3)
    (cuts,) = G.prepare(df, ["x"], "k", 1, 3, 1, 1).cuts
    assert len(cuts) == G.BINS - 1 and cuts[0] == 0 and np.allclose(np.diff(cuts), 20000 / 31, atol=200)


@pytest.mark.parametrize("parts", [lambda s, d: P._split(s, d, known="target"), lambda s, d: P._split(s, d, known="next_label", gap=21), lambda s, d: P._pooled(P.frame(s, d))])
def test_parts_to_learn_from_are_read_without_a_shuffle(spark, parts, many):
    early, late = parts(spark, "/root/testdata/sf0.001")
    for part in (early, late):
        assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString() and part.count()
