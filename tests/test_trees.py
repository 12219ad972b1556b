"""Forests as rows: batches, scoring and storage against the library's own models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learning as M
from tidemark.operators import trees as R
from tidemark.session import scratch_path
from tidemark.streaming import jobs as J

FEATURES = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    a, b, c = rng.normal(size=(3, 1500)).round(2)
    names = np.array(["low", "mid", "top"])[np.clip((a + b * c + rng.normal(size=1500) / 3).round() + 1, 0, 2).astype(int)]
    data = [(i, float(x), float(y), None if i % 50 == 0 else int(z > 0), n, int(x + y > 0)) for i, (x, y, z, n) in enumerate(zip(a, b, c, names))]
    return spark.createDataFrame(data, "id long, a double, b double, c int, name string, up int").repartition(4, "id")


def as_rows(df, *columns):
    return sorted(map(tuple, df.select("id", *columns).collect()))


@pytest.mark.parametrize("max_nodes", [300, R.MAX_NODES])
def test_a_node_table_scores_as_its_model(spark, rows, monkeypatch, max_nodes):
    monkeypatch.setattr(R.add_votes, "__defaults__", (max_nodes,))
    model = M.train(rows, FEATURES, "up", M.Forest(12, 6))
    table = M.node_table(spark, model)
    assert as_rows(M.score_direction(rows, table, 0.4), "proba", "signal") == as_rows(M.score_direction(rows, model, 0.4), "proba", "signal")
    model = M.train(rows, FEATURES, "name", M.Forest(12, 6))
    scored = M.predict_strategy(rows, M.node_table(spark, model))
    assert as_rows(scored, "strategy", "probability") == as_rows(M.predict_strategy(rows, model), "strategy", "probability")
    assert scored.count() == 1470 and set(scored.columns) == {*rows.columns, "strategy", "probability"}


def test_a_forest_in_batches_has_the_votes_of_one_forest(spark, rows):
    """The trees of all batches, put side by side in one library model's order, vote the same."""
    forest = M.Forest(trees=10, depth=12, seed=5, batch=4, leaves=100)
    grown = M.train(rows, FEATURES, "name", forest)
    assert isinstance(grown, R.Trees) and grown.nodes(spark).select("tree").distinct().count() == 10
    sums = None
    assembler, prepared, target, _ = M._prepared(rows, FEATURES, "name")
    data = assembler.transform(prepared).select("id", "features", F.col(target).alias("_target"))
    for k, count in enumerate((4, 4, 2)):
        model = M._classifier(forest, "_target", count, 5 + k, 14).fit(data.select("features", "_target"))
        raw = {r["id"]: r["rawPrediction"].toArray() for r in model.transform(data).collect()}
        sums = raw if sums is None else {i: sums[i] + v for i, v in raw.items()}
    got = {r["id"]: np.array(r["votes"]) for r in R.add_votes(rows, grown).collect()}
    assert got.keys() == sums.keys() and all(np.allclose(got[i], sums[i], rtol=0, atol=1e-12) for i in got)


def test_leaves_are_bounded_by_the_share_of_rows(spark, rows):
    for leaves in (20, 60):
        grown = M.train(rows, FEATURES, "name", M.Forest(3, 20, batch=2, leaves=leaves))
        sizes = grown.nodes(spark).where("left IS NULL").groupBy("tree").count().collect()
        assert len(sizes) == 3 and all(r["count"] <= leaves for r in sizes)


def test_a_batch_that_is_written_again_replaces_itself(spark, rows):
    grown = M.train(rows, FEATURES, "name", M.Forest(4, 11, batch=2, leaves=20))
    before = grown.nodes(spark).count()
    assembler, prepared, target, _ = M._prepared(rows, FEATURES, "name")
    data = assembler.transform(prepared).select("features", F.col(target).alias("_target"))
    leaf = data.count() // 20
    R.append_trees(spark, M._classifier(M.Forest(4, 11), "_target", 2, 43, leaf).fit(data), grown.path, 2)
    assert grown.nodes(spark).count() == before


def test_saved_trees_predict_the_same(spark, rows):
    grown, path = M.train(rows, FEATURES, "name", M.Forest(4, 11, batch=3, leaves=30)), scratch_path(spark, "saved")
    M.save_model(grown, path)
    again = M.load_model(path)
    assert (again.features, again.names, again.trees) == (FEATURES, ("low", "mid", "top"), 4) and again.path != grown.path
    assert as_rows(M.predict_strategy(rows, again), "strategy", "probability") == as_rows(M.predict_strategy(rows, grown), "strategy", "probability")


def test_a_stream_is_scored_as_a_table(spark, rows, tmp_path):
    model = M.train(rows, FEATURES, "up", M.Forest(8, 5))
    rows.write.parquet(f"{tmp_path}/rows")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/rows")
    streamed = J.run_to_table(J.stream_signals(arriving, M.node_table(spark, model)))
    assert as_rows(streamed, "proba", "signal") == as_rows(M.score_direction(rows, model), "proba", "signal")


def test_ties_empty_tables_and_single_leaves(spark, rows):
    """Of classes with as many votes the first wins, as in the library; rows with unknown features and empty tables give no rows."""
    flat = rows.where("c IS NOT NULL").withColumn("name", F.when(F.col("id") % 2 == 0, "x").otherwise("y")).withColumns({f: F.lit(1.0) for f in FEATURES})
    even = flat.unionByName(flat.withColumn("name", F.when(F.col("name") == "x", "y").otherwise("x")))
    model = M.train(even, FEATURES, "name", M.Forest(2, 3))
    table = M.node_table(spark, model)
    assert as_rows(M.predict_strategy(even, table), "strategy", "probability") == as_rows(M.predict_strategy(even, model), "strategy", "probability")
    assert M.predict_strategy(rows.limit(0), table).count() == 0
    assert M.predict_strategy(rows.withColumn("a", F.lit(None).cast("double")), table).count() == 0
