"""Model-preparation edge cases (FIXTURES.md section 4)."""

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postpulse.operators.sampling import split_label
from postpulse.plans import models


def test_equal_counts_index_alphabetically(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "v string")
    out = models.index_strings(df.withColumn("orig", F.col("v")), ["v"])
    got = {r.orig: r.vIndex for r in out.collect()}
    # c (2 rows) -> 0; a and b tie (1 row each) -> alphabetical: a 1, b 2
    assert got == {"a": 1.0, "b": 2.0, "c": 0.0}


@pytest.mark.parametrize("top", [0, 2, 1000])
def test_index_equals_the_ml_indexer(spark, top):
    rows = [(i, "hot" if i % 3 == 0 else f"v{i % 41}" if i % 5 else f"w{i}", f"z{i * i % 7}") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(5)
    extra = spark.createDataFrame([(5000, None, "z1"), (5001, "new", None)], "id long, a string, b string")
    for invalid in ("keep", "skip"):
        model = StringIndexer(inputCols=["a", "b"], outputCols=["aIndex", "bIndex"],
                              handleInvalid=invalid).fit(df)
        want = model.transform(df.union(extra)).drop("a", "b")
        got = models.index_strings(df.union(extra), ["a", "b"], df, invalid, top=top)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="not seen"):
        models.index_strings(df.union(extra), ["a", "b"], df, top=top).collect()


def test_25_values_categorical_26_continuous(spark):
    rows = [(Vectors.dense([float(i % 25), float(i % 26)]),) for i in range(26 * 25)]
    vi = models.feature_indexer(spark.createDataFrame(rows, ["features"]))
    assert set(vi.categoryMaps) == {0}
    assert len(vi.categoryMaps[0]) == 25


def test_baseline_counts_null_score_in_divisor(spark):
    ids = spark.range(400).select(F.col("id").alias("event_id"))
    rows = ids.select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit(None))
                      .otherwise(F.lit(10)).cast("int").alias("score"))
    r = models.mean_baseline(rows).first()
    train = [x for x in rows.select("event_id", "score", split_label(F.col("event_id")).alias("s")).collect()
             if x.s == "train"]
    want = sum(x.score for x in train if x.score is not None) / len(train)
    assert r.n_train == len(train)
    assert abs(r.mean_score - round(want, 6)) < 1e-9
    assert abs(r.rmse - round(10 - want, 6)) < 1e-6


def test_indexers_fitted_on_train_only_keep_unseen(spark):
    from postpulse.sources import fixtures as fx
    rows = fx.model_rows(spark, "/root/testdata/sf0.001")
    data, idx = models.prepare(rows, fit_on_train=True)
    assert data.count() == rows.filter(F.col("score").isNotNull()).count()
    assert set(data.select("split").distinct().toPandas()["split"]) == {"train", "test"}


def _toy(spark, n=240):
    """Label follows feature 0 alone; feature 1 is noise, feature 2 constant."""
    from postpulse.operators.sampling import split_label
    rows = [(i, f"a{i % 6}", f"b{(i * 7) % 5}", "c", (i % 6) * 10 + (i * 13) % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, a string, b string, c string, score int")
    return models.prepare(df)


def test_tree_rmse_of_a_known_feature(spark):
    data, idx = _toy(spark)
    row = models.tree_rmse(data, "dt").first()
    assert row.rmse < 1.5 and row.num_nodes > 1
    summary = {r.feature: r.importance for r in models.tree_summary(data, idx, "dt").collect()}
    assert max(summary, key=summary.get) == "aIndex" and summary["aIndex"] > 0.95
    assert summary["cIndex"] == 0.0


def test_forest_of_one_plain_tree_equals_the_tree(spark):
    data, _ = _toy(spark)
    tree = models.tree_rmse(data, "dt").first()
    forest = models.tree_rmse(data, "rf", numTrees=1, bootstrap=False, featureSubsetStrategy="all").first()
    assert abs(tree.rmse - forest.rmse) < 1e-9 and tree.num_nodes == forest.num_nodes


def test_grid_search_equals_a_fold_loop_by_hand(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import DecisionTreeRegressor
    data, _ = _toy(spark)
    depths, bins, folds = [1, 2, 3, 6], [25, 35], 3
    got = models.tuned_rmse(data, "dt", depths, bins, folds).first()
    indexed = models.feature_indexer(data).transform(data).withColumn("fold", models.fold_of("event_id", folds))
    train = indexed.filter(F.col("split") == "train").cache()
    evaluator = RegressionEvaluator(metricName="rmse")
    scores = []
    for d in depths:
        for b in bins:
            est = DecisionTreeRegressor(featuresCol="indexedFeatures", maxDepth=d, maxBins=b, seed=42)
            errors = [evaluator.evaluate(est.fit(train.where(F.col("fold") != k)).transform(
                train.where(F.col("fold") == k))) for k in range(folds)]
            scores.append((sum(errors) / folds, d, b))
    best = min(scores, key=lambda x: x[0])
    final = DecisionTreeRegressor(featuresCol="indexedFeatures", maxDepth=best[1], maxBins=best[2], seed=42)
    rmse = evaluator.evaluate(final.fit(train).transform(indexed.filter(F.col("split") == "test")))
    assert (got.best_max_depth, got.best_max_bins) == best[1:]
    assert abs(got.rmse - rmse) < 1e-9


def test_stump_takes_the_useful_feature(spark):
    data, idx = _toy(spark)
    rows = models.stump(data, idx).collect()
    assert {r.feature for r in rows} == {"aIndex"} and {r.side for r in rows} == {"low", "high"}
    assert sum(r.n for r in rows) == data.filter(F.col("split") == "train").count()


def test_one_deep_fit_scores_every_depth(spark):
    """Grid errors equal those of plain fits at each depth, on the model table's rows."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import DecisionTreeRegressor
    from postpulse.sources import fixtures as fx
    data, _ = models.prepare(fx.model_rows(spark, "/root/testdata/sf0.001"))
    indexed = models.feature_indexer(data).transform(data)
    train = indexed.filter(F.col("split") == "train").select(
        "indexedFeatures", "label", models.fold_of("event_id", 2).alias("fold")).cache()
    est = DecisionTreeRegressor(featuresCol="indexedFeatures", seed=42)
    depths, bins = [1, 4, 9, 30], [32, 40]
    got = models.tree_grid_errors(train, est, depths, bins, 2, 4)
    evaluator = RegressionEvaluator(metricName="rmse")
    for d in depths:
        for b in bins:
            plain = est.copy({est.maxDepth: d, est.maxBins: b})
            want = sum(evaluator.evaluate(plain.fit(train.where(F.col("fold") != k)).transform(
                train.where(F.col("fold") == k))) for k in range(2)) / 2
            assert abs(got[d, b] - want) < 1e-7 * want


def test_bins_that_give_the_same_thresholds_are_fitted_once(spark):
    """30 values: 35 and 45 bins give the same forest, 25 bins another one."""
    from pyspark.ml.regression import RandomForestRegressor
    rows = [(i, Vectors.dense([float(i * 7 % 30), float(i % 3)]), float(i * i % 17), i % 3)
            for i in range(300)]
    train = spark.createDataFrame(rows, ["id", "indexedFeatures", "label", "fold"]).coalesce(1)
    assert models.same_bins(train, [25, 35, 45, 65], 3) == [25, 35, 35, 35]
    assert models.same_bins(train, [35, 45, 101, 150], 3) == [35, 35, 101, 150]     # sampled apart
    assert models.same_bins(train.limit(30), [35, 45], 3) == [35, 45]               # too few rows
    text = {b: RandomForestRegressor(featuresCol="indexedFeatures", maxBins=b, maxDepth=8, numTrees=3, seed=42)
            .fit(train).toDebugString.split("\n", 1)[1] for b in (25, 35, 45, 65)}
    assert text[35] == text[45] == text[65] != text[25]


def test_one_deep_forest_scores_every_depth(spark, monkeypatch):
    """Grid errors equal those of plain forests fitted at each depth, with one fit per bins and fold."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor
    rows = [(i, Vectors.dense([float(i * 7 % 30), float(i % 3), float(i * i % 11)]),
             float(i * i % 17 + i % 30), i % 2) for i in range(400)]
    train = spark.createDataFrame(rows, ["id", "features", "label", "fold"]).coalesce(2)
    train = models.feature_indexer(train).transform(train).cache()      # one continuous, two not
    est = RandomForestRegressor(featuresCol="indexedFeatures", numTrees=5, seed=42)
    depths, bins = [1, 3, 8, 30], [25, 35]
    evaluator = RegressionEvaluator(metricName="rmse")
    want = {}
    for d in depths:
        for b in bins:
            plain = est.copy({est.maxDepth: d, est.maxBins: b})
            want[d, b] = sum(evaluator.evaluate(plain.fit(train.where(F.col("fold") != k)).transform(
                train.where(F.col("fold") == k))) for k in range(2)) / 2
    fits, fit = [], RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    got = models.forest_grid_errors(train, est, depths, bins, 2, 4)
    assert len(fits) == len(bins) * 2
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 * want[k] for k in want)
    assert len(set(got.values())) >= len(depths)
