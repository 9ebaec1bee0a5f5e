"""Score prediction models (survey A4, A5, P9-P12, F1-F4, M1-M7).

Feature preparation and model fitting use ``pyspark.ml`` as it is. Changes
from the original scripts, all for repeatability or cost:

* the 70/30 split is an md5 bucket of the row id instead of an unseeded
  ``randomSplit`` (same id -> same side on any cluster);
* text columns are indexed by frequency ranks computed on the cluster (one
  aggregate for all columns; no value passes through the driver);
* the indexed table is persisted before cross-validation's fits and the
  feature indexer is applied once, not inside each of them;
* cross-validation folds are md5 buckets of the row id; one fit to the greatest
  depth scores every depth of the grid, and up to twice as many fits run at a
  time as the cluster has cores (hides per-job scheduling latency).

Indexers are fitted on all rows before the split, as in the original;
``fit_on_train=True`` fits them on the training rows only.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postpulse.functions.hashing import md5_number
from postpulse.operators.sampling import split_label, with_position
from postpulse.session import scratch_path, stored

# ---- fixed values of the original scripts -----------------------------------
MAX_CATEGORIES = 25
DEPTH_GRID = [5, 10, 15, 20, 25, 30]
BINS_GRID = [25, 35, 45, 55, 65]
NUM_FOLDS = 5
FOLD_SEED = 45
TRAIN_PERCENT = 70
# ------------------------------------------------------------------------------

TOP_VALUES = 1000       # values of a column that are broadcast at most
SALTS = 1 << 20
JOIN_ROWS = 250_000     # rows of a task that meets rare values
FIT_ROWS = 10_000_000   # rows of the forests that are fitted at a time, some 400 bytes each


def text_columns(df: DataFrame, exclude=()) -> list[str]:
    """Columns of string type: all of them are treated as categorical."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def frequency_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n, rank): place of every value of a column by falling frequency, from 0.

    Ties go by value. One aggregate counts the values of all columns, a range sort orders them
    over the cluster, and the rows before a value's partition plus its row there are its place.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("feature"), F.col(c).alias("value"))
        for i, c in enumerate(columns)])).alias("p")).select("p.*")
    counts = pairs.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"))
    placed = with_position(counts.orderBy("feature", F.desc("n"), "value"))
    starts = placed.groupBy("feature").agg(F.min("position").alias("start"))
    ranks = placed.join(F.broadcast(starts), "feature").select(      # one row per column
        "feature", "value", "n", (F.col("position") - F.col("start")).alias("rank"))
    return stored(df.sparkSession, ranks, "ranks")      # read once per column


def index_strings(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None,
                  handle_invalid: str = "error", top: int = TOP_VALUES) -> DataFrame:
    """Replace each text column by its frequency rank ``<col>Index``.

    Most frequent value = 0, ties alphabetical. A null or a value not seen in ``fit_on`` is an
    error, is left out (``skip``) or gets the number of values (``keep``).

    The ``top`` most frequent values of a column are joined as a broadcast of that many rows, so
    a value that holds a third of all rows is never shuffled. If a column has more values, the
    rows of the others meet them by an equi-join, in which the rows already settled are spread
    by a salt, over as many tasks as hold JOIN_ROWS rows each. Only the number of values of each
    column and of the rows reaches the driver.
    """
    if handle_invalid not in ("error", "skip", "keep"):
        raise ValueError(f"handle_invalid: {handle_invalid}")
    ranks = frequency_ranks(df if fit_on is None else fit_on, columns)
    sizes = {r["feature"]: r["n_values"] for r in ranks.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_values")).collect()}
    many = any(n > top for n in sizes.values())
    tasks = max(df.sparkSession.sparkContext.defaultParallelism,
                -(-df.count() // JOIN_ROWS)) if many else 0
    out = df
    for i, c in enumerate(columns):
        mine = ranks.where(F.col("feature") == i).select(
            F.col("value").alias("_value"), F.col("rank").cast("double").alias("_index"))
        frequent = mine.where(F.col("_index") < top)       # pushed down to the landed ranks
        out = out.join(F.broadcast(frequent), F.col(c) == F.col("_value"), "left").drop("_value")
        if sizes.get(i, 0) > top:
            settled = F.col("_index").isNotNull() | F.col(c).isNull()
            salt = F.when(settled, 1 + F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).otherwise(F.lit(0))
            rare = mine.where(F.col("_index") >= top).select(
                "_value", F.col("_index").alias("_rare"),
                (F.col("_index") * 0).cast("long").alias("_zero"))    # a literal is no key
            # numbers of tasks that are given stay: a task's sort does not grow with the input
            out = out.withColumn("_salt", salt.cast("long")).repartition(tasks, c, "_salt").join(
                rare.repartition(tasks, "_value", "_zero"), (F.col(c) == F.col("_value")) & (F.col("_salt") == F.col("_zero")), "left")
            out = out.withColumn("_index", F.coalesce("_index", "_rare")).drop(
                "_value", "_rare", "_zero", "_salt")
        if handle_invalid == "skip":
            out = out.where(F.col("_index").isNotNull())
        other = (F.lit(float(sizes.get(i, 0))) if handle_invalid == "keep" else
                 F.raise_error(F.concat(F.lit(f"value of {c} not seen: "), F.coalesce(
                     F.col(c), F.lit("null")))).cast("double"))
        index = F.col("_index") if handle_invalid == "skip" else F.coalesce("_index", other)
        out = out.withColumn(c + "Index", index).drop("_index")
    return out.drop(*columns)


def assemble(df: DataFrame, index_columns: list[str], label: str = "score",
             keep: list[str] | None = None) -> DataFrame:
    """Index columns -> ``features`` vector; label copied from the score."""
    # An indexer that marks its outputs nominal would pass that metadata through the
    # assembler and make every index categorical whatever VectorIndexer decides
    # (a 30-value day of month then fails maxBins=25). Clear it so the
    # maxCategories rule is the one that applies.
    plain = df.select(*[F.col(c).alias(c, metadata={}) if c in index_columns else F.col(c)
                        for c in df.columns])
    out = VectorAssembler(inputCols=index_columns, outputCol="features").transform(plain)
    return out.select(*(keep or []), "features", F.col(label).alias("label"))


def feature_indexer(df: DataFrame, max_categories: int = MAX_CATEGORIES):
    """Features with <= max_categories distinct values become categorical."""
    return VectorIndexer(inputCol="features", outputCol="indexedFeatures",
                         maxCategories=max_categories).fit(df)


def category_map(df: DataFrame, names: list[str], max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """(feature, name, categorical, n_values, value, place) of the fitted indexer: one row per
    value of a categorical feature (at most ``max_categories``), one per continuous feature."""
    maps = feature_indexer(df, max_categories).categoryMaps
    rows = []
    for i, name in enumerate(names):
        known = dict(maps[i]) if i in maps else None
        if known is None:
            rows.append((i, name, False, None, None, None))
        else:
            rows += [(i, name, True, len(known), float(v), int(p)) for v, p in known.items()]
    return df.sparkSession.createDataFrame(
        rows, "feature int, name string, categorical boolean, n_values long, value double, place int")


def flatten(df: DataFrame, vector_col: str, prefix: str, width: int) -> DataFrame:
    arr = vector_to_array(F.col(vector_col))
    rest = [c for c in df.columns if c != vector_col]
    return df.select(*rest, *[arr[i].alias(f"{prefix}{i}") for i in range(width)])


def prepare(model_rows: DataFrame, id_col: str = "event_id", label: str = "score",
            fit_on_train: bool = False, train_percent: int = TRAIN_PERCENT):
    """Model rows -> (data, index column names): id, features, label, split."""
    cats = text_columns(model_rows)
    lab = split_label(F.col(id_col), train_percent)
    fit_on = model_rows.filter(lab == "train") if fit_on_train else None
    indexed = index_strings(model_rows, cats, fit_on,
                            handle_invalid="keep" if fit_on_train else "error")
    idx_cols = [c + "Index" for c in cats]
    data = assemble(indexed, idx_cols, label, keep=[id_col])
    data = data.filter(F.col("label").isNotNull())   # the evaluator rejects null labels
    return data.withColumn("split", split_label(F.col(id_col), train_percent)), idx_cols


def mean_baseline(rows: DataFrame, id_col: str = "event_id", label: str = "score",
                  train_percent: int = TRAIN_PERCENT) -> DataFrame:
    """Mean of train scores as the prediction for every test row; test RMSE.

    Works on the model table itself (no features are needed). The mean is
    sum / count(*): a null score is left out of the sum but counted. The RMSE
    is over test rows with a score (the original fails on a null one). The
    mean is a scalar subquery: computed once by Spark and folded into the
    test-side projection, with no driver round trip and no join.
    """
    lab = split_label(F.col(id_col), train_percent)
    train = rows.filter(lab == "train")
    test = rows.filter(lab == "test")
    # one scalar subquery (a struct) gives both numbers from a single pass
    tr = train.select(F.struct(F.count(F.lit(1)).alias("n"),
                               (F.sum(label) / F.count(F.lit(1))).alias("m")).alias("s")).scalar()
    mean, n_train = tr.getField("m"), tr.getField("n")
    scored = test.select(F.col(label).alias("y"), mean.alias("prediction"))
    return scored.agg(
        n_train.alias("n_train"),
        F.count(F.lit(1)).alias("n_test"),
        F.round(F.first("prediction"), 6).alias("mean_score"),
        F.round(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))), 6).alias("rmse"))


def _rmse_frame(predictions: DataFrame, **info) -> DataFrame:
    out = predictions.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2))).alias("rmse"))
    for k, v in info.items():
        out = out.withColumn(k, F.lit(v))
    return out


def fit_tree(data: DataFrame, kind: str = "dt", **params):
    """Default-setting tree or forest on the train rows (M2, M3)."""
    vi = feature_indexer(data)
    est = (DecisionTreeRegressor if kind == "dt" else RandomForestRegressor)(
        featuresCol="indexedFeatures", labelCol="label", **params)
    train = data.filter(F.col("split") == "train")
    return Pipeline(stages=[vi, est]).fit(train)


def tree_rmse(data: DataFrame, kind: str = "dt", **params) -> DataFrame:
    """RMSE on the held-out rows of a default tree (dt) or forest (rf) (M2, M3, M6)."""
    model = fit_tree(data, kind, **params)
    test = data.filter(F.col("split") == "test")
    pred = model.transform(test)
    tree = model.stages[-1]
    return _rmse_frame(pred, model=kind, num_nodes=int(tree.totalNumNodes if kind == "rf" else tree.numNodes))


def fold_of(id_col: str, folds: int = NUM_FOLDS):
    """Cross-validation fold of a row."""
    return (md5_number(FOLD_SEED, F.col(id_col)) % folds).cast("int")


def stump(data: DataFrame, idx_cols: list[str]) -> DataFrame:
    """(feature, side, n, mean) of the one-split tree on the train rows (M2).

    The side with the lower mean is ``low``.
    """
    model = fit_tree(data, "dt", maxDepth=1)
    used = int(model.stages[-1].featureImportances.toArray().argmax())
    sides = model.transform(data.filter(F.col("split") == "train")).groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean"))
    low = F.col("prediction") == sides.agg(F.min("prediction")).scalar()
    return sides.select(F.lit(idx_cols[used]).alias("feature"),
                        F.when(low, "low").otherwise("high").alias("side"), "n",
                        F.round("mean", 6).alias("mean"))


def leaf_counts(data: DataFrame, depth: int) -> DataFrame:
    """(n_train, n_test, mean) per leaf of a tree of at most this depth; the leaf's mean label
    over the train rows is its prediction (M2, M7)."""
    model = fit_tree(data, "dt", maxDepth=depth, leafCol="leaf")
    train = F.col("split") == "train"
    return model.transform(data).groupBy("leaf").agg(
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"),
        F.round(F.avg(F.when(train, F.col("label"))), 6).alias("mean")).drop("leaf")


def tuned_rmse(data: DataFrame, kind: str = "dt", depth_grid=DEPTH_GRID, bins_grid=BINS_GRID,
               folds: int = NUM_FOLDS, id_col: str = "event_id", parallelism: int | None = None,
               memory_mb: int = 1024, seed: int = 42) -> DataFrame:
    """Grid search with k-fold cross-validation, refit, test RMSE (M4, M5, M6).

    A row's fold is the md5 bucket of its id, so folds do not depend on partitioning.
    ``parallelism`` fits run at a time: twice the cluster's cores unless given. The feature
    indexer is fitted once (on all rows, as in the original) and applied once before the
    fits; the indexed training rows are persisted. ``cacheNodeIds`` (node ids kept per row
    and checkpointed every 10 iterations) and ``maxMemoryInMB`` change how a deep tree or
    forest is computed, not the fitted trees.

    One fit per (bins, fold) to the greatest depth scores every depth: growth is greedy, so a
    tree of less depth is the deeper one cut off (``depth_errors``). So is a forest: its levels
    are grown one after the other, and the features that a node may use are drawn in that order,
    whatever the greatest depth, as long as a level fits into ``memory_mb`` (beyond that they
    are other draws of the same kind). Numbers of bins that give the same thresholds
    (``same_bins``) give the same trees and are fitted once. As many forests are fitted at a
    time as hold FIT_ROWS rows.
    """
    vi = feature_indexer(data)
    est = (DecisionTreeRegressor if kind == "dt" else RandomForestRegressor)(
        featuresCol="indexedFeatures", labelCol="label", maxMemoryInMB=memory_mb,
        cacheNodeIds=True, seed=seed)
    at_once = min(len(depth_grid) * len(bins_grid),
                  parallelism or 2 * data.sparkSession.sparkContext.defaultParallelism)
    indexed = vi.transform(data)
    train = indexed.filter(F.col("split") == "train").select(
        "indexedFeatures", "label", fold_of(id_col, folds).alias("fold")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # of equal points the first of the grid stands for all: the search takes the first best
        bins = list(dict.fromkeys(same_bins(train, bins_grid, folds)))
        grid = (ParamGridBuilder().addGrid(est.maxDepth, depth_grid)
                .addGrid(est.maxBins, bins).build())
        errors = (tree_grid_errors if kind == "dt" else forest_grid_errors)(
            train, est, depth_grid, bins, folds, at_once)
        best = min(grid, key=lambda g: errors[g[est.maxDepth], g[est.maxBins]])
        tree = est.fit(train, best)
    finally:
        train.unpersist()
    pred = tree.transform(indexed.filter(F.col("split") == "test"))
    return _rmse_frame(pred, model=kind, best_max_depth=int(tree.getOrDefault("maxDepth")),
                       best_max_bins=int(tree.getOrDefault("maxBins")),
                       grid_points=len(depth_grid) * len(bins_grid), folds=folds)


def same_bins(train: DataFrame, bins_grid, folds: int) -> list[int]:
    """Per number of bins of the grid the first one that gives the same thresholds in every fit.

    With a bin for each value of a feature, all midpoints between its values are thresholds,
    whatever the number of bins; values counted over all folds (and zero, which the learner
    may add) are no fewer than a fit sees. Only where every fold has rows enough and rows are sampled alike
    for the thresholds (``max(bins ** 2, 10000)`` of them) are two numbers of bins the same.
    """
    values = train.select(F.posexplode(vector_to_array("indexedFeatures")).alias("feature", "value"))
    known = values.where("value <> 0").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    per_fold = train.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    most = 1 + (known.agg(F.max("n")).first()[0] or 0)
    sizes = [r["n"] for r in per_fold.collect()]           # one row per fold
    least = sum(sizes) - max(sizes, default=0)
    out: list[int] = []
    for b in bins_grid:
        like = [a for a in out if most <= min(a, b) and max(a, b) <= least
                and max(a * a, 10_000) == max(b * b, 10_000)]
        out.append(like[0] if like else b)
    return out


def tree_grid_errors(train: DataFrame, est, depth_grid, bins_grid, folds: int,
                     at_once: int) -> dict[tuple[int, int], float]:
    """Mean validation RMSE over the folds for each (depth, bins), from one deep fit each."""
    def run(job: tuple[int, int]) -> dict[int, float]:
        bins, fold = job
        model = est.copy({est.maxDepth: max(depth_grid), est.maxBins: bins,
                          est.leafCol: "leaf"}).fit(train.where(F.col("fold") != fold))
        leaves = model.transform(train).groupBy(
            F.col("leaf").cast("int").alias("leaf"), (F.col("fold") == fold).alias("held")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("s"),
            F.sum(F.col("label") * F.col("label")).alias("ss")).toPandas()   # two rows per leaf
        return depth_errors(model.toDebugString, leaves, depth_grid)

    jobs = [(b, k) for b in bins_grid for k in range(folds)]
    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(inheritable_thread_target(train.sparkSession)(run), jobs))
    return {(d, b): sum(e[d] for (bb, _), e in zip(jobs, done) if bb == b) / folds
            for d in depth_grid for b in bins_grid}


def forest_grid_errors(train: DataFrame, est, depth_grid, bins_grid, folds: int,
                       at_once: int) -> dict[tuple[int, int], float]:
    """Mean validation RMSE over the folds for each (depth, bins), from one deep forest each.

    Rows with the same features get the same prediction: they are scored once.
    """
    spark = train.sparkSession
    per_fold = {r["fold"]: r["n"] for r in train.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n")).collect()}           # one row per fold
    for k in range(folds):                                 # as CrossValidator does
        if sum(per_fold.values()) == per_fold.get(k, 0):
            raise ValueError(f"The training data at fold {k} is empty.")
        if not per_fold.get(k):
            raise ValueError(f"The validation data at fold {k} is empty.")
    alike = stored(spark, train.groupBy("fold", vector_to_array("indexedFeatures").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("double").alias("s"),
        F.sum(F.col("label") * F.col("label")).cast("double").alias("ss")), "alike")

    def run(job: tuple[int, int]) -> dict[int, float]:
        bins, fold = job
        model = est.copy({est.maxDepth: max(depth_grid), est.maxBins: bins}).fit(
            train.where(F.col("fold") != fold))
        return forest_errors(model, alike.where(F.col("fold") == fold), depth_grid)

    jobs = [(b, k) for b in bins_grid for k in range(folds)]
    at_once = max(1, min(at_once, FIT_ROWS // max(1, sum(per_fold.values()))))
    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(run), jobs))
    return {(d, b): float(np.mean([e[d] for (bb, _), e in zip(jobs, done) if bb == b]))
            for d in depth_grid for b in bins_grid}


def forest_nodes(spark: SparkSession, model) -> dict[str, np.ndarray]:
    """Columns of the nodes of a fitted forest, trees one after the other; ``root`` has the first
    of each. Inner nodes have predictions too. A node without children is its own child;
    ``go_left`` has a row for each split by categories (``places``): whether a value goes left.
    """
    path = scratch_path(spark, "forest")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.*").select(
        "treeID", "id", "prediction", "leftChild", "rightChild", "split.featureIndex",
        "split.numCategories", "split.leftCategoriesOrThreshold").toPandas()    # one fitted forest
    rows = rows.sort_values(["treeID", "id"], ignore_index=True)
    tree = rows["treeID"].to_numpy()
    root = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
    first, own = root[np.searchsorted(root, np.arange(len(rows)), "right") - 1], np.arange(len(rows))
    left, right = (first + rows[c].to_numpy() for c in ("leftChild", "rightChild"))
    leaf = rows["leftChild"].to_numpy() < 0
    by_value = (rows["numCategories"].to_numpy() >= 0) & ~leaf
    split = rows["leftCategoriesOrThreshold"]
    go_left = np.zeros((int(by_value.sum()), max(1, int(rows["numCategories"].max()))), bool)
    for row, values in zip(go_left, split[by_value]):
        row[np.asarray(values, np.int64)] = True
    threshold = np.zeros(len(rows))
    threshold[~by_value & ~leaf] = [x[0] for x in split[~by_value & ~leaf]]
    return {"root": root, "prediction": rows["prediction"].to_numpy(),
            "feature": np.where(leaf, 0, rows["featureIndex"].to_numpy()), "threshold": threshold,
            "left": np.where(leaf, own, left), "right": np.where(leaf, own, right),
            "place": np.where(by_value, np.cumsum(by_value) - 1, -1), "go_left": go_left}


def forest_predictor(depth_grid):
    """(nodes, rows of features) -> per depth the predictions of the forest cut off there; made
    here so that it goes to the executors by itself."""

    def predict(nodes: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros((len(depth_grid), len(x))), np.arange(len(x))
        for root in nodes["root"]:
            at, by_depth = np.full(len(x), root), []
            for _ in range(max(depth_grid) + 1):
                by_depth.append(nodes["prediction"][at])
                value, place = x[rows, nodes["feature"][at]], nodes["place"][at]
                left = value <= nodes["threshold"][at]
                if len(nodes["go_left"]):
                    known = np.clip(value, 0, nodes["go_left"].shape[1] - 1).astype(np.int64)
                    left = np.where(place >= 0, nodes["go_left"][place, known], left)
                before, at = at, np.where(left, nodes["left"][at], nodes["right"][at])
                if (at == before).all():
                    break
            for i, d in enumerate(depth_grid):
                out[i] += by_depth[min(d, len(by_depth) - 1)]
        return out / len(nodes["root"])

    return predict


def forest_errors(model, alike: DataFrame, depth_grid) -> dict[int, float]:
    """RMSE of a forest cut off at each depth on (x, n, s, ss) rows: the number, sum and sum of
    squares of the labels of the rows with features x."""
    spark = alike.sparkSession
    nodes, predict = spark.sparkContext.broadcast(forest_nodes(spark, model)), forest_predictor(depth_grid)
    names = [f"d{d}" for d in depth_grid]

    def score(frames):
        for pdf in frames:
            p = predict(nodes.value, np.stack(pdf["x"].to_numpy()))
            n, s, ss = (pdf[c].to_numpy() for c in ("n", "s", "ss"))
            yield pd.DataFrame((ss - 2 * p * s + n * p * p).T, columns=names).assign(n=n)

    found = alike.select("x", "n", "s", "ss").mapInPandas(
        score, ", ".join(f"{c} double" for c in names) + ", n long")
    sums = found.agg(*[F.sum(c).alias(c) for c in [*names, "n"]]).first()
    nodes.unpersist()
    return {d: float(np.sqrt(max(sums[c], 0.0) / sums["n"])) for d, c in zip(depth_grid, names)}


def depth_errors(tree_text: str, leaves, depth_grid) -> dict[int, float]:
    """RMSE on the held rows of a tree cut off at each depth.

    ``leaves`` has n, s and ss of the labels per leaf for fitted and held rows; a node's
    prediction is the mean of the fitted rows below it.
    """
    paths, open_ = [], []          # per leaf in preorder, the numbers of its ancestors
    count = 0
    for line in tree_text.splitlines()[1:]:
        depth = len(line) - len(line.lstrip()) - 2
        if line.lstrip().startswith("If"):
            open_[depth:] = [count]
            count += 1
        elif line.lstrip().startswith("Predict"):
            paths.append([*open_[:depth], count])
            count += 1
    fitted = {r.leaf: r for r in leaves[~leaves["held"]].itertuples()}
    held = {r.leaf: r for r in leaves[leaves["held"]].itertuples()}
    n, s = np.zeros(count), np.zeros(count)
    for leaf, path in enumerate(paths):
        if leaf in fitted:
            n[path] += fitted[leaf].n
            s[path] += fitted[leaf].s
    mean = s / np.maximum(n, 1)
    total = sum(r.n for r in held.values())
    out = {}
    for d in depth_grid:
        p = [mean[path[min(d, len(path) - 1)]] for path in paths]
        sse = sum(r.ss - 2 * p[leaf] * r.s + r.n * p[leaf] ** 2 for leaf, r in held.items())
        out[d] = float(np.sqrt(max(sse, 0.0) / total)) if total else 0.0
    return out


def tree_summary(data: DataFrame, idx_cols: list[str], kind: str = "dt") -> DataFrame:
    """Fitted-model summary: one row per feature with its importance (M7)."""
    model = fit_tree(data, kind)
    tree = model.stages[-1]
    imp = tree.featureImportances.toArray().tolist()
    depth = int(tree.depth) if kind == "dt" else max(int(t.depth) for t in tree.trees)
    nodes = int(tree.numNodes) if kind == "dt" else int(tree.totalNumNodes)
    rows = [(kind, name, round(float(imp[i]), 6), depth, nodes) for i, name in enumerate(idx_cols)]
    return data.sparkSession.createDataFrame(
        rows, "model string, feature string, importance double, depth int, num_nodes int")
