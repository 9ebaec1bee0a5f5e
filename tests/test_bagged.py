"""Level-wise bagged trees against a plain recursive builder (brute force)."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postpulse.plans import bagged as bg
from postpulse.sources import fixtures as fx
from postpulse.operators.sampling import hash_split

# ---- plain recursion with the same rules ------------------------------------


def _mse(ys):
    m = sum(ys) / len(ys)
    return sum((y - m) ** 2 for y in ys) / len(ys)


def build(recs, attrs, shift=0.0):
    """recs: list of (tuple_of_attr_values, y). Returns a nested dict tree.

    Zero error means mse below 1e-12 of the mean square of (y - shift).
    """
    ys = [y for _, y in recs]
    mean = sum(ys) / len(ys)
    node_mse = _mse(ys)
    if len(recs) <= 1 or node_mse <= 1e-12 * (sum((y - shift) ** 2 for y in ys) / len(ys)):
        return {"leaf": mean}
    best = None
    for i, a in enumerate(attrs):
        groups = defaultdict(list)
        if a.kind == "N":
            xm = sum(r[0][i] for r in recs) / len(recs)
            for r in recs:
                groups["L" if r[0][i] < xm else "R"].append(r)
        else:
            xm = None
            for r in recs:
                groups[str(r[0][i])].append(r)
        if len(groups) < 2:
            continue
        err = sum(len(g) / len(recs) * _mse([y for _, y in g]) for g in groups.values())
        key = round(err / node_mse, 9)
        if best is None or key < best[0]:
            best = (key, i, xm, groups)
    if best is None:
        return {"leaf": mean}
    _, i, xm, groups = best
    return {"attr": i, "cond": xm, "kids": {v: build(g, attrs, shift) for v, g in groups.items()}}


def apply(node, values, attrs):
    while "leaf" not in node:
        i = node["attr"]
        if attrs[i].kind == "N":
            v = "L" if values[i] < node["cond"] else "R"
        else:
            v = str(values[i])
            if v not in node["kids"]:
                v = min(node["kids"])
        node = node["kids"][v]
    return node["leaf"]

# ------------------------------------------------------------------------------


def _fit_predict(spark, rows, attrs, test_rows):
    schema = "row_id long, " + ", ".join(
        f"{a.name} {'double' if a.kind == 'N' else 'string'}" for a in attrs) + ", y double"
    df = spark.createDataFrame(rows, schema)
    tdf = spark.createDataFrame(test_rows, schema)
    cells = df.withColumn("tree", F.lit(0).cast("long")).transform(
        lambda d: bg.to_cells(d, attrs, "y"))
    model = bg.fit_cells(cells, attrs)
    preds = {r.row_id: r.prediction for r in bg.predict_rows(model, tdf, "row_id").collect()}
    return model, preds


def test_single_row_node_is_leaf(spark):
    attrs = [bg.Attr("a")]
    model, preds = _fit_predict(spark, [(1, "x", 5.0)], attrs, [(9, "x", 0.0)])
    nodes = model.nodes.collect()
    assert len(nodes) == 1 and nodes[0].is_leaf and preds == {9: 5.0}


def test_constant_attributes_give_leaf_with_mean(spark):
    attrs = [bg.Attr("a"), bg.Attr("b")]
    rows = [(1, "x", "p", 1.0), (2, "x", "p", 3.0), (3, "x", "p", 8.0)]
    model, preds = _fit_predict(spark, rows, attrs, [(9, "x", "p", 0.0)])
    assert preds == {9: 4.0}
    assert model.nodes.count() == 1


def test_equal_error_picks_earlier_attribute(spark):
    attrs = [bg.Attr("a"), bg.Attr("b")]
    rows = [(1, "x", "p", 1.0), (2, "x", "p", 1.0), (3, "y", "q", 9.0), (4, "y", "q", 9.0)]
    model, _ = _fit_predict(spark, rows, attrs, rows)
    root = model.nodes.filter(F.col("node") == bg.ROOT).first()
    assert root.attr_pos == 0


def test_unseen_category_follows_smallest_value(spark):
    attrs = [bg.Attr("a")]
    rows = [(1, "b", "", 2.0), (2, "b", "", 2.0), (3, "c", "", 7.0), (4, "c", "", 7.0)]
    rows = [(r[0], r[1], r[3]) for r in rows]
    _, preds = _fit_predict(spark, rows, attrs, [(9, "zzz", 0.0), (10, "a", 0.0)])
    assert preds == {9: 2.0, 10: 2.0}


def test_numeric_split_at_mean(spark):
    attrs = [bg.Attr("x", "N")]
    rows = [(1, 1.0, 10.0), (2, 2.0, 10.0), (3, 10.0, 50.0), (4, 11.0, 52.0)]
    model, preds = _fit_predict(spark, rows, attrs, [(9, 3.0, 0.0), (10, 20.0, 0.0)])
    assert preds[9] == 10.0
    assert preds[10] == pytest.approx(52.0)   # (10, 11) split again at 10.5


def test_matches_recursive_builder_on_orders(spark):
    attrs = [bg.Attr(a) for a in fx.BAGGING_ATTRS]
    rows = fx.bagging_rows(spark, "/root/testdata/sf0.001")
    train, test = hash_split(rows, "row_id")
    samples = bg.sample_trees(train, "row_id", max_split=3, number=2, size=200)
    model = bg.fit_cells(bg.to_cells(samples, attrs, fx.BAGGING_TARGET), attrs)
    got = {(r.tree, r.row_id): r.prediction for r in bg.predict_rows(model, test, "row_id").collect()}

    by_tree = defaultdict(list)
    for r in samples.collect():
        by_tree[r.tree].append((tuple(r[a.name] for a in attrs), r[fx.BAGGING_TARGET]))
    test_rows = [(r.row_id, tuple(r[a.name] for a in attrs)) for r in test.collect()]
    assert len(by_tree) >= 4
    for tree, recs in by_tree.items():
        root = build(recs, attrs)
        for rid, vals in test_rows:
            assert got[(tree, rid)] == pytest.approx(apply(root, vals, attrs), rel=1e-9)

    ens = {r.row_id: r.prediction for r in bg.ensemble_mean(model, test, "row_id").collect()}
    for rid, _ in test_rows:
        per = [got[(t, rid)] for t in by_tree]
        assert ens[rid] == pytest.approx(sum(per) / len(per), rel=1e-9)


def test_mixed_numeric_and_categorical_match_recursion(spark):
    attrs = [bg.Attr("o_orderstatus"), bg.Attr("o_custkey", "N")]
    rows = fx.bagging_rows(spark, "/root/testdata/sf0.001").limit(120)
    data = [(r.row_id, r.o_orderstatus, r.o_custkey, r.o_totalprice) for r in rows.collect()]
    recs = [((r[1], r[2]), r[3]) for r in data]
    _, preds = _fit_predict(spark, data, attrs, data)
    root = build(recs, attrs)
    for r in data:
        assert preds[r[0]] == pytest.approx(apply(root, (r[1], r[2]), attrs), rel=1e-9)


def test_large_mean_small_spread_target_matches_recursion(spark):
    attrs = [bg.Attr("a"), bg.Attr("b")]
    data = [(i, f"a{i % 3}", f"b{(i * 7) % 5}", 1.6e9 + (i % 3) * 2.0 + ((i * 7) % 5) * 0.5 + (i % 11) * 0.01)
            for i in range(300)]
    df = spark.createDataFrame(data, "row_id long, a string, b string, y double")
    model = bg.fit(df, "row_id", attrs, "y", max_split=2)
    assert abs(model.shift - sum(r[3] for r in data) / len(data)) < 1e-3
    samples = bg.sample_trees(df, "row_id", max_split=2)
    by_tree = defaultdict(list)
    for r in samples.collect():
        by_tree[r.tree].append(((r.a, r.b), r.y))
    got = {(r.tree, r.row_id): r.prediction for r in bg.predict_rows(model, df, "row_id").collect()}
    for tree, recs in by_tree.items():
        root = build(recs, attrs, model.shift)
        for rid, a, b, _ in data:
            assert got[(tree, rid)] == pytest.approx(apply(root, (a, b), attrs), rel=1e-12)


def test_missing_attribute_follows_default_branch(spark):
    attrs = [bg.Attr("a")]
    rows = [(1, "b", 2.0), (2, "b", 2.0), (3, "c", 7.0), (4, "c", 7.0)]
    _, preds = _fit_predict(spark, rows, attrs, [(9, None, 0.0)])
    assert preds == {9: 2.0}


def test_missing_category_is_its_own_branch(spark):
    attrs = [bg.Attr("a")]
    rows = [(1, "b", 2.0), (2, "b", 2.0), (3, None, 7.0), (4, None, 7.0)]
    model, preds = _fit_predict(spark, rows, attrs, [(9, None, 0.0), (10, "b", 0.0)])
    assert preds == {9: 7.0, 10: 2.0}
    assert model.nodes.filter(F.col("node").isNull()).count() == 0


def test_hot_tuple_collapses_to_one_cell_per_tree(spark):
    attrs = [bg.Attr("a"), bg.Attr("b")]
    data = [(i, "hot" if i % 3 == 0 else f"a{i % 4}", "x" if i % 3 == 0 else f"b{i % 5}", float(i % 17))
            for i in range(3000)]
    df = spark.createDataFrame(data, "row_id long, a string, b string, y double")
    samples = bg.sample_trees(df, "row_id", max_split=3, number=2, size=300)
    cells = bg.to_cells(samples, attrs, "y")
    n_trees = samples.select("tree").distinct().count()
    hot = cells.filter((F.col("a") == "hot") & (F.col("b") == "x"))
    assert hot.count() == n_trees        # one row per tree, whatever its number of copies
    assert hot.agg(F.sum("n")).first()[0] == samples.filter(F.col("a") == "hot").count()


def test_values_that_look_like_paths_stay_apart(spark):
    """Categories with the characters of a path, and empty, missing and odd ones."""
    attrs = [bg.Attr("u"), bg.Attr("v")]
    rows = [(1, "a", "b", 10.0), (2, "a", "c", 20.0), (3, "a/1=b", "b", 101.0),
            (4, "a/1=b", "c", 300.0)]
    model, preds = _fit_predict(spark, rows, attrs, rows)
    assert preds == {1: 10.0, 2: 20.0, 3: 101.0, 4: 300.0}
    assert model.nodes.agg(F.max("depth")).first()[0] == 2
    odd = ["", "∅", "z", "v", "|", "a|1|v", "=", "/"]
    rows = [(2 * i + j, u, w, float(i * 7 + j * 100)) for i, u in enumerate(odd)
            for j, w in enumerate(["b", "c"])]
    rows += [(90, None, "b", 5000.0), (91, None, "c", 6000.0)]
    _, preds = _fit_predict(spark, rows, attrs, rows)
    assert len(preds) == len(rows)
    assert preds == {r[0]: r[3] for r in rows}


def test_numeric_mean_leaves_missing_numbers_out(spark):
    attrs = [bg.Attr("x", "N")]
    rows = [(1, 1.0, 1.0), (2, None, 9.0), (3, 3.0, 9.0)]
    model, _ = _fit_predict(spark, rows, attrs, rows)
    root = model.nodes.filter(F.col("node") == bg.ROOT).first()
    assert root.split_cond == 2.0


def test_prediction_plan_of_many_trees_is_built_quickly(spark):
    import time
    trees = spark.range(11_000).select(F.col("id").alias("tree"))
    nodes = trees.select("tree", F.lit(bg.ROOT).alias("node"), F.lit(0).alias("depth"),
                         F.lit(1).cast("long").alias("n"), F.col("tree").cast("double").alias("prediction"),
                         F.lit(True).alias("is_leaf"), F.lit(None).cast("int").alias("attr_pos"),
                         F.lit(None).cast("double").alias("split_cond"),
                         F.lit(None).cast("string").alias("default_child"))
    edges = spark.createDataFrame([], "tree long, node string, value string, child string")
    model = bg.BaggedModel(nodes=nodes, edges=edges, attrs=[bg.Attr("a")], trees=trees)
    rows = spark.createDataFrame([(1, "x")], "row_id long, a string")
    began = time.time()
    out = bg.predict_rows(model, rows, "row_id")
    assert time.time() - began < 20      # one eager checkpoint; no literal list of trees
    assert out.count() == 11_000


def test_tuples_that_share_a_path_move_as_one_row(spark):
    """One split on ``a``: a row per tree and value of it, however many tuples there are."""
    attrs = [bg.Attr("a"), bg.Attr("b"), bg.Attr("x", "N")]
    data = [(i, f"a{i % 3}", f"b{i % 50}", float(i), float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(data, "row_id long, a string, b string, x double, y double")
    model = bg.fit(df, "row_id", attrs, "y", max_split=3, number=4, size=60)
    test = spark.createDataFrame(data + [(900, None, None, None, 0.0), (901, "new", "b1", 2.0, 0.0)],
                                 df.schema)
    groups = bg.leaf_groups(model, bg.distinct_tuples(test, ["a", "b", "x"]))
    n_trees = model.trees.count()
    assert n_trees == 16
    assert groups.count() == n_trees * 5          # a0, a1, a2, missing, new
    assert {r.used for r in groups.select("used").distinct().collect()} == {1}
    got = {r.row_id: (r.prediction, r.n_trees) for r in bg.ensemble_mean(model, test, "row_id").collect()}
    assert got == {**{r[0]: (r[4], n_trees) for r in data}, 900: (0.0, n_trees), 901: (0.0, n_trees)}
    assert bg.predict_rows(model, test, "row_id").count() == n_trees * 302


def test_no_rows_to_predict(spark):
    attrs = [bg.Attr("a")]
    _, preds = _fit_predict(spark, [(1, "b", 2.0), (2, "c", 7.0)], attrs, [])
    assert preds == {}
