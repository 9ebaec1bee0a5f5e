"""Bagged-tree keys: node_mse, best_split, numeric_mean_split, bagged_fit,
bagged_predict, ensemble_mean.

Training rows are the 70% md5 split of ``orders`` (bagging binding); the test
file of the original job is the other 30%. Default job options: 11 shards,
1000 samples of 1,000,000 rows per shard (smaller shards are one sample).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postpulse.catalog import register
from postpulse.functions.hashing import sql_md5_number, sql_md5_words
from postpulse.functions.numeric import sig_round, sql_sig_round
from postpulse.operators.sampling import SAMPLE_SEED, SHARD_SEED, SPLIT_SEED, hash_split
from postpulse.plans import bagged as bg
from postpulse.sources import fixtures as fx

ATTRS = [bg.Attr(a) for a in fx.BAGGING_ATTRS]
TARGET = fx.BAGGING_TARGET
N_SHARDS = bg.MAX_SPLIT_NUMBER + 1
_H1, _H2 = sql_md5_words(SAMPLE_SEED, "row_id")


def _split(spark, base):
    return hash_split(fx.bagging_rows(spark, base), "row_id")


def _root_cells(spark, base, attrs):
    """Root cells of every tree (y shifted by the training mean) and that shift."""
    train, _ = _split(spark, base)
    shift = bg.target_shift(train, TARGET)
    samples = bg.sample_trees(train, "row_id")
    return bg.to_cells(samples, attrs, TARGET, shift).withColumn("node", F.lit(bg.ROOT)), shift


# DuckDB: bagging rows, split, shards and samples with the default options.
SAMPLES_SQL = f"""
r AS (
  SELECT o_orderkey AS row_id, o_orderstatus, o_orderpriority,
         CAST(month(o_orderdate) AS VARCHAR) AS o_month, CAST(day(o_orderdate) AS VARCHAR) AS o_day,
         CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice AS y
  FROM orders WHERE {sql_md5_number(SPLIT_SEED, 'o_orderkey')} % 100 < 70),
sh AS (SELECT *, CAST({sql_md5_number(SHARD_SEED, 'row_id')} % {N_SHARDS} AS INTEGER) AS shard FROM r),
cnt AS (SELECT shard, count(*) AS n FROM sh GROUP BY shard),
rep AS (
  SELECT sh.*, unnest(CASE WHEN cnt.n >= {bg.SAMPLE_SIZE} THEN range(0, {bg.SAMPLE_NUMBER}) ELSE [0] END) AS rep
  FROM sh JOIN cnt ON sh.shard = cnt.shard),
s AS (
  SELECT * EXCLUDE (rn), shard * {bg.SAMPLE_NUMBER} + rep AS tree FROM (
    SELECT *, row_number() OVER (PARTITION BY shard, rep
              ORDER BY ({_H1} + rep * {_H2}) % 4294967296, row_id) AS rn FROM rep)
  WHERE rn <= {bg.SAMPLE_SIZE})"""


@register("node_mse", f"""
WITH {SAMPLES_SQL}
SELECT CAST(tree AS BIGINT) AS tree, count(*) AS n, round(sum(y), 2) / count(*) AS mean,
       {sql_sig_round('var_pop(y)')} AS mse
FROM s GROUP BY tree""")
def q_node_mse(spark, base):
    """Root-node size, mean and mean squared error of every tree."""
    cells, shift = _root_cells(spark, base, ATTRS)
    st = bg.node_stats(cells, ATTRS)
    total = F.col("S1") + F.col("N") * F.lit(shift)
    return st.select("tree", F.col("N").alias("n"), (F.round(total, 2) / F.col("N")).alias("mean"),
                     sig_round(F.col("mse")).alias("mse"))


def _attr_case(col: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{a.name}'" for i, a in enumerate(ATTRS))
    return f"CASE {col} {whens} END"


BRANCH_SQL = " UNION ALL ".join(
    f"SELECT tree, {i} AS attr_pos, coalesce('{bg.VALUE}' || CAST({a.name} AS VARCHAR), '{bg.MISSING}') AS v, count(*) AS n, "
    f"var_pop(y) * count(*) AS sse FROM s GROUP BY tree, {a.name}"
    for i, a in enumerate(ATTRS))


@register("best_split", f"""
WITH {SAMPLES_SQL},
node AS (SELECT tree, count(*) AS N, var_pop(y) AS mse, avg((y - (SELECT avg(y) FROM r)) * (y - (SELECT avg(y) FROM r))) AS ms FROM s GROUP BY tree),
br AS ({BRANCH_SQL}),
pa AS (SELECT tree, attr_pos, count(*) AS k, sum(sse) AS SSE FROM br GROUP BY tree, attr_pos),
cand AS (
  SELECT pa.tree, attr_pos, k, SSE / N AS err, round(SSE / N / mse, 9) AS key
  FROM pa JOIN node ON pa.tree = node.tree
  WHERE k >= 2 AND N > 1 AND mse > 1e-12 * ms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY key, attr_pos) AS rn FROM cand)
SELECT CAST(tree AS BIGINT) AS tree, attr_pos, {_attr_case('attr_pos')} AS attr,
       {sql_sig_round('err')} AS err, k AS n_branches
FROM ranked WHERE rn = 1""")
def q_best_split(spark, base):
    """Best root split of every tree: attribute, weighted error, branch count."""
    active, _ = _root_cells(spark, base, ATTRS)
    st = bg.node_stats(active, ATTRS)
    br = bg.branch_stats(active, st, ATTRS)
    best = bg.best_splits(br, st)
    k = br.groupBy("tree", "node", "attr_pos").agg(F.count(F.lit(1)).alias("n_branches"))
    names = F.element_at(F.array(*[F.lit(a.name) for a in ATTRS]), F.col("attr_pos") + 1)
    return (best.join(k, ["tree", "node", "attr_pos"])
                .select("tree", "attr_pos", names.alias("attr"), sig_round(F.col("err")).alias("err"),
                        "n_branches"))


NUM_ATTRS = [bg.Attr("o_custkey", "N")]


@register("numeric_mean_split", f"""
WITH {SAMPLES_SQL},
node AS (SELECT tree, avg(o_custkey) AS m, count(*) AS total FROM s GROUP BY tree),
br AS (
  SELECT s.tree, CASE WHEN o_custkey < node.m THEN 'L' ELSE 'R' END AS v,
         count(*) AS n, var_pop(y) * count(*) AS sse
  FROM s JOIN node ON s.tree = node.tree GROUP BY ALL)
SELECT CAST(br.tree AS BIGINT) AS tree, {sql_sig_round('any_value(node.m)')} AS split_cond,
       CAST(coalesce(sum(br.n) FILTER (WHERE v = 'L'), 0) AS BIGINT) AS n_left,
       CAST(coalesce(sum(br.n) FILTER (WHERE v = 'R'), 0) AS BIGINT) AS n_right,
       {sql_sig_round('sum(sse) / any_value(node.total)')} AS err
FROM br JOIN node ON br.tree = node.tree GROUP BY br.tree""")
def q_numeric_mean_split(spark, base):
    """Root split of every tree on a numeric attribute at its mean: < left, else right."""
    active, _ = _root_cells(spark, base, NUM_ATTRS)
    st = bg.node_stats(active, NUM_ATTRS)
    br = bg.branch_stats(active, st, NUM_ATTRS)
    agg = br.groupBy("tree", "node").agg(
        F.coalesce(F.sum(F.when(F.col("value") == "L", F.col("n"))), F.lit(0)).cast("long").alias("n_left"),
        F.coalesce(F.sum(F.when(F.col("value") == "R", F.col("n"))), F.lit(0)).cast("long").alias("n_right"),
        F.sum("sse").alias("SSE"))
    return (agg.join(st, ["tree", "node"])
               .select("tree", sig_round(F.col("_mean0")).alias("split_cond"), "n_left", "n_right",
                       sig_round(F.col("SSE") / F.col("N")).alias("err")))


def _on_cent_grid(mean: str, n: str):
    """A node mean reported as (its total on the target's cent grid) / n.

    Means of 2, 4, 8 ... cent values end in an exact 5 at some digit, so any
    fixed rounding of the mean can tie; the total is on the data's grid and
    the division is the same IEEE operation in every engine.
    """
    return (F.round(F.col(mean) * F.col(n), 2) / F.col(n)).alias("prediction")


def _model(spark, base):
    train, test = _split(spark, base)
    return bg.fit(train, "row_id", ATTRS, TARGET), test


# ---- DuckDB oracle for the full trees: growth unrolled over the levels -------
# With categorical attributes only, a path uses each attribute at most once, so
# every tree is finished after len(ATTRS) + 1 levels.
LEVELS = len(ATTRS) + 1
ATTR_COLS = ", ".join(a.name for a in ATTRS)


def _value_case(pos: str, prefix: str = "") -> str:
    whens = " ".join(f"WHEN {i} THEN coalesce('{bg.VALUE}' || CAST({prefix}{a.name} AS VARCHAR), '{bg.MISSING}')"
                     for i, a in enumerate(ATTRS))
    return f"(CASE {pos} {whens} END)"


def _fit_sql(samples: str = SAMPLES_SQL) -> str:
    ctes = [samples.strip(),
            f"a0 AS (SELECT tree, row_id, {ATTR_COLS}, y, '' AS node FROM s)"]
    for lv in range(LEVELS):
        branches = " UNION ALL ".join(
            f"SELECT tree, node, {i} AS attr_pos, coalesce('{bg.VALUE}' || CAST({a.name} AS VARCHAR), '{bg.MISSING}') AS v, count(*) AS cnt, "
            f"var_pop(y) * count(*) AS sse FROM a{lv} GROUP BY tree, node, {a.name}"
            for i, a in enumerate(ATTRS))
        ctes += [
            f"st{lv} AS (SELECT tree, node, count(*) AS cnt, avg(y) AS mean, var_pop(y) AS mse, "
            f"avg((y - (SELECT avg(y) FROM r)) * (y - (SELECT avg(y) FROM r))) AS ms FROM a{lv} GROUP BY tree, node)",
            f"br{lv} AS ({branches})",
            f"pa{lv} AS (SELECT tree, node, attr_pos, count(*) AS k, sum(sse) AS sse_tot "
            f"FROM br{lv} GROUP BY tree, node, attr_pos)",
            f"cand{lv} AS (SELECT pa.tree, pa.node, pa.attr_pos, "
            f"round(pa.sse_tot / st.cnt / st.mse, 9) AS key FROM pa{lv} pa JOIN st{lv} st "
            f"ON pa.tree = st.tree AND pa.node = st.node "
            f"WHERE pa.k >= 2 AND st.cnt > 1 AND st.mse > 1e-12 * st.ms)",
            f"best{lv} AS (SELECT tree, node, attr_pos FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY tree, node ORDER BY key, attr_pos) AS rn FROM cand{lv}) WHERE rn = 1)",
            f"nd{lv} AS (SELECT st.tree, st.node, {lv} AS depth, st.cnt AS n, st.mean AS prediction, "
            f"b.attr_pos IS NULL AS is_leaf, b.attr_pos FROM st{lv} st LEFT JOIN best{lv} b "
            f"ON st.tree = b.tree AND st.node = b.node)",
            f"ed{lv} AS (SELECT br.tree, br.node, br.v, md5(br.node || '|' || CAST(br.attr_pos AS VARCHAR) "
            f"|| '|' || br.v) AS child FROM br{lv} br JOIN best{lv} b ON br.tree = b.tree "
            f"AND br.node = b.node AND br.attr_pos = b.attr_pos)",
            f"a{lv + 1} AS (SELECT a.tree, a.row_id, {', '.join('a.' + a.name for a in ATTRS)}, a.y, "
            f"md5(a.node || '|' || CAST(b.attr_pos AS VARCHAR) || '|' || {_value_case('b.attr_pos', 'a.')}) "
            f"AS node FROM a{lv} a JOIN best{lv} b ON a.tree = b.tree AND a.node = b.node)",
        ]
    ctes.append("nodes AS (" + " UNION ALL ".join(f"SELECT * FROM nd{lv}" for lv in range(LEVELS)) + ")")
    ctes.append("edges AS (" + " UNION ALL ".join(f"SELECT * FROM ed{lv}" for lv in range(LEVELS)) + ")")
    ctes.append("defaults AS (SELECT tree, node, arg_min(child, v) AS default_child FROM edges "
                "GROUP BY tree, node)")
    return ",\n".join(ctes)


def _predict_sql(samples: str = SAMPLES_SQL) -> str:
    test = (f"SELECT o_orderkey AS row_id, o_orderstatus, o_orderpriority, "
            f"CAST(month(o_orderdate) AS VARCHAR) AS o_month, CAST(day(o_orderdate) AS VARCHAR) AS o_day "
            f"FROM orders WHERE NOT ({sql_md5_number(SPLIT_SEED, 'o_orderkey')} % 100 < 70)")
    ctes = [_fit_sql(samples),
            f"t0 AS (SELECT unnest((SELECT list(DISTINCT tree) FROM nodes)) AS tree, x.row_id, "
            f"{', '.join('x.' + a.name for a in ATTRS)}, '' AS node FROM ({test}) x)"]
    for lv in range(LEVELS):
        ctes += [
            f"p{lv} AS (SELECT t.*, n.is_leaf, n.prediction, n.attr_pos FROM t{lv} t JOIN nodes n "
            f"ON t.tree = n.tree AND t.node = n.node)",
            f"t{lv + 1} AS (SELECT p.tree, p.row_id, {', '.join('p.' + a.name for a in ATTRS)}, "
            f"coalesce(e.child, d.default_child) AS node FROM p{lv} p "
            f"LEFT JOIN edges e ON p.tree = e.tree AND p.node = e.node "
            f"AND e.v = {_value_case('p.attr_pos', 'p.')} "
            f"JOIN defaults d ON p.tree = d.tree AND p.node = d.node WHERE NOT p.is_leaf)",
        ]
    ctes.append("preds AS (" + " UNION ALL ".join(
        f"SELECT p.tree, p.row_id, p.prediction, n.n AS leaf_n FROM p{lv} p JOIN nodes n "
        f"ON p.tree = n.tree AND p.node = n.node WHERE p.is_leaf" for lv in range(LEVELS)) + ")")
    return ",\n".join(ctes)


@register("bagged_fit", f"""
WITH {_fit_sql()}
SELECT CAST(tree AS BIGINT) AS tree, node, CAST(depth AS INTEGER) AS depth, n,
       round(prediction * n, 2) / n AS prediction, is_leaf, attr_pos
FROM nodes""")
def q_bagged_fit(spark, base):
    """Every node of every tree."""
    model, _ = _model(spark, base)
    return model.nodes.select("tree", "node", "depth", "n", _on_cent_grid("prediction", "n"),
                              "is_leaf", "attr_pos")


@register("bagged_predict", f"""
WITH {_predict_sql()}
SELECT CAST(tree AS BIGINT) AS tree, row_id, round(prediction * leaf_n, 2) / leaf_n AS prediction, leaf_n
FROM preds""")
def q_bagged_predict(spark, base):
    """Every tree's prediction for every test row."""
    model, test = _model(spark, base)
    return bg.predict_rows(model, test, "row_id").select(
        "tree", "row_id", _on_cent_grid("prediction", "leaf_n"), "leaf_n")


def _ensemble_sql(samples: str = SAMPLES_SQL) -> str:
    return f"""
WITH {_predict_sql(samples)}
SELECT row_id, CAST(sum(CAST(floor(round(prediction * leaf_n, 2) / leaf_n * {bg.GRID} + 0.5) AS BIGINT))
                    AS DOUBLE) / (count(*) * {bg.GRID}) AS prediction, count(*) AS n_trees
FROM preds GROUP BY row_id"""


def _ensemble(model, test):
    return bg.ensemble_mean(model, test, "row_id", F.round(
        F.col("prediction") * F.col("leaf_n"), 2) / F.col("leaf_n")).select(
        "row_id", "prediction", "n_trees")


@register("ensemble_mean", _ensemble_sql())
def q_ensemble_mean(spark, base):
    """Equal-weight mean of the trees' predictions per test row."""
    model, test = _model(spark, base)
    return _ensemble(model, test)


MULTI_NUMBER, MULTI_SIZE = 3, 200


MANY_NUMBER = 100


def _multi_samples_sql(number: int) -> str:
    return (SAMPLES_SQL.replace(f">= {bg.SAMPLE_SIZE} ", f">= {MULTI_SIZE} ")
            .replace(f"range(0, {bg.SAMPLE_NUMBER})", f"range(0, {number})")
            .replace(f"shard * {bg.SAMPLE_NUMBER}", f"shard * {number}")
            .replace(f"rn <= {bg.SAMPLE_SIZE}", f"rn <= {MULTI_SIZE}"))


def _root_split_sql(number: int) -> str:
    return f"""
WITH {_multi_samples_sql(number)},
node AS (SELECT tree, count(*) AS N, var_pop(y) AS mse, avg((y - (SELECT avg(y) FROM r)) * (y - (SELECT avg(y) FROM r))) AS ms FROM s GROUP BY tree),
br AS ({BRANCH_SQL}),
pa AS (SELECT tree, attr_pos, count(*) AS k, sum(sse) AS SSE FROM br GROUP BY tree, attr_pos),
cand AS (
  SELECT pa.tree, attr_pos, k, round(SSE / N / mse, 9) AS key
  FROM pa JOIN node ON pa.tree = node.tree
  WHERE k >= 2 AND N > 1 AND mse > 1e-12 * ms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY key, attr_pos) AS rn FROM cand)
SELECT CAST(node.tree AS BIGINT) AS tree, N AS n, ranked.attr_pos, ranked.k AS n_branches
FROM node JOIN ranked ON node.tree = ranked.tree WHERE rn = 1"""


def _root_splits(spark, base, number):
    train, _ = _split(spark, base)
    samples = bg.sample_trees(train, "row_id", number=number, size=MULTI_SIZE)
    model = bg.fit_cells(bg.to_cells(samples, ATTRS, TARGET, bg.target_shift(train, TARGET)), ATTRS,
                         max_depth=1)
    root = model.nodes.where(F.col("node") == bg.ROOT)
    children = model.edges.where(F.col("node") == bg.ROOT).groupBy("tree").agg(
        F.count(F.lit(1)).alias("n_branches"))
    return root.join(children, "tree").select("tree", "n", "attr_pos", "n_branches")


@register("bagged_multi_sample", _root_split_sql(MULTI_NUMBER))
def q_bagged_multi_sample(spark, base):
    """Several samples per shard, smaller than the shard: one tree each, with its root split."""
    return _root_splits(spark, base, MULTI_NUMBER)


@register("bagged_many_samples", _root_split_sql(MANY_NUMBER))
def q_bagged_many_samples(spark, base):
    """A hundred samples of every shard: 1,100 trees grown together."""
    return _root_splits(spark, base, MANY_NUMBER)


@register("ensemble_many_trees", _ensemble_sql(_multi_samples_sql(MANY_NUMBER)))
def q_ensemble_many_trees(spark, base):
    """Mean over 1,100 full trees per test row: no row per tuple and tree."""
    train, test = _split(spark, base)
    model = bg.fit(train, "row_id", ATTRS, TARGET, number=MANY_NUMBER, size=MULTI_SIZE)
    return _ensemble(model, test)
