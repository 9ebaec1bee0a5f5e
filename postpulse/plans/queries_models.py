"""Model keys: mean_baseline, string_index, vector_index, assemble_features,
dt_rmse, rf_rmse, dt_cv, rf_cv, tree_summary.

Keys with a fitted model are checked by rows only (their numbers depend on
Spark ML's tree learner); the index and baseline keys have SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postpulse.catalog import register
from postpulse.functions.hashing import sql_md5_number
from postpulse.operators.sampling import SPLIT_SEED
from postpulse.plans import models
from postpulse.sources import fixtures as fx
from postpulse.sources.tables import table

MODEL_SQL = """
m AS (
  SELECT event_id, user_id, event_type AS subreddit,
         CAST(hour(ts) AS VARCHAR) AS HoD, CAST(isodow(ts) AS VARCHAR) AS DoW,
         CAST(day(ts) AS VARCHAR) AS DoM, CAST(month(ts) AS VARCHAR) AS month,
         CAST(year(ts) AS VARCHAR) AS year, CAST(trunc(value) AS INTEGER) AS score
  FROM events)"""

TEXT_COLS = ["subreddit", "HoD", "DoW", "DoM", "month", "year"]


def _index_sql(select_cols: str) -> str:
    ctes = [MODEL_SQL]
    for c in TEXT_COLS:
        ctes.append(f"""i_{c} AS (
  SELECT {c} AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS DOUBLE) AS idx
  FROM m GROUP BY {c})""")
    joins = " ".join(f"JOIN i_{c} ON m.{c} = i_{c}.v" for c in TEXT_COLS)
    return f"WITH {','.join(ctes)}\nSELECT {select_cols} FROM m {joins}"


MANY_SQL = """
many AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_quantity <= 17 THEN 'hot' WHEN l_quantity <= 25 THEN NULL
              ELSE concat(l_partkey, '-', l_suppkey, '-', l_quantity) END AS code
  FROM lineitem)"""


@register("string_index_many", f"""
WITH {MANY_SQL},
i AS (SELECT code AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, code) - 1 AS DOUBLE) AS idx
      FROM many WHERE code IS NOT NULL GROUP BY code)
SELECT l_orderkey, l_linenumber,
       coalesce(i.idx, CAST((SELECT count(*) FROM i) AS DOUBLE)) AS "codeIndex"
FROM many LEFT JOIN i ON many.code = i.v""")
def q_string_index_many(spark, base):
    """A column with about as many values as rows, and one value that holds a third of them."""
    rows = table(spark, base, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") <= 17, "hot").when(
            F.col("l_quantity") > 25, F.concat(
                F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"),
                F.lit("-"), F.col("l_quantity").cast("string"))).alias("code"))
    return models.index_strings(rows, ["code"], handle_invalid="keep")


def _prepared(spark, base):
    return models.prepare(fx.model_rows(spark, base))


@register("mean_baseline", f"""
WITH {MODEL_SQL},
s AS (SELECT score, CASE WHEN {sql_md5_number(SPLIT_SEED, 'event_id')} % 100 < 70
                         THEN 'train' ELSE 'test' END AS split FROM m),
tr AS (SELECT count(*) AS n, sum(score) / count(*) AS mean FROM s WHERE split = 'train')
SELECT (SELECT n FROM tr) AS n_train, count(*) AS n_test,
       round((SELECT mean FROM tr), 6) AS mean_score,
       round(sqrt(avg(power(score - (SELECT mean FROM tr), 2))), 6) AS rmse
FROM s WHERE split = 'test'""")
def q_mean_baseline(spark, base):
    return models.mean_baseline(fx.model_rows(spark, base))


@register("string_index", _index_sql(
    "m.event_id, " + ", ".join(f"i_{c}.idx AS {c}Index" for c in TEXT_COLS)))
def q_string_index(spark, base):
    rows = fx.model_rows(spark, base)
    cats = models.text_columns(rows)
    return models.index_strings(rows, cats).select("event_id", *[c + "Index" for c in cats])


@register("assemble_features", _index_sql(
    "m.event_id, m.score AS label, " + ", ".join(f"i_{c}.idx AS f{i}" for i, c in enumerate(TEXT_COLS))))
def q_assemble_features(spark, base):
    data, idx = _prepared(spark, base)
    return models.flatten(data.drop("split"), "features", "f", len(idx))


def _vector_index_sql() -> str:
    parts = [f"SELECT {i} AS feature, '{c}Index' AS name, idx, count(*) OVER () AS n_values, "
             f"CAST(row_number() OVER (ORDER BY CASE WHEN idx = 0 THEN 0 ELSE 1 END, idx) - 1 AS INTEGER) "
             f"AS place FROM i_{c}" for i, c in enumerate(TEXT_COLS)]
    ctes = _index_sql("1").split("\nSELECT")[0]
    return f"""{ctes}, f AS ({' UNION ALL '.join(parts)})
SELECT CAST(feature AS INTEGER) AS feature, name, n_values <= {models.MAX_CATEGORIES} AS categorical,
       CAST(CASE WHEN n_values <= {models.MAX_CATEGORIES} THEN n_values END AS BIGINT) AS n_values,
       CASE WHEN n_values <= {models.MAX_CATEGORIES} THEN idx END AS value,
       CASE WHEN n_values <= {models.MAX_CATEGORIES} THEN place END AS place
FROM f WHERE n_values <= {models.MAX_CATEGORIES} OR idx = 0"""


@register("vector_index", _vector_index_sql())
def q_vector_index(spark, base):
    """The fitted map: which features are categorical, and the place of each of their values
    (value 0 first, then ascending); a continuous feature is one row without values."""
    data, idx = _prepared(spark, base)
    return models.category_map(data, idx)


def _stump_sql() -> str:
    base = _index_sql("m.event_id, m.score AS label, " + ", ".join(
        f"i_{c}.idx AS f{i}" for i, c in enumerate(TEXT_COLS)))
    parts = []
    for i, c in enumerate(TEXT_COLS):
        parts.append(f"SELECT {i} AS f, '{c}Index' AS feature, f{i} AS v, count(*) AS n, sum(label) AS s, "
                     f"(SELECT count(DISTINCT f{i}) FROM d) <= {models.MAX_CATEGORIES} AS cat "
                     f"FROM tr GROUP BY f{i}")
    return f"""
WITH d AS ({base}),
tr AS (SELECT * FROM d WHERE label IS NOT NULL
       AND {sql_md5_number(SPLIT_SEED, 'event_id')} % 100 < 70),
st AS ({' UNION ALL '.join(parts)}),
run AS (SELECT f, feature, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
               sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER (PARTITION BY f) AS s
        FROM st WINDOW w AS (PARTITION BY f ORDER BY CASE WHEN cat THEN s / n ELSE v END, v
                             ROWS UNBOUNDED PRECEDING)),
best AS (SELECT * FROM run WHERE nl < n
         ORDER BY round(sl * sl * 1.0 / nl + (s - sl) * (s - sl) * 1.0 / (n - nl), 6) DESC, f LIMIT 1),
sides AS (SELECT feature, nl AS n, sl * 1.0 / nl AS mean FROM best
          UNION ALL SELECT feature, n - nl, (s - sl) * 1.0 / (n - nl) FROM best)
SELECT feature, CASE WHEN mean = (SELECT min(mean) FROM sides) THEN 'low' ELSE 'high' END AS side,
       CAST(n AS BIGINT) AS n, round(mean, 6) AS mean
FROM sides"""


@register("dt_stump", _stump_sql())
def q_dt_stump(spark, base):
    """The best single split of the train rows: feature, and size and mean of both sides."""
    data, idx = _prepared(spark, base)
    return models.stump(data, idx)


def _tree_ctes(depth: int) -> str:
    """Tree growth unrolled: per level the best split of every node, then rows move.

    A node's rows per value of a feature, ordered by the value, or by the mean label for a
    categorical one, give all splits as prefixes; the best has the least squared error, the
    first feature on ties. A threshold is any number between two neighbouring values. Values of
    a categorical feature that the node has not seen go right.
    """
    base = _index_sql("m.event_id, m.score AS label, " + ", ".join(
        f"i_{c}.idx AS f{i}" for i, c in enumerate(TEXT_COLS)))
    cat = " ".join(f"WHEN {i} THEN (SELECT count(DISTINCT f{i}) FROM d) <= {models.MAX_CATEGORIES}"
                   for i in range(len(TEXT_COLS)))
    value = "CASE {0} " + " ".join(f"WHEN {i} THEN f{i}" for i in range(len(TEXT_COLS))) + " END"
    ctes = [base.removeprefix("WITH ").split("\nSELECT")[0], "d AS (SELECT" + base.split("\nSELECT", 1)[1] + ")",
            f"""k AS (SELECT f, CASE f {cat} END AS cat FROM (SELECT unnest(range({len(TEXT_COLS)})) AS f))""",
            f"""g0 AS (SELECT event_id, label, {", ".join(f"f{i}" for i in range(len(TEXT_COLS)))}, 1 AS node, true AS open,
               {sql_md5_number(SPLIT_SEED, 'event_id')} % 100 < 70 AS train FROM d WHERE label IS NOT NULL)"""]
    for lv in range(depth):
        ctes += [f"""st{lv} AS (SELECT node, k.f, k.cat, {value.format('k.f')} AS v, count(*) AS n, sum(label) AS s
               FROM g{lv}, k WHERE train AND open GROUP BY node, k.f, k.cat, {value.format('k.f')})""",
                 f"""run{lv} AS (SELECT node, f, cat, v, row_number() OVER w AS r, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
               sum(n) OVER p AS n, sum(s) OVER p AS s FROM st{lv}
               WINDOW w AS (PARTITION BY node, f ORDER BY CASE WHEN cat THEN s / n ELSE v END, v
                            ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY node, f))""",
                 f"""best{lv} AS (SELECT * FROM (SELECT node, f, cat, v, r, row_number() OVER (PARTITION BY node ORDER BY
                 round(sl * sl * 1.0 / nl + (s - sl) * (s - sl) * 1.0 / (n - nl), 6) DESC, f) AS place
               FROM run{lv} WHERE nl < n) WHERE place = 1)""",
                 f"""left{lv} AS (SELECT run{lv}.node, run{lv}.v FROM run{lv} JOIN best{lv} b
               ON run{lv}.node = b.node AND run{lv}.f = b.f WHERE b.cat AND run{lv}.r <= b.r)""",
                 f"""g{lv + 1} AS (SELECT g.* EXCLUDE (node, open),
                 CASE WHEN b.node IS NULL THEN g.node WHEN CASE WHEN b.cat THEN l.node IS NOT NULL
                      ELSE {value.format('b.f')} <= b.v END THEN 2 * g.node ELSE 2 * g.node + 1 END AS node,
                 b.node IS NOT NULL AS open
               FROM g{lv} g LEFT JOIN best{lv} b ON g.node = b.node AND g.open
               LEFT JOIN left{lv} l ON l.node = g.node AND b.cat AND l.v = {value.format('b.f')})"""]
    return ",\n".join(ctes)


TREE_DEPTH = 3


@register("dt_leaves", f"""
WITH {_tree_ctes(TREE_DEPTH)}
SELECT count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_test,
       round(avg(label) FILTER (train), 6) AS mean
FROM g{TREE_DEPTH} GROUP BY node""")
def q_dt_leaves(spark, base):
    """Leaves of the tree of depth 3: train and test rows that reach each, mean of the train rows."""
    data, _ = _prepared(spark, base)
    return models.leaf_counts(data, TREE_DEPTH)


@register("dt_depth_rmse", f"""
WITH {_tree_ctes(TREE_DEPTH)},
leaf AS (SELECT node, avg(label) AS prediction FROM g{TREE_DEPTH} WHERE train GROUP BY node)
SELECT 'dt' AS model, count(*) AS n_test, round(sqrt(avg((label - prediction) ** 2)), 6) AS rmse
FROM g{TREE_DEPTH} g JOIN leaf ON g.node = leaf.node WHERE NOT train""")
def q_dt_depth_rmse(spark, base):
    """RMSE on the test rows of the tree of depth 3."""
    data, _ = _prepared(spark, base)
    return models.tree_rmse(data, "dt", maxDepth=TREE_DEPTH).select(
        "model", "n_test", F.round("rmse", 6).alias("rmse"))


@register("dt_rmse")
def q_dt_rmse(spark, base):
    data, _ = _prepared(spark, base)
    return models.tree_rmse(data, "dt")


@register("rf_rmse")
def q_rf_rmse(spark, base):
    data, _ = _prepared(spark, base)
    return models.tree_rmse(data, "rf")


@register("dt_cv")
def q_dt_cv(spark, base):
    data, _ = _prepared(spark, base)
    return models.tuned_rmse(data, "dt")


@register("rf_cv")
def q_rf_cv(spark, base):
    data, _ = _prepared(spark, base)
    return models.tuned_rmse(data, "rf")


@register("tree_summary")
def q_tree_summary(spark, base):
    data, idx = _prepared(spark, base)
    return models.tree_summary(data, idx, "dt")
