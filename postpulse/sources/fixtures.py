"""Bindings of the study's inputs to the landed tables (FIXTURES.md section 3).

Each binding is a lazy projection (or one join) over the parquet tables, so
column pruning and predicate pushdown still reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.functions.timeparts import epoch_seconds_of_ntz
from postpulse.functions.sentiment import Rules
from postpulse.sources.tables import table

# ---- fixed values of the bindings (FIXTURES.md) ------------------------------
COMMENT_EPOCH_BASE = 1601510400      # 2020-10-01 00:00 UTC
COMMENT_EPOCH_STEP = 3607            # seconds between consecutive doc ids
DELETED_AUTHOR = "[deleted]"
# ------------------------------------------------------------------------------


def posts(spark: SparkSession, base: str, groups: DataFrame | None = None) -> DataFrame:
    """Raw posts as text: author, link, num_comments, subreddit; with ``groups``, only the
    posts of those subreddits, filtered before the join.

    lineitem joined with part; every tenth supplier is a deleted author. Links
    (orders) are shared by several communities (brands).
    """
    li = table(spark, base, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    pt = table(spark, base, "part").select("p_partkey", "p_brand")
    if groups is not None:
        pt = pt.join(groups.select(F.col("subreddit").alias("p_brand")), "p_brand", "left_semi")
    j = li.join(pt, li.l_partkey == pt.p_partkey)
    return j.select(
        F.when(F.col("l_suppkey") % 10 == 0, F.lit(DELETED_AUTHOR))
         .otherwise(F.col("l_suppkey").cast("string")).alias("author"),
        F.col("l_orderkey").cast("string").alias("link"),
        F.col("l_quantity").cast("int").cast("string").alias("num_comments"),
        F.col("p_brand").alias("subreddit"),
    )


def comments(spark: SparkSession, base: str) -> DataFrame:
    """Comments: id, body, subreddit, created_utc (epoch seconds)."""
    d = table(spark, base, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("body"),
        F.col("source").alias("subreddit"),
        (F.lit(COMMENT_EPOCH_BASE) + F.col("doc_id") * COMMENT_EPOCH_STEP).cast("long").alias("created_utc"),
    )


def raw_comments(spark: SparkSession, base: str) -> list[DataFrame]:
    """Comments as raw text rows, one frame per width: 22 fields, and bad ones of 21 and 23.

    Every 50th epoch and every 40th subreddit is blank.
    """
    i = F.col("id")
    row = comments(spark, base).join(
        table(spark, base, "documents").select(F.col("doc_id").alias("id"), "n_chars"), "id")
    values = {0: F.when(i % 50 == 0, "").otherwise(F.col("created_utc").cast("string")),
              9: F.when(i % 40 == 0, "").otherwise(F.col("subreddit")),
              11: (i % 2).cast("string"), 13: F.when(i % 4 == 0, "True").otherwise("False"),
              15: i.cast("string"), 17: F.col("body"), 19: (i % 3).cast("string"),
              20: (F.col("n_chars") % 100).cast("string")}
    width = F.when(i % 17 == 3, 21).when(i % 19 == 5, 23).otherwise(22)
    cells = [values.get(k, F.lit(f"x{k}")).alias(f"_c{k}") for k in range(23)]
    return [row.where(width == n).select(*cells[:n]) for n in (22, 21, 23)]


def raw_posts(spark: SparkSession, base: str) -> list[DataFrame]:
    """Posts as raw text rows, one frame per width: 95 fields, and bad ones of 94 and 96.

    Posts with 50 comments lose a field, those with 49 gain one; those with 48 have no author.
    """
    n = F.col("num_comments")
    values = {2: F.when(n == "48", "").otherwise(F.col("author")), 15: F.col("link"), 32: n,
              47: F.col("subreddit")}
    cells = [values.get(k, F.lit(f"x{k}")).alias(f"_c{k}") for k in range(96)]
    width = F.when(n == "50", 94).when(n == "49", 96).otherwise(95)
    return [posts(spark, base).where(width == w).select(*cells[:w]) for w in (95, 94, 96)]


def timed_rows(spark: SparkSession, base: str) -> DataFrame:
    """Events with epoch seconds; ``ts`` is kept so time filters can be pushed down."""
    e = table(spark, base, "events")
    return e.select(
        "event_id", "ts",
        epoch_seconds_of_ntz(F.col("ts")).alias("created_utc"),
        "user_id",
        F.col("event_type").alias("subreddit"),
        "value", "props",
    )


def model_rows(spark: SparkSession, base: str) -> DataFrame:
    """Model table: text features + integer score, keyed by event_id (user_id kept)."""
    e = table(spark, base, "events")
    ts = F.col("ts")
    return e.select(
        "event_id", "user_id",
        F.col("event_type").alias("subreddit"),
        F.hour(ts).cast("string").alias("HoD"),
        (F.weekday(F.to_date(ts)) + 1).cast("string").alias("DoW"),
        F.dayofmonth(ts).cast("string").alias("DoM"),
        F.month(ts).cast("string").alias("month"),
        F.year(ts).cast("string").alias("year"),
        F.col("value").cast("int").alias("score"),
    )


BAGGING_ATTRS = ["o_orderstatus", "o_orderpriority", "o_month", "o_day"]
BAGGING_TARGET = "o_totalprice"


def bagging_rows(spark: SparkSession, base: str) -> DataFrame:
    """Rows for the bagged trees: four text attributes and a numeric target."""
    o = table(spark, base, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        "o_orderstatus", "o_orderpriority",
        F.month("o_orderdate").cast("string").alias("o_month"),
        F.dayofmonth("o_orderdate").cast("string").alias("o_day"),
        F.col("o_custkey").cast("double").alias("o_custkey"),
        "o_totalprice",
    )


def blank_orders(spark: SparkSession, base: str) -> DataFrame:
    """Orders with blanks: priority '5-LOW' is missing (null), status 'P' is ''."""
    o = table(spark, base, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice",
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"),
    )


#: Rule words that occur in the invented texts, so that every rule takes part in the keys' results.
RULES = Rules(negations=("not", "never", "nicht", "pas", "on"),
              boosters={"very": 1, "that": 1, "sur": 1, "so": 1, "is": -1, "die": -1},
              contrasts=("but", "with", "dans", "mit"),
              phrases={"of the": 0.4, "and the": -0.35, "in der": 0.9, "de la": -0.8, "to of in": 1.1,
                       "!": 0.0, ".\n": -0.05})
