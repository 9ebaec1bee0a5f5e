"""Sampling keys: shuffle_rows, sort_within_key, hash_split, shard_assign, shard_sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from postpulse.catalog import register
from postpulse.functions.hashing import sql_md5_number, sql_md5_words
from postpulse.operators import sampling as smp
from postpulse.sources.tables import table

_H1, _H2 = sql_md5_words(smp.SAMPLE_SEED, "o_orderkey")
SAMPLE_NUMBER = 4
SAMPLE_SIZE = 1360
MAX_SPLIT = 10


SHUFFLE_SQL = f"""SELECT o_orderkey, o_custkey, o_totalprice,
       {sql_md5_number(smp.SPLIT_SEED, 'o_orderkey')} AS shuffle_key FROM orders"""


def _orders(spark, base, *cols):
    return table(spark, base, "orders").select(*cols)


POSITIONS_SQL = f"""
SELECT *, row_number() OVER (ORDER BY shuffle_key, o_orderkey) - 1 AS position FROM ({SHUFFLE_SQL}) s"""
RANKS_SQL = """
SELECT o_orderstatus, o_orderkey, o_totalprice,
       row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS rank
FROM orders"""


@register("shuffle_rows", POSITIONS_SQL)
def q_shuffle_rows(spark, base):
    """The shuffled rows with the place each one came out at."""
    o = _orders(spark, base, "o_orderkey", "o_custkey", "o_totalprice")
    return smp.with_position(smp.shuffle_rows(o, "o_orderkey"))


@register("sort_within_key", RANKS_SQL)
def q_sort_within_key(spark, base):
    """Rows as they come out of the sort: each one's distance from the first of its key, which
    is its rank only if equal keys are adjacent and in order."""
    o = _orders(spark, base, "o_orderstatus", "o_orderkey", "o_totalprice")
    placed = smp.with_position(smp.sort_within_key(o, "o_orderstatus", "o_orderkey"))
    first = placed.groupBy(F.col("o_orderstatus").alias("status")).agg(F.min("position").alias("first"))
    return placed.join(first, F.col("o_orderstatus").eqNullSafe(F.col("status"))).select(
        "o_orderstatus", "o_orderkey", "o_totalprice", (F.col("position") - F.col("first")).alias("rank"))


register("shuffle_positions", POSITIONS_SQL)(q_shuffle_rows)
register("sort_positions", RANKS_SQL)(q_sort_within_key)


@register("hash_split", f"""
SELECT o_orderkey,
       CASE WHEN {sql_md5_number(smp.SPLIT_SEED, 'o_orderkey')} % 100 < 70 THEN 'train' ELSE 'test' END AS split
FROM orders""")
def q_hash_split(spark, base):
    o = table(spark, base, "orders").select("o_orderkey")
    return o.select("o_orderkey", smp.split_label(F.col("o_orderkey")).alias("split"))


@register("shard_assign", f"""
SELECT o_orderkey, CAST({sql_md5_number(smp.SHARD_SEED, 'o_orderkey')} % {MAX_SPLIT + 1} AS INTEGER) AS shard
FROM orders""")
def q_shard_assign(spark, base):
    o = table(spark, base, "orders").select("o_orderkey")
    return o.select("o_orderkey", smp.shard_of(F.col("o_orderkey"), MAX_SPLIT).alias("shard"))


@register("shard_sample", f"""
WITH b AS (
  SELECT o_orderkey, CAST({sql_md5_number(smp.SHARD_SEED, 'o_orderkey')} % {MAX_SPLIT + 1} AS INTEGER) AS shard
  FROM orders),
c AS (SELECT shard, count(*) AS n FROM b GROUP BY shard),
r AS (
  SELECT b.o_orderkey, b.shard,
         unnest(CASE WHEN c.n >= {SAMPLE_SIZE} THEN range(0, {SAMPLE_NUMBER}) ELSE [0] END) AS rep
  FROM b JOIN c ON b.shard = c.shard)
SELECT o_orderkey, shard, CAST(rep AS INTEGER) AS rep FROM (
  SELECT *, row_number() OVER (PARTITION BY shard, rep
                               ORDER BY ({_H1} + rep * {_H2}) % 4294967296, o_orderkey) AS rn
  FROM r)
WHERE rn <= {SAMPLE_SIZE}""")
def q_shard_sample(spark, base):
    o = table(spark, base, "orders").select("o_orderkey")
    sharded = o.withColumn("shard", smp.shard_of(F.col("o_orderkey"), MAX_SPLIT))
    return smp.shard_sample(sharded, "o_orderkey", "shard", SAMPLE_NUMBER, SAMPLE_SIZE)
