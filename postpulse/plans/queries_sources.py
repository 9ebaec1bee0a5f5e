"""Source/sink and pull keys.

time_slice, distinct_groups, union_slices, profile_counts, peek_rows,
csv_roundtrip, tsv_roundtrip, csv_arity_filter, line_split.

Round-trip keys write their input below the session's shared folder
(``spark.checkpoint.dir``) in a fresh location, then return the lazy read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postpulse.catalog import register
from postpulse.functions.timeparts import epoch_of
from postpulse.operators import slices
from postpulse.sources import csvio, csvsplit
from postpulse.sources import fixtures as fx
from postpulse.sources.tables import table
from postpulse.session import scratch_path

SLICE_GROUPS = ["click", "view"]
SLICE_AFTER = epoch_of(2024, 1, 8)
SLICE_BEFORE = epoch_of(2024, 1, 22)
SLICE_COLS = ["event_id", "created_utc", "user_id", "subreddit", "value"]

EPOCH_SQL = "CAST(floor(epoch(ts)) AS BIGINT)"
SLICE_SQL = f"""
SELECT event_id, {EPOCH_SQL} AS created_utc, user_id, event_type AS subreddit, value
FROM events
WHERE event_type IN ('click', 'view')
  AND ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-22 00:00:00'"""


def _slice(spark, base):
    rows = fx.timed_rows(spark, base)
    return slices.time_slice(rows, SLICE_GROUPS, SLICE_AFTER, SLICE_BEFORE).select(*SLICE_COLS)


@register("time_slice", SLICE_SQL)
def q_time_slice(spark, base):
    return _slice(spark, base)


@register("distinct_groups", """
SELECT DISTINCT p.p_brand AS subreddit
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""")
def q_distinct_groups(spark, base):
    return slices.distinct_groups(fx.posts(spark, base))


@register("union_slices", f"""
SELECT event_id, {EPOCH_SQL} AS created_utc, event_type AS subreddit, value,
       CAST(NULL AS BIGINT) AS user_id
FROM events WHERE event_type = 'click'
  AND ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00'
UNION ALL
SELECT event_id, {EPOCH_SQL} AS created_utc, event_type AS subreddit, CAST(NULL AS DOUBLE) AS value,
       user_id
FROM events WHERE event_type = 'view'
  AND ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-02-01 00:00:00'""")
def q_union_slices(spark, base):
    rows = fx.timed_rows(spark, base)
    a = slices.time_slice(rows, ["click"], epoch_of(2024, 1, 1), epoch_of(2024, 1, 15)) \
        .select("event_id", "created_utc", "subreddit", "value")
    b = slices.time_slice(rows, ["view"], epoch_of(2024, 1, 8), epoch_of(2024, 2, 1)) \
        .select("event_id", "created_utc", "subreddit", "user_id")
    return slices.union_slices([a, b])


@register("profile_counts", f"""
SELECT subreddit, count(*) AS n_rows, 5 AS n_cols FROM ({SLICE_SQL}) GROUP BY subreddit""")
def q_profile_counts(spark, base):
    return slices.profile_counts(_slice(spark, base))


@register("peek_rows", f"""
SELECT event_id, created_utc, user_id, subreddit, value FROM (
  SELECT event_id, {EPOCH_SQL} AS created_utc, user_id, event_type AS subreddit, value,
         row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS n
  FROM events)
WHERE rn > ((n - 1) // 10) * 10""")
def q_peek_rows(spark, base):
    rows = fx.timed_rows(spark, base).select(*SLICE_COLS)
    return slices.last_chunk(rows, 10, "event_id")


DOC_COLS = ["doc_id", "lang", "source", "n_chars", "text"]
DOC_SCHEMA = "doc_id long, lang string, source string, n_chars long, text string"


@register("csv_roundtrip", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def q_csv_roundtrip(spark, base):
    """Whole documents (commas, quotes, newlines inside fields) -> CSV with header -> read back."""
    path = scratch_path(spark, "csv-roundtrip")
    # a multi-line file is one task: bound the files
    csvio.write_delimited(table(spark, base, "documents"), path, columns=DOC_COLS,
                          max_records_per_file=20_000)
    return csvio.read_delimited(spark, path, DOC_SCHEMA, header=True, multiline=True)


@register("csv_split_roundtrip", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def q_csv_split_roundtrip(spark, base):
    """The same files read by byte ranges: a large file with newlines in quotes is many tasks."""
    path = scratch_path(spark, "csv-split")
    csvio.write_delimited(table(spark, base, "documents"), path, columns=DOC_COLS)
    return csvsplit.read_split(spark, path, DOC_SCHEMA)


ORDER_SCHEMA = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"


@register("tsv_roundtrip", """
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def q_tsv_roundtrip(spark, base):
    """Mapper prints tab-separated tuples; reducer strips, splits on tab, prints commas."""
    o = table(spark, base, "orders")
    tsv = scratch_path(spark, "tsv")
    o.select(F.concat_ws("\t", "o_orderkey", "o_orderstatus", "o_totalprice",
                         "o_orderpriority").alias("value")).write.text(tsv)
    fields = csvio.split_line("value", sep="\t", delete=None, strip=True)
    csv = scratch_path(spark, "csv")
    (csvio.read_lines(spark, tsv)
        .select(F.array_join(fields, ",").alias("value"))
        .write.text(csv))
    return csvio.read_delimited(spark, csv, ORDER_SCHEMA, header=False)


ARITY_NAMES = ["event_id", "user_id", "subreddit", "value"]


@register("csv_arity_filter", """
SELECT event_id, user_id, event_type AS subreddit, value FROM events
WHERE event_type <> 'error' AND value <= 300""")
def q_csv_arity_filter(spark, base):
    """Rows of 4 fields are kept; error rows carry a 5th field, large values lose one."""
    kept = csvio.read_exact_width(spark, _mixed_widths(spark, base), 4, ARITY_NAMES, header=False)
    return kept.select(F.col("event_id").cast("long").alias("event_id"),
                       F.col("user_id").cast("long").alias("user_id"),
                       "subreddit", F.col("value").cast("double").alias("value"))


@register("csv_arity_counts", """
SELECT CASE WHEN event_type <> 'error' AND value <= 300 THEN 'kept' ELSE 'rejected' END AS kind,
       count(*) AS n_rows
FROM events GROUP BY 1""")
def q_csv_arity_counts(spark, base):
    """Rows of the right and of a wrong width, each counted by a read that needs no column."""
    kept, rejects = csvio.read_kept_and_rejects(spark, _mixed_widths(spark, base), 4, ARITY_NAMES,
                                                header=False)
    return kept.select(F.lit("kept").alias("kind")).unionByName(
        rejects.select(F.lit("rejected").alias("kind"))).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_rows"))


def _mixed_widths(spark, base) -> str:
    """Events as text lines of three, four and five fields; the path."""
    e = table(spark, base, "events")
    line = (F.when(F.col("event_type") == "error",
                   F.concat_ws(",", "event_id", "user_id", "event_type", "value",
                               F.get_json_object("props", "$.k")))
             .when(F.col("value") > 300, F.concat_ws(",", "event_id", "event_type", "value"))
             .otherwise(F.concat_ws(",", "event_id", "user_id", "event_type", "value")))
    path = scratch_path(spark, "arity")
    e.select(line.alias("value")).write.text(path)
    return path


@register("line_split", """
SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders""")
def q_line_split(spark, base):
    """Raw lines with stray tabs: delete tabs, split on commas, pick fields."""
    o = table(spark, base, "orders")
    path = scratch_path(spark, "lines")
    o.select(F.concat("o_orderkey", F.lit("\t,"), "o_orderstatus", F.lit(","),
                      "o_orderpriority", F.lit("\t"), F.lit(","),
                      "o_totalprice").alias("value")).write.text(path)
    parts = csvio.split_line("value", sep=",", delete="\t")
    return csvio.read_lines(spark, path).select(
        parts.getItem(0).cast("long").alias("o_orderkey"),
        parts.getItem(1).alias("o_orderstatus"),
        parts.getItem(2).alias("o_orderpriority"),
        parts.getItem(3).cast("double").alias("o_totalprice"))
