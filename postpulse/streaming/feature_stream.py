"""Structured Streaming form of the line-at-a-time mapper jobs.

The original feature and posts jobs were streaming mappers: each input line
is turned into one output line with no state. The Spark counterpart is a
file-source stream through the same stateless projections into a file sink
with a checkpoint location, so new landed files are processed exactly once
and a restarted query resumes where it stopped.

``trigger="available_now"`` processes what has landed and stops (batch-like
catch-up); ``trigger="<n> seconds"`` keeps running with that interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postpulse.functions.sentiment import Rules
from postpulse.operators.engagement import clean_posts
from postpulse.operators.features import feature_table
from postpulse.sources.fixtures import COMMENT_EPOCH_BASE, COMMENT_EPOCH_STEP


def _start(df: DataFrame, sink: str, checkpoint: str, trigger: str, fmt: str = "parquet") -> StreamingQuery:
    w = (df.writeStream.format(fmt).outputMode("append")
         .option("path", sink).option("checkpointLocation", checkpoint))
    if trigger == "available_now":
        w = w.trigger(availableNow=True)
    else:
        w = w.trigger(processingTime=trigger)
    return w.start()


def comments_from_documents(stream: DataFrame) -> DataFrame:
    """The comments binding (FIXTURES.md) applied to a stream of document rows."""
    return stream.select(
        F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("source").alias("subreddit"),
        (F.lit(COMMENT_EPOCH_BASE) + F.col("doc_id") * COMMENT_EPOCH_STEP).cast("long").alias("created_utc"))


def start_feature_stream(spark: SparkSession, source_glob: str, schema, sink: str, checkpoint: str,
                         lexicon=None, trigger: str = "available_now",
                         max_files_per_trigger: int | None = None,
                         rules: Rules | None = None) -> StreamingQuery:
    """Landed document files -> comment features (sentiment class, time parts) -> parquet."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    comments = comments_from_documents(r.parquet(source_glob))
    return _start(feature_table(comments, lexicon, rules=rules), sink, checkpoint, trigger)


def start_posts_stream(spark: SparkSession, source_glob: str, sink: str, checkpoint: str,
                       trigger: str = "available_now", fmt: str = "csv") -> StreamingQuery:
    """Landed raw post files (author, link, num_comments, subreddit as text) -> cleaned rows.

    Blank -> '0', deleted authors dropped, counts parsed: the posts mapper as a
    stream. Aggregates over all rows (engagement) run as batch jobs on the sink.
    """
    schema = "author string, link string, num_comments string, subreddit string"
    src = spark.readStream.schema(schema).option("header", True).format(fmt).load(source_glob)
    return _start(clean_posts(src), sink, checkpoint, trigger)
