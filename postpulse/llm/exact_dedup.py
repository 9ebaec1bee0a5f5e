"""Exact deduplication as a stateful stream.

A stream of (digest, identifier, content locator) rows meets keyed state that lives
on disk (RocksDB) and never expires: per digest the smallest identifier with its
locator, and the number of rows seen. Each micro-batch writes the keys it changed;
state only ever lowers the identifier and raises the count, so the newest value of a
key is the minimum and maximum over its changes and replayed batches are harmless.
Rows that hit a digest seen before are then compared byte for byte with the text
their key keeps; texts that differ in spite of equal digests are grouped by the text
itself.

Only digests, identifiers and locators enter the state; texts move for hits alone.
A hot digest is pre-aggregated before the shuffle into the state, and the byte check
is an equi-join without aggregation above it, which adaptive execution splits.

Defined results: null text counts as empty; a null id sorts after every id; rows that
repeat id and text are told apart by locator, so exactly one of them stays; empty
input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postpulse.llm.common import TIDY, landed, normal_text, session_settings
from postpulse.session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = {"spark.sql.streaming.stateStore.providerClass": ROCKS,
         # many small stores: no space set aside, small change logs instead of whole snapshots
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
         # all stores of an executor share this much native memory; what exceeds it is on disk
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
         "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
LOCATOR = "struct<no_id:boolean,doc_id:bigint,file:string,row:bigint>"


def sha256_hex(text):
    return F.sha2(text.cast("binary"), 256)


def keyed(df: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """(digest, locator) of a file-backed frame, batch or stream.

    The locator orders rows: by identifier, then by file and row in it.
    """
    at = F.struct(F.col(id_col).isNull().alias("no_id"),
                  F.col(id_col).cast("long").alias("doc_id"),
                  F.col("_metadata.file_path").alias("file"),
                  F.col("_metadata.row_index").alias("row"))
    return df.select(digest(normal_text(F.col(text_col))).alias("digest"), at.alias("at"))


def as_glob(path: str) -> str:
    """A pattern for just this path: a stream takes a single file only through a pattern."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run_state(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a (digest, at) stream to the end of its input; (digest, keep, group_size)."""
    root = scratch_path(spark, "dedup-state")
    changes = f"{root}/changes"
    schema = T.StructType.fromDDL(f"digest string, keep {LOCATOR}, group_size bigint")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    state = stream.groupBy("digest").agg(F.min("at").alias("keep"),
                                         F.count(F.lit(1)).alias("group_size"))
    with session_settings(spark, STATE | {TIDY: "true"}):
        query = (state.writeStream.outputMode("update").foreachBatch(write)
                 .option("checkpointLocation", f"{root}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    # an empty input runs no batch; the union gives the reader a schema and a file either way
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{changes}/batch=-1")
    changed = spark.read.schema(schema).parquet(changes)
    # landed, so that the joins with it have no aggregate of their own and can be split
    return landed(spark, changed.groupBy("digest").agg(
        F.min("keep").alias("keep"), F.max("group_size").alias("group_size")), "dedup-state")


def exact_groups(spark: SparkSession, path: str, id_col: str = "doc_id",
                 text_col: str = "text", digest=sha256_hex,
                 files_per_batch: int = 1000) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept,
    text_sha256, keep_file, keep_row, file, row.

    ``digest`` maps the normalised text column to a string column; any digest gives the
    same result, since hits are verified on full bytes.
    """
    table = spark.read.parquet(path)
    stream = (spark.readStream.schema(table.schema)
              .option("maxFilesPerTrigger", files_per_batch)
              .parquet(as_glob(path)))
    state = run_state(spark, keyed(stream, id_col, text_col, digest))

    rows = table.select(
        F.col(id_col).cast("long").alias("doc_id"), normal_text(F.col(text_col)).alias("norm"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = rows.select(
        "*", digest(F.col("norm")).alias("digest"), sha256_hex(F.col("norm")).alias("text_sha256"))
    narrow = rows.select("doc_id", "file", "row", "digest", "text_sha256")
    alone = narrow.join(state.where("group_size = 1"), "digest")

    # byte check: each hit against the text at its key's locator
    hits = landed(spark, rows.join(state.where("group_size > 1"), "digest"), "dedup-hits")
    kept_text = hits.where((F.col("file") == F.col("keep.file"))
                           & (F.col("row") == F.col("keep.row"))).select(
        F.col("digest"), F.col("norm").alias("kept_norm"))
    checked = hits.join(kept_text, "digest").withColumn(
        "same", F.col("norm").cast("binary") == F.col("kept_norm").cast("binary"))
    # only rows whose bytes differ carry their text on
    checked = landed(spark, checked.withColumn("norm", F.when(~F.col("same"), F.col("norm")))
                     .drop("kept_norm"), "dedup-checked")
    odd = checked.where("not same")
    n_odd = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("odd_rows"))
    good = (checked.where("same").join(n_odd, "digest", "left")
            .withColumn("group_size",
                        F.col("group_size") - F.coalesce(F.col("odd_rows"), F.lit(0))))
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    regrouped = odd.groupBy("norm").agg(F.min(at).alias("keep"),
                                        F.count(F.lit(1)).alias("group_size"))
    split = odd.drop("keep", "group_size").join(regrouped, "norm")
    cols = ["doc_id", "file", "row", "text_sha256", "keep", "group_size"]
    out = alone.select(cols).unionByName(good.select(cols)).unionByName(split.select(cols))
    return out.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"),
        "text_sha256", F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"),
        "file", "row")


def drop_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A frame has no files of its own, so one that is not ``landed`` yet is written first.
    """
    if not hasattr(docs, "landed_at"):
        docs = landed(spark, docs, "dedup-input")
    stays = exact_groups(spark, docs.landed_at, id_col, text_col).where("kept").select("file", "row")
    # the row travels as a struct, so none of its columns can clash with ours
    keyed = docs.select(F.struct(*docs.columns).alias("whole"),
                        F.col("_metadata.file_path").alias("this_file"),
                        F.col("_metadata.row_index").alias("this_row"))
    return keyed.join(stays, (F.col("this_file") == F.col("file"))
                      & (F.col("this_row") == F.col("row")), "left_semi").select("whole.*")
