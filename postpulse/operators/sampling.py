"""Shuffles, splits, shards and samples (survey R2-R7).

All randomness comes from md5 of (seed, id[, replicate]) so results do not
depend on partitioning, cluster size or engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postpulse.functions.hashing import md5_number, md5_words, replicate_key
from postpulse.session import scratch_path, stored

HASH_RANGE = 1 << 32  # md5_number is uniform on [0, 2^32)

SPLIT_SEED = 42
SHARD_SEED = 43
SAMPLE_SEED = 44


def shuffle_rows(df: DataFrame, id_col: str, seed=SPLIT_SEED) -> DataFrame:
    """All rows in a repeatable random order (R2).

    A global sort on a hash key: range-partitioned by sampled bounds, so no
    partition receives more than its share whatever the data.
    """
    return (df.withColumn("shuffle_key", md5_number(seed, F.col(id_col)))
              .orderBy("shuffle_key", id_col))


def sort_within_key(df: DataFrame, key: str, tiebreak: str, partitions: int | None = None) -> DataFrame:
    """Rows grouped and ordered by key, as between a map and a reduce.

    Range partitioning on (key, tiebreak) keeps equal keys adjacent while a
    key holding a third of all rows is cut across several partitions instead
    of landing on one task.
    """
    cols = [key, tiebreak]
    out = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return out.sortWithinPartitions(*cols)


def with_position(df: DataFrame) -> DataFrame:
    """Adds ``position``: the place of each row in the frame's own order, from 0.

    The frame is written once with partition and row numbers; a partition's offset is the
    sum over the partitions before it (one small row per partition).
    """
    spark = df.sparkSession
    path = scratch_path(spark, "positions")
    # Spark numbers rows as partition * 2**33 + row
    df.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = (spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
              .withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_part").withColumn(
        "position", F.col("_row") + F.col("_offset")).drop("_at", "_part", "_row", "_offset")


def split_label(id_col: Column, train_percent: int = 70, seed=SPLIT_SEED) -> Column:
    """'train' when the md5 bucket (mod 100) is below ``train_percent``, else 'test' (R4)."""
    return F.when(md5_number(seed, id_col) % 100 < train_percent, F.lit("train")).otherwise(F.lit("test"))


def hash_split(df: DataFrame, id_col: str, train_percent: int = 70, seed=SPLIT_SEED):
    """(train, test) frames; the same id always lands on the same side."""
    lab = split_label(F.col(id_col), train_percent, seed)
    return df.filter(lab == "train"), df.filter(lab == "test")


def shard_of(id_col: Column, max_split: int = 10, seed=SHARD_SEED) -> Column:
    """Shard 0..max_split inclusive, i.e. max_split + 1 shards."""
    return (md5_number(seed, id_col) % (max_split + 1)).cast("int")


def sample_cuts(keys: DataFrame, number: int, size: int, margin: float) -> DataFrame:
    """(shard, rep, u, id, same, allowed): where the ``size`` smallest keys of a sample end.

    ``keys`` has _shard, _n (rows of the shard), _id, _h1, _h2. Keys are uniform, so the cut lies
    near size / n of their range: rows below a band around it are counted, those in the band are
    counted by key and id, and running totals over the band give the last row taken. ``same`` rows
    have that key and id, of which ``allowed`` belong to the sample. A band that misses its cut is
    widened; the widest one is the whole range.
    """
    spark = keys.sparkSession
    reps = F.sequence(F.lit(0), F.lit(number - 1))
    shards = keys.select("_shard").distinct()
    open_ = stored(spark, shards.select("_shard", F.explode(reps).alias("rep")), "sample-open")
    everything, parts = True, []
    while True:
        band = margin * math.sqrt(size) + 16
        edge = lambda k: F.lit(k * HASH_RANGE) / F.col("_n")
        near = keys.withColumn("rep", F.explode(reps)).withColumn(
            "_u", replicate_key(F.col("_h1"), F.col("_h2"), F.col("rep"))).where(
            F.col("_u") < edge(size + band))
        if not everything:
            near = _null_safe(near, open_, ["_shard", "rep"], "left_semi")
        inside = F.when(F.col("_u") >= edge(size - band), F.struct("_u", "_id"))
        counts = stored(spark, near.groupBy("_shard", "rep", inside.alias("at")).agg(
            F.count(F.lit(1)).alias("same")), "sample-band")
        order = Window.partitionBy("_shard", "rep").orderBy(F.col("at").asc_nulls_first())
        counts = counts.withColumn("upto", F.sum("same").over(order))
        before = F.col("upto") - F.col("same")
        cuts = stored(spark, counts.where(
            F.col("at").isNotNull() & (F.col("upto") >= size) & (before < size)).select(
            "_shard", "rep", F.col("at._u").alias("u"), F.col("at._id").alias("id"), "same",
            (F.lit(size) - before).alias("allowed")), "sample-cuts")
        parts.append(cuts)
        open_ = stored(spark, _null_safe(open_, cuts, ["_shard", "rep"], "left_anti"), "sample-open")
        if open_.isEmpty():
            break
        margin, everything = max(8.0, 8 * abs(margin)), False
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shard_sample(df: DataFrame, id_col: str, shard_col: str, number: int, size: int,
                 seed=SAMPLE_SEED, margin: float = 6.0) -> DataFrame:
    """Per shard, ``number`` samples of ``size`` rows without replacement.

    A shard with fewer than ``size`` rows gives one sample (rep 0) holding all
    its rows. Sample ``rep`` of a shard is the ``size`` rows with the smallest
    key (h1 + rep * h2) mod 2^32, where h1, h2 are two words of md5(seed|id)
    (ties by id): one md5 per row, one multiply-add per (row, sample).

    The exact end of every sample is found first (``sample_cuts``: counts, no sample is
    gathered or sorted). With the cuts of its shard, one array of ``number`` entries, a row
    tells by itself which samples it is in: rows are read, not shuffled, and what is built on
    the result aggregates in the same stage.
    """
    spark = df.sparkSession
    cols = [*df.columns, "rep"]
    sizes = stored(spark, df.groupBy(F.col(shard_col).alias("_shard")).agg(
        F.count(F.lit(1)).alias("_n")), "shard-sizes")
    entry = "struct<rep:int,u:bigint,id:{},same:bigint,allowed:bigint>"
    id_type = df.schema[id_col].dataType.simpleString()
    whole = F.array(F.struct(F.lit(0), F.lit(HASH_RANGE), F.lit(None), F.lit(0), F.lit(0))).cast(
        f"array<{entry.format(id_type)}>")
    h1, h2 = md5_words(seed, F.col(id_col))
    info, repeated = sizes.withColumn("_cuts", whole), False
    if not sizes.where(F.col("_n") >= size).isEmpty():
        big = sizes.where(F.col("_n") >= size).withColumnRenamed("_shard", "_s")
        keys = df.select(F.col(shard_col).alias("_shard"), F.col(id_col).alias("_id"),
                         h1.alias("_h1"), h2.alias("_h2")).where(F.col("_id").isNotNull())
        keys = keys.join(big, F.col("_shard").eqNullSafe(F.col("_s"))).drop("_s")
        cuts = sample_cuts(keys, number, size, margin)
        repeated = not cuts.where("same > allowed").isEmpty()
        by_shard = cuts.groupBy(F.col("_shard").alias("_s")).agg(F.sort_array(F.collect_list(
            F.struct("rep", "u", "id", "same", "allowed"))).alias("_found"))
        info = sizes.join(by_shard, F.col("_shard").eqNullSafe(F.col("_s")), "left").select(
            "_shard", "_n", F.when(F.col("_n") < size, whole).otherwise(F.col("_found")).alias("_cuts"))
    info = stored(spark, info, "shard-cuts")
    drawn = (df.withColumn("_h1", h1).withColumn("_h2", h2)
             .join(info, F.col(shard_col).eqNullSafe(F.col("_shard")))
             .withColumn("_c", F.explode("_cuts")).withColumn("rep", F.col("_c.rep"))
             .withColumn("_u", replicate_key(F.col("_h1"), F.col("_h2"), F.col("rep"))))
    at_cut = (F.col("_u") == F.col("_c.u")) & (F.col(id_col) == F.col("_c.id"))
    below = (F.col("_n") < size) | (F.col("_u") < F.col("_c.u")) | (
        (F.col("_u") == F.col("_c.u")) & (F.col(id_col) < F.col("_c.id")))
    fits = F.col("_c.same") <= F.col("_c.allowed")
    out = drawn.where(below | (at_cut & fits)).select(*cols)
    if not repeated:
        return out
    # rows that repeat the last id: as many of them as the sample still takes
    w = Window.partitionBy(shard_col, "rep").orderBy("_u")
    last = drawn.where(at_cut & ~fits & (F.col("_n") >= size)).withColumn(
        "_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("_c.allowed"))
    return out.unionByName(last.select(*cols))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join on keys that may be null."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    return left.join(r, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys], how)
