"""A training corpus from ``documents`` in five stages.

toxicity -> exact dedup -> n-gram Jaccard join -> suffix-array dedup -> best-fit packing.
Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm import exact_dedup, ngram_join, packing, queries, suffix_dedup, toxicity
from postpulse.llm.common import id_and_text, landed, ship_package
from postpulse.sources.tables import table

CAPACITY = 2048
#: A passage of just over 50 words repeats as a whole; the shortest words make it about this long.
REPEAT_BYTES, REPEAT_GRAM = 240, 64


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the chain on the labelled rows, drop what it flags."""
    ship_package(spark)
    chain = toxicity.fit_chain(spark, id_and_text(docs), queries.label_rows(spark, sf_dir),
                               queries.CATEGORIES)
    return toxicity.reject(docs, chain)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_copies(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity 0.8 the smallest doc_id stays."""
    ship_package(spark)
    return ngram_join.keep_one(spark, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut REPEAT_BYTES-byte strings that start twice; every document stays, n_chars follows."""
    ship_package(spark)
    return suffix_dedup.remove_repeats(spark, docs, length=REPEAT_BYTES, gram=REPEAT_GRAM).withColumn(
        "n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of CAPACITY words."""
    ship_package(spark)
    return packing.pack(packing.items(docs, CAPACITY), CAPACITY)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies),
          ("ngram_jaccard_join", drop_near_copies), ("suffix_array_dedup", cut_repeats),
          ("best_fit_packing", pack)]

#: A fitted classifier decides the first stage; tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
