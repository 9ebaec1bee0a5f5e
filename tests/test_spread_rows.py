"""Costly work per row is done once, and by all tasks whatever the files' layout."""

import pytest
from pyspark.sql import functions as F

from postpulse import catalog
from postpulse.functions.sentiment import DEFAULT_LEXICON, Rules, rule_scores

catalog.queries()       # loads every module of queries
from postpulse.plans import queries_features as qf  # noqa: E402


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("spread"))
    words = F.array(*[F.lit(w) for w in ("the", "and", "cat", "not", "of", "VERY", "la", "but")])
    spark.range(200).coalesce(1).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"),
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"),
        (F.col("id") % 90).alias("n_chars"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.element_at(
            words, (F.pmod(F.xxhash64("id", i), F.lit(8)) + 1).cast("int"))), " ").alias("text")
    ).write.parquet(f"{to}/documents.parquet")
    return to


def test_comment_bodies_are_scored_once(spark, base):
    data, idx = qf._comment_data(spark, base)
    assert len(idx) == 10 and data.count() > 100
    assert "regexp_extract_all" not in _plan(data)      # scored rows are read back


def test_rows_of_a_multiline_file_are_scored_by_all_tasks(spark, base):
    frame = qf.q_feature_job(spark, base)
    assert "RoundRobinPartitioning" in _plan(frame)
    assert frame.count() == sum(k % 17 != 3 and k % 19 != 5 for k in range(200))


def test_a_lexicon_table_scores_the_rows_of_one_row_group_by_all_tasks(spark, base):
    rules = Rules(phrases={"of the": 0.4, "not la": -1.0})
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs).unionByName(spark.createDataFrame(
        [(None, None), (None, ""), (7, "the THE of the")], "doc_id long, text string"))
    lexicon = spark.createDataFrame(list(DEFAULT_LEXICON.items()), "token string, valence double")
    by_table = rule_scores(docs, "text", lexicon, rules)
    assert "RoundRobinPartitioning" in _plan(by_table)
    want = rule_scores(docs, "text", DEFAULT_LEXICON, rules)
    assert by_table.exceptAll(want).count() == 0 == want.exceptAll(by_table).count()
