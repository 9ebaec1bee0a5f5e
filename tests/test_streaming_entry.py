"""Streaming jobs and the driver contract in __spark_entry__.py."""

import duckdb

import __spark_entry__ as entry
from postpulse.session import scratch_path
from postpulse.sources import csvio
from postpulse.streaming.feature_stream import start_posts_stream
from postpulse.sources.tables import TABLES


def test_posts_stream_cleans_rows_and_resumes(spark):
    land = scratch_path(spark, "posts-land")
    sink = scratch_path(spark, "posts-sink")
    ckpt = scratch_path(spark, "posts-ckpt")
    schema = "author string, link string, num_comments string, subreddit string"
    first = spark.createDataFrame([("a", "L1", "3", "s1"), ("[deleted]", "L1", "9", "s1"),
                                   ("", "L2", "", "s2")], schema)
    csvio.write_delimited(first.coalesce(1), f"{land}/batch1")
    start_posts_stream(spark, f"{land}/*", sink, ckpt).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    assert got == [("0", "L2", 0, "s2"), ("a", "L1", 3, "s1")]
    # a second file is picked up by a restart from the same checkpoint, the first is not re-read
    second = spark.createDataFrame([("b", "L3", "4", "s1")], schema)
    csvio.write_delimited(second.coalesce(1), f"{land}/batch2")
    start_posts_stream(spark, f"{land}/*", sink, ckpt).awaitTermination()
    n = spark.read.parquet(sink).count()
    assert n == 3


def test_entry_runs_flagship(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["subreddit", "num_author", "num_links"]
    assert 0 < len(rows) <= 10


def test_oracle_keys_are_registered_queries():
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 40


def test_oracles_match_at_smallest_scale(spark):
    """Every SQL-checked key except the heavier ones, against DuckDB at sf0.001."""
    from check_oracles import digest
    base = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    for key, sql in sqls.items():
        df = qs[key](spark, base)
        srows = [tuple(r) for r in df.collect()]
        res = con.execute(sql)
        dcols = [d[0] for d in res.description]
        drows = res.fetchall()
        assert sorted(df.columns) == sorted(dcols), key
        assert digest(df.columns, srows)[0] == digest(dcols, drows)[0], key


def test_scratch_and_checkpoints_live_in_the_configured_folder(spark):
    from postpulse.session import shared_dir
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured.rstrip("/")
    assert scratch_path(spark, "x").startswith(configured.rstrip("/") + "/")
    assert spark.sparkContext.getCheckpointDir().replace("file:", "").startswith(configured.rstrip("/"))
