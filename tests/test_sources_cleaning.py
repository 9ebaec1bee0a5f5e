"""CSV readers, width checks, cleaning and time parts (FIXTURES.md section 4)."""

import calendar
import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from postpulse.functions import cleaning
from postpulse.functions.timeparts import epoch_of, epoch_of_col, time_parts
from postpulse.operators.features import with_time_parts
from postpulse.session import scratch_path
from postpulse.sources import csvio


def _write_text(spark, lines):
    path = scratch_path(spark, f"t-{uuid.uuid4().hex[:6]}")
    spark.createDataFrame([(ln,) for ln in lines], "value string").coalesce(1).write.text(path)
    return path


def test_exact_width_drops_short_and_long_rows(spark):
    path = _write_text(spark, ["h1,h2,h3", "a,b,c", "a,b", "a,b,c,d", "x,y,z"])
    kept = csvio.read_exact_width(spark, path, 3, header=True).collect()
    assert sorted(tuple(r) for r in kept) == [("a", "b", "c"), ("x", "y", "z")]


def test_exact_width_keep_rejects(spark):
    path = _write_text(spark, ["a,b,c", "a,b"])
    kept, rejects = csvio.read_kept_and_rejects(spark, path, 3, header=False)
    assert [tuple(r) for r in kept.collect()] == [("a", "b", "c")]
    assert [r.line for r in rejects.collect()] == ["a,b"]
    assert (kept.count(), rejects.count()) == (1, 1)


def test_width_is_checked_whatever_is_selected(spark):
    path = _write_text(spark, ["a,b,c,d", "a,b", "1,2,3,4,5", "w,x,y,z"])
    rows = csvio.read_exact_width(spark, path, 4, list("abcd"), header=False)
    assert rows.count() == 2
    assert sorted(r.a for r in rows.select("a").collect()) == ["a", "w"]
    assert sorted(r.d for r in rows.select("d").distinct().collect()) == ["d", "z"]
    strict = csvio.read_delimited(spark, path, "a string, b string, c string, d string", header=False)
    with pytest.raises(Exception, match="(?i)malformed"):
        strict.select("a").collect()


def test_blank_text_epoch_is_1970(spark):
    df = spark.createDataFrame([("",), (None,)], "created_utc string")
    assert {(r.year, r.month, r.day) for r in with_time_parts(df).collect()} == {(1970, 1, 1)}


def test_strict_cast_raises_without_ansi(spark):
    df = spark.createDataFrame([("x",)], "s string")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="not an integer"):
            df.select(cleaning.to_int(F.col("s"))).collect()
        assert df.select(cleaning.to_int(F.col("s"), strict=False).alias("v")).first().v is None
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_quoted_newline_is_one_row(spark):
    df = spark.createDataFrame([(1, 'line one\nline "two", end')], "id long, body string")
    path = scratch_path(spark, "q")
    csvio.write_delimited(df, path)
    back = csvio.read_delimited(spark, path, "id long, body string", multiline=True).collect()
    assert [tuple(r) for r in back] == [(1, 'line one\nline "two", end')]


def test_split_line_deletes_tabs_and_strips():
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([("  7\t,a,b\t ",)], "value string")
    got = df.select(csvio.split_line("value", ",", "\t").alias("p")).first().p
    assert got == ["  7", "a", "b "]
    got2 = df.select(csvio.split_line("value", "\t", None, strip=True).alias("p")).first().p
    assert got2 == ["7", ",a,b"]


def test_fill_blank_zero_no_trim(spark):
    df = spark.createDataFrame([("", None, " ", None)], "a string, b string, c string, d double")
    r = cleaning.fill_blank_zero(df).first()
    assert (r.a, r.b, r.c, r.d) == ("0", "0", " ", 0.0)


def test_drop_strict_and_rename_count(spark):
    df = spark.createDataFrame([(1, 2)], "x int, y int")
    with pytest.raises(KeyError):
        cleaning.drop_strict(df, ["z"])
    with pytest.raises(ValueError):
        cleaning.rename_all(df, ["only_one"])
    assert cleaning.rename_all(df, ["p", "q"]).columns == ["p", "q"]


def test_dropna(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "x int, y string")
    assert [tuple(r) for r in cleaning.drop_null_rows(df).collect()] == [(1, "a")]


def test_time_parts_known_epoch(spark):
    e = 1617235200  # 2021-04-01 00:00 UTC, a Thursday
    assert epoch_of(2021, 4, 1) == e
    df = spark.createDataFrame([(e,), (None,), (1617494400,)], "created_utc long")
    rows = with_time_parts(df).collect()
    assert (rows[0].hour, rows[0].dayofweek, rows[0].day, rows[0].month, rows[0].year) == (0, 4, 1, 4, 2021)
    assert (rows[1].day, rows[1].month, rows[1].year) == (1, 1, 1970)   # blank epoch
    assert rows[2].dayofweek == 7                                         # 2021-04-04, a Sunday


def test_time_parts_against_python(spark):
    epochs = [0, 59, 3599, 86399, 86400, 951782400, 1601510400 + 12345 * 3607, 2**31 + 17]
    df = spark.createDataFrame([(e,) for e in epochs], "e long")
    parts = time_parts(F.col("e"))
    got = df.select("e", *[parts[k].alias(k) for k in parts]).collect()
    for r in got:
        d = dt.datetime.fromtimestamp(r.e, dt.timezone.utc)
        assert (r.hour, r.dayofweek, r.day, r.month, r.year) == (d.hour, d.isoweekday(), d.day, d.month, d.year)
        assert calendar.timegm(d.timetuple()) == r.e


def test_time_parts_independent_of_session_zone(spark):
    df = spark.createDataFrame([(1617235200,)], "created_utc long")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        r = with_time_parts(df).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert (r.hour, r.day, r.month) == (0, 1, 4)


def test_epoch_of_date_columns(spark):
    df = spark.createDataFrame([(2021, 4, 1), (2020, 10, 1)], "y int, m int, d int")
    got = [r.e for r in df.select(epoch_of_col(F.col("y"), F.col("m"), F.col("d")).alias("e")).collect()]
    assert got == [1617235200, 1601510400]


def test_chunked_write_and_last_chunk(spark):
    import glob
    from postpulse.operators.slices import last_chunk
    df = spark.range(95).withColumnRenamed("id", "k").coalesce(1)
    path = scratch_path(spark, "chunks")
    csvio.write_delimited(df, path, max_records_per_file=10)
    files = glob.glob(path.replace("file:", "") + "/part-*.csv")
    assert len(files) == 10                                   # 9 full chunks and one of 5
    back = csvio.read_delimited(spark, path, "k long")
    assert back.count() == 95
    assert sorted(r.k for r in last_chunk(back, 10, "k").collect()) == list(range(90, 95))
