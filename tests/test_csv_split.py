import random

import pytest
from pyspark.sql import functions as F

from postpulse.session import scratch_path
from postpulse.sources import csvio, csvsplit

SCHEMA = "id long, a string, b string"


def rows(seed, n=400):
    rng = random.Random(seed)
    parts = ["plain", "comma, here", 'a "quoted" word', "line\nbreak", "\n\n", '"', '""', "é日\n", "x" * 300, "",
             "ends with newline\n", ",", '",\n"', "tab\t", " lead", "long\n" * 200]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 4))),
             rng.choice(parts) or None) for i in range(n)]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def same(spark, path, header=True, **options):
    want = csvio.read_delimited(spark, path, SCHEMA, header=header, multiline=True)
    got = csvsplit.read_split(spark, path, SCHEMA, header=header, **options)
    a, b = sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, want.collect()), key=str)
    assert a == b
    return got, len(a)


@pytest.mark.parametrize("options", [{}, {"tail_chars": 20}, {"broadcast_blocks": 0},
                                     {"tail_chars": 5, "broadcast_blocks": 0}])
@pytest.mark.parametrize("header", [True, False])
def test_blocks_give_the_rows_of_the_whole_file_parser(spark, small_blocks, header, options):
    path = scratch_path(spark, "split")
    df = spark.createDataFrame(rows(1), SCHEMA).coalesce(1)
    csvio.write_delimited(df, path, header=header)
    _, n = same(spark, path, header, **options)
    assert n == 400
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 40


def test_records_longer_than_blocks(spark, small_blocks):
    path = scratch_path(spark, "split")
    data = [(1, "first"), (2, "line\n" * 3000), (3, "in\nbetween"), (4, 'q"\n' * 2000), (5, "last\n")]
    df = spark.createDataFrame([(i, t, "z") for i, t in data], SCHEMA).coalesce(1)
    csvio.write_delimited(df, path)
    for options in ({}, {"tail_chars": 10}):
        _, n = same(spark, path, **options)
        assert n == 5


def test_several_files_crlf_blank_lines_and_no_quotes(spark, small_blocks, tmp_path):
    a, b, c = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c.csv"
    a.write_bytes(b'id,a,b\r\n1,"x\r\ny",z\r\n2,u,v\r\n' * 1)
    b.write_bytes(b"id,a,b\n" + b"".join(b"%d,plain,row\n" % i for i in range(500)) + b"\n\n7,end,no newline")
    c.write_bytes(b"id,a,b\n")
    got = csvsplit.read_split(spark, [str(a), str(b), str(c)], SCHEMA).collect()
    assert len(got) == 503
    assert {tuple(r) for r in got if r.id in (1, 2) and r.a != "plain"} == {(1, "x\r\ny", "z"), (2, "u", "v")}
    same(spark, str(b))


def test_widths_and_modes(spark, small_blocks, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("".join(f'{i},"a\n{i}",b\n' if i % 3 else f'{i},"a\nb"\n' if i % 2 else f"{i},a,b,c\n"
                            for i in range(300)))
    kept = csvsplit.read_split(spark, str(path), "id string, a string, b string", header=False,
                               mode="DROPMALFORMED")
    want = csvio.read_exact_width(spark, str(path), 3, ["id", "a", "b"], header=False, multiline=True)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))
    assert kept.select("id").count() == kept.count() == 200
    with pytest.raises(Exception):
        csvsplit.read_split(spark, str(path), "id long, a string, b string", header=False).agg(
            F.sum("id")).collect()


def test_an_empty_folder_of_records(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("id,a,b\n")
    assert csvsplit.read_split(spark, str(path), SCHEMA).count() == 0
