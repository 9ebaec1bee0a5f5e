"""Files and tasks stay small as the tables grow."""

import glob
import os

from pyspark.sql import functions as F

from postpulse.plans import models
from postpulse.sources import csvio


def test_raw_rows_are_written_compressed_and_read_back(spark, tmp_path):
    cells = [F.col("id").cast("string").alias("_c0"), F.lit('a "b",\nc').alias("_c1")]
    cells += [F.lit(f"x{k}").alias(f"_c{k}") for k in range(2, 95)]
    frame = spark.range(5000).coalesce(2).select(*cells)
    paths = csvio.write_mixed([frame, frame.drop("_c94")], str(tmp_path / "raw"), 1000)
    size = sum(os.path.getsize(f) for p in paths for f in glob.glob(f"{p}/part-*"))
    assert size < 5000 * 2 * 60         # a row has over 350 characters
    got = csvio.read_exact_width(spark, paths, 95, multiline=True)
    assert sorted(int(r._c0) for r in got.select("_c0").collect()) == list(range(5000))
    assert got.select("_c1").distinct().collect() == [('a "b",\nc',)]


def test_tasks_that_meet_rare_values_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "JOIN_ROWS", 100)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 3 == 1, F.concat(F.lit("v"), F.col("id").cast("string"))).alias("code"))
    out = models.index_strings(rows, ["code"], handle_invalid="keep", top=5)
    plan = out._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "_salt" in plan
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(
        F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 3000 and len(sizes) > 20 and max(sizes) < 200
    got = {r.id: r.codeIndex for r in out.collect()}
    names = sorted(f"v{k}" for k in range(3000) if k % 3 == 1)
    want = {"hot": 0.0, **{v: i + 1.0 for i, v in enumerate(names)}}
    assert got == {k: want["hot"] if k % 3 == 0 else want[f"v{k}"] if k % 3 == 1 else 1001.0
                   for k in range(3000)}
