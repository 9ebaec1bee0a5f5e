"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile

import postpulse
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.session import scratch_path

#: Characters that separate words in every operator here: space and \t \n \v \f \r.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only: other columns of the input can never clash with ours."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.col(text_col).cast("string").alias("text"))


def map_frames(df: DataFrame, fn, schema: str, id_col: str = "doc_id") -> DataFrame:
    """``mapInPandas`` with the id as text inside: pandas holds a long beside a null as a float,
    which rounds ids above 2^53."""
    inside = schema.replace(f"{id_col} long", f"{id_col} string")
    got = df.withColumn(id_col, F.col(id_col).cast("string")).mapInPandas(fn, inside)
    return got.withColumn(id_col, F.col(id_col).cast("long"))


def normal_text(col):
    """Null as empty, every run of blanks as one space."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), BLANKS, " ")


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8: ``bytes.split`` cuts at exactly the six blanks of ``BLANKS``."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Texts may be long: fewer rows than Spark's default go to a Python worker at a time.
BATCH, DEFAULT, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


@contextlib.contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]):
    """Settings that hold for the jobs run inside, then what held before."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def landed(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write below the shared folder and read back: cuts lineage, survives lost executors.

    The shuffle files of the write are dropped once it is done; nothing reads them again.
    """
    path = scratch_path(spark, tag)
    with session_settings(spark, {TIDY: "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.landed_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete ``landed`` tables that nothing reads any more: all built on them is landed too."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.landed_at)
        path.getFileSystem(conf).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would.

    Where the session leaves the size of Arrow batches at its default, it becomes ``ROWS``.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH, DEFAULT) == DEFAULT:
        spark.conf.set(BATCH, ROWS)
    if getattr(sc, "_postpulse_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(postpulse.__file__))
    work = tempfile.mkdtemp(prefix="postpulse-package-")  # read by the driver's file server only
    shutil.copytree(root, f"{work}/code/postpulse",
                    ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{work}/postpulse", "zip", f"{work}/code"))
    sc._postpulse_shipped = True
