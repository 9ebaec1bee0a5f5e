"""Delimited-text readers and writers (survey S3, S5-S11, S13, P14).

The original jobs read quoted CSV line by line, skip a header, keep rows of an
exact field count and print tab- or comma-separated tuples. Here each is one
DataFrame reader/writer call with an explicit schema, so nothing is inferred
and the width check is done by the CSV parser inside the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def positional_schema(n_fields: int, names: list[str] | None = None) -> StructType:
    names = names or [f"_c{i}" for i in range(n_fields)]
    if len(names) != n_fields:
        raise ValueError("names must match n_fields")
    return StructType([StructField(n, StringType(), True) for n in names])


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True,
                    columns: list[str] | None = None, max_records_per_file: int | None = None,
                    compression: str | None = None) -> str:
    """Write text with a header row, no index, chosen columns.

    ``max_records_per_file`` splits the output in chunks of N rows (S4). A compressed file is
    one task to read, so bound its rows.
    """
    out = df.select(*(columns or df.columns))
    w = out.write.mode("errorifexists").option("header", header).option("sep", sep) \
        .option("quote", '"').option("escape", '"')
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if compression:
        w = w.option("compression", compression)
    w.csv(path)
    return path


def write_mixed(frames: list[DataFrame], path: str, max_records_per_file: int = 20_000) -> list[str]:
    """Write frames of different widths side by side below ``path``; the paths to read.

    Raw rows are mostly fields that no job reads, alike from row to row: the files are compressed.
    """
    return [write_delimited(f, f"{path}/{k}", max_records_per_file=max_records_per_file,
                            compression="gzip")
            for k, f in enumerate(frames)]


def read_delimited(spark: SparkSession, path: str | list[str], schema: StructType | str,
                   sep: str = ",", header: bool = True, multiline: bool = False,
                   mode: str = "FAILFAST") -> DataFrame:
    """Read quoted text with an explicit schema.

    ``multiline=True`` allows newlines inside quoted fields but makes a file
    unsplittable, so only ask for it when the data needs it.
    """
    return (spark.read.schema(schema)
            .option("header", header).option("sep", sep)
            .option("quote", '"').option("escape", '"')
            .option("multiLine", multiline)
            .option("maxCharsPerColumn", -1)
            # a pruned parser looks at the wanted fields only and lets wrong widths pass
            .option("columnPruning", False)
            .option("mode", mode)
            .csv(path))


def read_exact_width(spark: SparkSession, path: str | list[str], n_fields: int,
                     names: list[str] | None = None, header: bool = True,
                     multiline: bool = False) -> DataFrame:
    """Keep only rows with exactly ``n_fields`` fields (S7), whatever is selected later."""
    return read_delimited(spark, path, positional_schema(n_fields, names), header=header,
                          multiline=multiline, mode="DROPMALFORMED")


def read_kept_and_rejects(spark: SparkSession, path: str, n_fields: int,
                          names: list[str] | None = None, header: bool = True,
                          multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of exactly ``n_fields`` fields, raw text of the others as ``line``).

    One permissive read for each frame.
    """
    names = names or [f"_c{i}" for i in range(n_fields)]
    schema = StructType(positional_schema(n_fields, names).fields
                        + [StructField("_corrupt", StringType(), True)])
    rows = (spark.read.schema(schema).option("header", header).option("multiLine", multiline)
            .option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1)
            .option("columnPruning", False)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path))
    # Spark refuses queries that read the corrupt column alone, which a count is after pruning;
    # a test of the data columns that always holds keeps them in every plan
    present = F.pmod(F.xxhash64(*names), F.lit(2)) < 2
    bad = F.col("_corrupt").isNotNull()
    return (rows.where(present & ~bad).select(*names),
            rows.where(present & bad).select(F.col("_corrupt").alias("line")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw text lines in a ``value`` column."""
    return spark.read.text(path)


def split_line(value, sep: str = ",", delete: str | None = "\t", strip: bool = False):
    """Split one text line into an array of fields.

    ``delete`` characters are removed first (tab in the sampling job);
    ``strip`` trims surrounding whitespace (the re-delimiting reducer).
    """
    v = F.col(value) if isinstance(value, str) else value
    if delete:
        v = F.regexp_replace(v, delete, "")
    if strip:
        # like str.strip(): all surrounding whitespace, tabs included (trim drops spaces only)
        v = F.regexp_replace(v, r"^\s+|\s+$", "")
    return F.split(v, _regex_escape(sep))


def _regex_escape(sep: str) -> str:
    return "".join("\\" + ch if ch in ".^$*+?{}[]\\|()" else ch for ch in sep)
