"""File readers and sinks (IO1-IO5).

Readers always take an explicit schema (no inference pass over the data);
sinks write directories of part files, so writing scales with the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


# Quotes inside a quoted field are doubled, as other CSV writers do.
QUOTING = {"quote": '"', "escape": '"'}


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True,
                   null_value: str | None = None, multi_line: bool = False) -> DataFrame:
    """IO1: CSV with a header row; an empty field is NULL.  ``null_value`` (e.g. ``\\N``)
    turns a sentinel into NULL at read time.  ``multi_line``: quoted fields may span lines; each
    file is then read by one task."""
    r = spark.read.schema(schema).options(**QUOTING).option("header", header).option("mode", "PERMISSIVE").option("multiLine", multi_line)
    if null_value is not None:
        r = r.option("nullValue", null_value)
    return r.csv(path)


def read_task_tsv(spark: SparkSession, path: str, names: Sequence[str], multi_line: bool = False,
                  corrupt: str | None = None) -> DataFrame:
    """IO2: tab-separated, no header, caller-named columns, every field text.

    ``multi_line``: quoted fields may span lines, so texts with line breaks survive; each file is
    then read by one task, so many files are wanted.  ``corrupt`` names a column that receives the
    raw line of a row with too few or too many fields (else NULL); such rows are kept.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *([corrupt] if corrupt else [])]])
    r = spark.read.schema(schema).options(**QUOTING).option("sep", "\t").option("header", False).option("multiLine", multi_line)
    if corrupt:
        r = r.option("columnNameOfCorruptRecord", corrupt)
    return r.option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", single_file: bool = False) -> None:
    """IO3: header row, no index; ``single_file`` only for a small submission table."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(**QUOTING).option("header", header).option("sep", sep).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    write_csv(df, path, header=False, sep="\t")


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """IO4: JSON lines; NULL fields are written (``ignoreNullFields=false``)."""
    w = df.write.mode("overwrite").option("ignoreNullFields", False)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_features(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """IO5: materialise a feature table as Parquet (types kept, unlike a CSV hand-off)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
