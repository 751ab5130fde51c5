"""Contact sheets and case folders as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column a string, without the rows that are blank in all columns."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    filled = [F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != "" for c in df.columns]
    return df.where(reduce(lambda a, b: a | b, filled)) if filled else df


def read_case_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON objects below path, one a file, with the file they lie in; broken files and names that begin with _ are left out."""
    found = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    file = F.col("_metadata.file_path")
    return found.select("*", file.alias("file")).where(~F.col("file").rlike(r"/_[^/]*$"))
