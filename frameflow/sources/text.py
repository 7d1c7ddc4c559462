"""Text sources: episode lists and progress logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def episodes_of_lines(lines: DataFrame) -> DataFrame:
    """Distinct episode numbers: the first word of each line that isn't a comment and is a number."""
    first = F.element_at(F.split(F.trim("value"), r"\s+"), 1)
    return lines.where(~F.trim("value").startswith("#")).select(F.nullif(F.regexp_extract(first, r"^\d{1,18}$", 0), F.lit("")).cast("long").alias("episode")).where("episode is not null").distinct()


def episode_list(spark: SparkSession, path: str) -> DataFrame:
    """The episode list in a text file; an empty one is an error."""
    out = episodes_of_lines(spark.read.text(path))
    if out.isEmpty():
        raise ValueError(f"{path} lists no episode")
    return out


def progress_reports(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, report): all matches of a pattern that may span lines, in each log file."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return whole.select("path", F.posexplode(F.regexp_extract_all("value", F.lit(pattern), 0)).alias("number", "report"))
