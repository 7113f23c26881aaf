"""Text files with true line numbers, however many tasks read each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(
    spark: SparkSession, path: str, pattern: str | None = None, parts: bool = False
) -> DataFrame:
    """Lines of text files as (path, seq, line), seq counting from 1 in each file.

    Within one file, block start and the rising row id give the true order.  A line's
    number is its place in its block plus the lines of earlier blocks, so no task
    ever holds more than one block of one file.  With ``parts`` the files of a folder
    count as one text in name order, and ``path`` is the folder.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"),
    )
    unit = F.regexp_extract("file", r"^(.*)/[^/]*$", 1) if parts else F.col("file")
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("path", unit)
    earlier = Window.partitionBy("path").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("path", "file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("row"))
    return lines.withColumn("place", place).join(offsets, ["file", "block"]).select(
        "path", (F.col("before") + F.col("place")).alias("seq"), "line"
    )


def log_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Trimmed non-empty log lines as (path, seq, line); seq keeps the place in the file."""
    lines = numbered_lines(spark, path, pattern)
    clean = F.regexp_replace("line", r"^\s+|\s+$", "")
    return lines.withColumn("line", clean).where(F.col("line") != "")
