"""Reading pages, rule files and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.session import written


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages: a Parquet table with page_id, url and html, or a folder of HTML files (url is the file path)."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(
        F.xxhash64(F.input_file_name()).alias("page_id"), F.input_file_name().alias("url"), F.col("value").alias("html")
    )


def dealt_out(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages spread over all cores by ``keys``, for inputs with fewer tasks than cores.

    Parsing is bound by CPU, and a small file is one task whatever it costs. A corpus of many files needs no such
    shuffle and should not get one.
    """
    spark = pages.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pages.repartition(tasks, *keys)


def read_rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of rule files with their number: (source, seq, line). Each file is a rule set of its own.

    A file of any size is read in splits. A task reads the lines of a split one after the other, so their places within it follow from
    the ids that the task counts up, and the lines before it from the sums over the splits before it. Lines end at a line feed.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).select(
        F.input_file_name().alias("source"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )
    # Written, because ids are only good for one reading.
    lines = written(lines, "rule-lines")
    earlier = Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("source", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).select(
        "source", "split", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    )
    return lines.join(starts, ["source", "split"]).select("source", (F.col("at") + F.col("shift")).alias("seq"), "line")


def list_assets(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path``: (path relative to it, size). Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    root = path.rstrip("/") + "/"
    return files.select(
        F.substring_index("path", root, -1).alias("path"), F.col("length").alias("size")
    )
