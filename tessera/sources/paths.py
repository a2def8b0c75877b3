"""File names out of encoded paths."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def file_name(uri: Column) -> Column:
    """Last part of an encoded path, decoded; a plus sign means itself there."""
    return F.url_decode(F.replace(F.regexp_extract(uri, "([^/]*)$", 1), F.lit("+"), F.lit("%2B")))


def stem_of(name: Column) -> Column:
    """A name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def folder_size(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Bytes and files under a folder, as its file system counts them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    summary = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path)
    return summary.getLength(), summary.getFileCount()
