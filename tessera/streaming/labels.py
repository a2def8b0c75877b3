"""Boxes from a label folder that still grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.sources.labels import parse_text
from tessera.sources.paths import file_name, stem_of


def stream_labels(spark: SparkSession, folder: str, dataset_id: str = "", files_a_batch: int = 1000) -> DataFrame:
    """A stream of box rows, one batch for up to so many new label files."""
    files = spark.readStream.option("wholetext", True).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_a_batch).format("text").load(folder)
    texts = files.select(F.lit(dataset_id).alias("dataset_id"), stem_of(file_name(F.col("_metadata.file_path"))).alias("stem"), F.col("value").alias("text"))
    return parse_text(texts)


def position_counts(boxes: DataFrame, cells: int = 8) -> DataFrame:
    """Running counts of box centres over a grid: state is bounded by the grid."""
    return boxes.groupBy("dataset_id", G.grid_cell(F.col("cy"), cells).alias("gy"), G.grid_cell(F.col("cx"), cells).alias("gx")).agg(F.count(F.lit(1)).alias("n"))
