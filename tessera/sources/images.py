"""Image folders: names from a listing, pixels from Spark's own image source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.paths import file_name, stem_of, suffix_of

# Suffixes that count as images.
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")


def read_images(spark: SparkSession, folder: str, dataset_id: str = "") -> DataFrame:
    """(dataset_id, image_id, stem, height, width, channels, data, readable) of the images right in a folder.

    image_id is the file's name. Files that can't be decoded stay, with readable false.
    """
    raw = spark.read.format("image").option("dropInvalid", False).load(folder)
    name = file_name(F.col("image.origin"))
    out = raw.select(
        F.lit(dataset_id).alias("dataset_id"),
        name.alias("image_id"),
        stem_of(name).alias("stem"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )
    return out.where(suffix_of(F.col("image_id")).isin(*SUFFIXES)).withColumn("readable", F.coalesce((F.col("height") > 0) & (F.col("channels") > 0), F.lit(False)))


# First bytes of the formats that the image source decodes.
SIGNATURES = ("FFD8FF", "89504E470D0A1A0A", "424D", "49492A00", "4D4D002A", "47494638")


def list_images(spark: SparkSession, folder: str, dataset_id: str = "") -> DataFrame:
    """(dataset_id, image_id, stem, known) of the images right in a folder; nothing is decoded.

    `known` says that a file begins as images of a format do that can be decoded. Without that column a
    reader of the listing opens no file.
    """
    name = file_name(F.col("_metadata.file_path"))
    begins = F.lit(False)
    for s in SIGNATURES:
        begins = begins | F.startswith(F.hex(F.substring("content", 1, 8)), F.lit(s))
    listed = spark.read.format("binaryFile").load(folder).where(suffix_of(name).isin(*SUFFIXES))
    return listed.select(F.lit(dataset_id).alias("dataset_id"), name.alias("image_id"), stem_of(name).alias("stem"), begins.alias("known"))


def ordinals(listed: DataFrame) -> DataFrame:
    """(dataset_id, image_id, ordinal) of the listed images that begin as images do, numbered by name in their dataset."""
    w = Window.partitionBy("dataset_id").orderBy("image_id")
    return listed.where("known").select("dataset_id", "image_id", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


def quarantine(images: DataFrame) -> DataFrame:
    """Images that could not be decoded."""
    return images.where("NOT readable").select("dataset_id", "image_id")
