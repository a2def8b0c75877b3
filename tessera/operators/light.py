"""Optical quality: exposure, illumination and blur, from per-image features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import stats as S

BY = ["dataset_id"]
EXPOSURE = ("R_over", "I_over", "R_under", "I_under")


def exposure(features: DataFrame, by: list[str] = BY) -> DataFrame:
    """Mean and percentiles of the four exposure features, in one aggregate."""
    cols = [c for name in EXPOSURE for c in S.summary(F.col(name), name)]
    return features.groupBy(*by).agg(*cols, F.count("R_over").alias("n_images_valid"))


def one_feature(features: DataFrame, column: str, name: str, by: list[str] = BY) -> DataFrame:
    return features.groupBy(*by).agg(*S.summary(F.col(column), name), F.count(column).alias("n_images_valid"))


def illumination(features: DataFrame, by: list[str] = BY) -> DataFrame:
    return one_feature(features, "illum_iu", "IU", by)


def gradient_concentration(features: DataFrame, by: list[str] = BY) -> DataFrame:
    return one_feature(features, "goe", "GOE", by)


def directional_loss(features: DataFrame, by: list[str] = BY) -> DataFrame:
    return one_feature(features, "dhfel", "DHFEL", by)


def scores_of(means: DataFrame, by: list[str] = BY) -> DataFrame:
    """Exposure, illumination and blur scores and the optical score, from the means of the features."""
    a = means.withColumn("exposure_score", 1.0 - (S.geo_mean(F.col("R_over"), F.col("I_over")) + S.geo_mean(F.col("R_under"), F.col("I_under"))))
    a = a.withColumn("illumination_score", 1.0 - F.col("illum_iu"))
    a = a.withColumn("blur_score", 1.0 - F.sqrt((F.col("goe") + S.EPS) * (F.col("dhfel") + S.EPS)))
    out = a.withColumn("optical_score", S.geo_mean(F.col("exposure_score"), F.col("illumination_score"), F.col("blur_score"), guard=1e-6))
    return out.select(*by, "exposure_score", "illumination_score", "blur_score", "optical_score")


def light_scores(features: DataFrame, by: list[str] = BY) -> DataFrame:
    """Scores from one aggregate."""
    return scores_of(features.groupBy(*by).agg(*[F.avg(c).alias(c) for c in (*EXPOSURE, "illum_iu", "goe", "dhfel")]), by)
