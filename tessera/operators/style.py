"""Style consistency: how far images' colour, tone, texture and compression lie from their dataset's mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import stats as S
from tessera.operators.vectors import moments

BY = ["dataset_id"]


def dispersion(vectors: DataFrame, column: str, name: str, by: list[str] = BY) -> DataFrame:
    """Mean distance of the vectors of a group from their centroid.

    Two passes: centroids, summed as whole vectors in tasks, then distances. The centroid table has one row
    a group. No vectors: no row of the group. What computes the vectors runs twice unless it is cached.
    """
    x = vectors.select(*by, F.col(column).cast("array<double>").alias("v"))
    centre = moments(x, "v", by).select(*by, F.col("mean").alias("c"))
    d = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e))
    return x.join(centre, by).groupBy(*by).agg(F.avg(d).alias(name), F.count(F.lit(1)).alias("n_images"))


def deviation(features: DataFrame, column: str, name: str, by: list[str] = BY) -> DataFrame:
    """Mean absolute deviation of a feature from its group's mean; the means have one row a group."""
    mean = features.groupBy(*by).agg(F.avg(column).alias("mu"))
    return features.select(*by, F.col(column).alias("x")).join(mean, by).groupBy(*by).agg(F.avg(F.abs(F.col("x") - F.col("mu"))).alias(name), F.count("x").alias("n_images"))


def style_metrics(features: DataFrame, by: list[str] = BY) -> DataFrame:
    """C_color, C_tone, C_tex, C_noise, C_blk and C_sharp, one row a group."""
    out = dispersion(features, "color", "C_color", by)
    for column, name in (("tone", "C_tone"), ("lbp", "C_tex")):
        out = out.join(dispersion(features, column, name, by).drop("n_images"), by)
    for column, name in (("noise", "C_noise"), ("blockiness", "C_blk"), ("lap_var", "C_sharp")):
        out = out.join(deviation(features, column, name, by).drop("n_images"), by)
    return out


def scores_of(m: DataFrame, include_blockiness: bool = True) -> DataFrame:
    """Metrics of style_metrics() with the scores of each consistency and the style score; C_sharp is reported only."""
    m = m.withColumns({f"{k}_score": S.slowly_falling(F.col(c)) for k, c in (("color", "C_color"), ("tone", "C_tone"), ("texture", "C_tex"), ("noise", "C_noise"), ("blockiness", "C_blk"))})
    both = S.geo_mean(F.col("noise_score"), F.col("blockiness_score"), guard=1e-6) if include_blockiness else F.col("noise_score")
    m = m.withColumn("compression_score", both)
    return m.withColumn("style_score", S.geo_mean(*(F.col(f"{k}_score") for k in ("color", "tone", "texture", "compression")), guard=1e-6))


def style_scores(features: DataFrame, by: list[str] = BY, include_blockiness: bool = True) -> DataFrame:
    return scores_of(style_metrics(features, by), include_blockiness)
