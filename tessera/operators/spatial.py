"""Spatial structure: box scale, position and size, and per-image detail.

Every metric takes a table and returns one row for each value of the columns `by`, so that many dataset
splits are scored in one job. Aggregates have partial sums in each task; only exact percentiles gather
values, one column's distinct ones a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import stats as S

BY = ["dataset_id"]


def with_corners(boxes: DataFrame) -> DataFrame:
    """boxes (cx, cy, bw, bh, w_img, h_img) with clamped pixel corners."""
    return boxes.withColumns(G.corners(*(F.col(c) for c in ("cx", "cy", "bw", "bh", "w_img", "h_img"))))


def scale_variation(boxes: DataFrame, by: list[str] = BY) -> DataFrame:
    """Spread of box sizes. Boxes without area count with size 0; no box: no row of the group."""
    s = with_corners(boxes).withColumn("s", G.size(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    out = s.groupBy(*by).agg(F.avg("s").alias("scale_mu"), F.stddev_pop("s").alias("scale_sd"), F.count("s").alias("n_bboxes"))
    return out.withColumn("scale_cv", F.col("scale_sd") / (F.col("scale_mu") + S.EPS)).withColumn("scale_score", S.falling(F.col("scale_cv")))


def position_entropy(boxes: DataFrame, by: list[str] = BY, cells: int = 8) -> DataFrame:
    """Entropy of box centres over a grid; the score is high where they crowd."""
    counts = boxes.groupBy(*by, G.grid_cell(F.col("cy"), cells).alias("gy"), G.grid_cell(F.col("cx"), cells).alias("gx")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("n_bboxes"), F.collect_list("n").alias("ns"))
    h = F.aggregate(F.array_sort("ns"), F.lit(0.0), lambda s, n: s + S.entropy_term(n / (F.col("n_bboxes") + S.EPS)))
    out = total.withColumn("pos_entropy", h).withColumn("pos_entropy_norm", F.col("pos_entropy") / S.log_cells(cells * cells))
    return out.withColumn("pos_score", 1.0 - S.unit(F.col("pos_entropy_norm"))).drop("ns")


def pixel_sufficiency(boxes: DataFrame, by: list[str] = BY, tau: float = 8.0, shrink: float = 1.0) -> DataFrame:
    """Share of boxes with area whose shorter side is longer than tau pixels; no box: NaN."""
    if shrink < 1:
        boxes = boxes.withColumns({"bw": F.col("bw") * shrink, "bh": F.col("bh") * shrink})
    b = with_corners(boxes)
    r = F.when((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return b.groupBy(*by).agg(F.count(r).alias("n_bboxes_valid"), S.or_nan(F.avg((r > tau).cast("double"))).alias("px_prob_r_gt_tau"))


def detail_insufficiency(box_details: DataFrame, by: list[str] = BY, c: float = 1.0) -> DataFrame:
    """From the mean absolute Laplacian of each box's crop (`lap`): mean and 10th percentile, averaged; zeros for nothing."""
    out = box_details.groupBy(*by).agg(F.avg("lap").alias("hf_L_mean"), S.exact_percentile(F.col("lap"), 0.1).alias("hf_L10"), F.count("lap").alias("n_bboxes_valid"))
    out = out.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("hf_L_mean", "hf_L10")})
    return out.withColumn("hf_L_hf", (F.col("hf_L_mean") + F.col("hf_L10")) / 2).withColumn("hf_score", S.rising(F.col("hf_L_hf"), c))


def resampling_loss(features: DataFrame, by: list[str] = BY, least: float = 0.005) -> DataFrame:
    """Mean share of detail (`lap0`) that halving and doubling an image loses (`lap1`); flat images are counted apart."""
    kept = F.col("lap0") >= least
    d = F.when(kept, 1.0 - F.col("lap1") / (F.col("lap0") + S.EPS))
    return features.groupBy(*by).agg(S.or_nan(F.avg(d)).alias("rs_interp_D_mean"), F.count(d).alias("n_images_valid"), F.count_if(~kept).alias("n_images_filtered"))


def edge_density(features: DataFrame, by: list[str] = BY) -> DataFrame:
    out = features.groupBy(*by).agg(*S.summary(F.col("edge_density"), "edge_density"), F.count("edge_density").alias("n_images_valid"))
    return out.withColumn("edge_density_score", 1.0 - F.col("edge_density_mean"))


def self_similarity(features: DataFrame, by: list[str] = BY) -> DataFrame:
    """From `ssi`, one less an image's mean best patch match; images without a patch are NaN and passed over."""
    x = F.when(~F.isnan("ssi"), F.col("ssi"))
    out = features.groupBy(*by).agg(*S.summary(x, "ssi"), F.count(x).alias("n_images_valid"))
    return out.withColumn("ssi_score", 1.0 - F.col("ssi_mean"))


def high_frequency(features: DataFrame, by: list[str] = BY) -> DataFrame:
    """From `hf_share`, the spectrum's part beyond a radius; reported, not scored."""
    return features.groupBy(*by).agg(*S.summary(F.col("hf_share"), "hf_ratio"), F.count("hf_share").alias("n_images_valid"))
