"""Whole evaluations: from folders of images and labels to family scores and one dataset score."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import stats as S
from tessera.operators import annotations as A
from tessera.operators import light as L
from tessera.operators import spatial as P
from tessera.operators import style as Y
from tessera.operators.features import PLACE, image_features
from tessera.sources.images import list_images, ordinals, read_images
from tessera.sources.labels import read_labels
from tessera.sources.paths import folder_size

BY = ["dataset_id"]
FAMILIES = ("spatial", "optical", "style", "annotation")
#: Bytes up to which boxes and names are broadcast to the pixels: label text bounds the boxes, a name counts NAME bytes.
BROADCAST, NAME = 64 << 20, 200
#: Instances below which annotations aren't scored.
LEAST_INSTANCES = 10


@dataclass
class Dataset:
    """The tables that all metrics of one or many splits are computed from."""

    images: DataFrame  # dataset_id, image_id, stem: all listed images
    decoded: DataFrame  # one row an image: the kernel's output, from which the next three come
    boxes: DataFrame  # dataset_id, image_id, ordinal, box_id, cls, cx, cy, bw, bh, w_img, h_img, x1..y2
    features: DataFrame  # readable images
    instances: DataFrame  # one row a box with a crop: cls, cover_ratio_b2, emb
    unreadable: DataFrame
    every_box: DataFrame  # boxes of all listed images, readable or not

    def cache(self) -> Dataset:
        """Keep the kernel's output: every image is then decoded once, whatever is computed."""
        self.decoded.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def release(self) -> None:
        self.decoded.unpersist()


def load(spark: SparkSession, images_dir: str, labels_dir: str, dataset_id: str = "dataset", mode: str = "permissive", embed: Callable | None = None, max_patches: int | None = None, pad_ratio: float = 0.10, **options) -> Dataset:
    """One split of images and labels: load_splits() of it alone."""
    return load_splits(spark, {dataset_id: (images_dir, labels_dir)}, mode, embed, max_patches, pad_ratio, **options)


def load_splits(spark: SparkSession, splits: dict[str, tuple[str, str]], mode: str = "permissive", embed: Callable | None = None, max_patches: int | None = None, pad_ratio: float = 0.10, **options) -> Dataset:
    """Splits by name, each a folder of images and one of labels, as one set of tables.

    An unreadable image raises in mode "strict" and is set apart in "permissive". Labels join images by stem:
    two images of one stem share a label file, label files without an image are not read further. Names and
    ordinals come from the listing; pixels are read by one scan and meet the labels of their image there, the
    boxes being cut with the height and width of the row. Labels and ordinals are broadcast if the folders'
    sizes bound them by BROADCAST, so that pixels aren't shuffled; beyond that they are, once each. `embed`
    turns crops into vectors; without it instances have none.
    """
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    listed = union(list_images(spark, i, name) for name, (i, _) in splits.items())
    if mode == "strict" and (some := listed.where("NOT known").limit(1).collect()):
        raise ValueError(f"unreadable image: {some[0]['image_id']}")
    few_names = NAME * sum(folder_size(spark, i)[1] for i, _ in splits.values()) <= BROADCAST
    few_labels = few_names and sum(folder_size(spark, l)[0] for _, l in splits.values()) <= BROADCAST
    labels = union(read_labels(spark, l, name, mode) for name, (_, l) in splits.items())
    place = F.struct(F.col("line_no").cast("long").alias("box_id"), "cls", *PLACE)
    marks = labels.groupBy("dataset_id", "stem").agg(F.array_sort(F.collect_list(place)).alias("marks"))
    numbers = ordinals(listed)
    rows = union(read_images(spark, i, name) for name, (i, _) in splits.items())
    rows = rows.join(F.broadcast(numbers) if few_names else numbers, ["dataset_id", "image_id"], "left")
    rows = rows.join(F.broadcast(marks) if few_labels else marks, ["dataset_id", "stem"], "left")
    size = [F.col("width").cast("double"), F.col("height").cast("double")]

    def cut(b: Column) -> Column:
        at = G.corners(*(b[c] for c in PLACE), *size)
        crop, tight = G.padded(*at.values(), *size, pad_ratio), G.outward(*at.values(), *size)
        return F.struct(b["box_id"].alias("box_id"), b["cls"].alias("cls"), *(b[c].alias(c) for c in PLACE), F.array(*crop.values()).alias("crop"), F.array(*tight.values()).alias("tight"))

    pixels = rows.select("dataset_id", "image_id", "ordinal", "height", "width", "channels", "data", F.transform("marks", cut).alias("boxes"))
    decoded = image_features(pixels, embed, mode == "strict", **options)
    features = decoded.where("readable").drop("readable")
    details = features.select("dataset_id", "image_id", "ordinal", "height", "width", F.explode("box_details").alias("d"))
    shape = [F.col("width").cast("double").alias("w_img"), F.col("height").cast("double").alias("h_img")]
    boxes = P.with_corners(details.select("dataset_id", "image_id", "ordinal", "d.box_id", "d.cls", *(f"d.{c}" for c in PLACE), *shape))
    instances = details.select("dataset_id", "image_id", "ordinal", "d.*").drop(*PLACE).where("cover_ratio_b2 IS NOT NULL")
    if max_patches is not None:
        from pyspark.sql import Window

        w = Window.partitionBy("dataset_id").orderBy("ordinal", "box_id")
        instances = instances.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_patches).drop("_n")
    images = listed.select("dataset_id", "image_id", "stem")
    every = images.join(labels.select("dataset_id", "stem", "cls", "cx", "cy"), ["dataset_id", "stem"])
    return Dataset(images, decoded, boxes, features, instances, decoded.where("NOT readable").select("dataset_id", "image_id"), every)


def joined(parts: list[DataFrame], by: list[str] = BY) -> DataFrame:
    """One wide row a group from one-row tables; counts that clash keep the first table's."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.drop(*[c for c in p.columns if c in out.columns and c not in by]), by, "full")
    return out


def spatial_metrics(data: Dataset, tau: float = 8.0, c: float = 1.0, cells: int = 8, by: list[str] = BY) -> DataFrame:
    """Every spatial metric, the three group scores and the family's."""
    laps = data.features.select(*by, F.explode("box_details").alias("d")).select(*by, F.col("d.lap").alias("lap"))
    parts = [
        P.scale_variation(data.boxes, by),
        P.position_entropy(data.every_box, by, cells),
        P.detail_insufficiency(laps, by, c),
        P.resampling_loss(data.features, by),
        P.pixel_sufficiency(data.boxes, by, tau),
        P.edge_density(data.features, by),
        P.self_similarity(data.features, by),
        P.high_frequency(data.features, by),
    ]
    return spatial_scores(joined(parts, by))


def spatial_scores(m: DataFrame) -> DataFrame:
    m = m.withColumn("stable_score", S.geo_mean(F.col("scale_score"), F.col("pos_score")))
    m = m.withColumn("info_score", S.geo_mean(F.col("hf_score"), F.col("rs_interp_D_mean"), F.col("px_prob_r_gt_tau")))
    m = m.withColumn("complex_score", S.geo_mean(F.col("edge_density_score"), F.col("ssi_score")))
    return m.withColumn("spatial_score", S.geo_mean(F.col("stable_score"), F.col("info_score"), F.col("complex_score")))


def light_metrics(data: Dataset, by: list[str] = BY) -> DataFrame:
    return joined([L.exposure(data.features, by), L.illumination(data.features, by), L.gradient_concentration(data.features, by), L.directional_loss(data.features, by), L.light_scores(data.features, by)], by)


def style_metrics(data: Dataset, by: list[str] = BY, include_blockiness: bool = True) -> DataFrame:
    return Y.style_scores(data.features, by, include_blockiness)


def annotation_metrics(data: Dataset, embeddings: DataFrame | None = None, k: int = 10, threshold: float = 0.10, expand: float = 0.10, min_per_class: int = 10, by: list[str] = BY) -> DataFrame:
    """Every annotation metric, its scores and the family's.

    Vectors come from `embeddings` (dataset_id, image_id, box_id, emb), or from the instances themselves;
    they are brought to length 1. Fewer than LEAST_INSTANCES instances in a split raise.
    """
    inst = data.instances
    if embeddings is not None:
        inst = inst.drop("emb").join(embeddings.select(*by, "image_id", "box_id", "emb"), [*by, "image_id", "box_id"])
    unit = F.col("emb").cast("array<double>")
    norm = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x))
    inst = inst.withColumn("emb", F.transform(unit, lambda x: x / (norm + S.EPS))).withColumn("uid", F.xxhash64("image_id", "box_id"))
    few = inst.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("emb").alias("e"))
    counts = few.collect()  # a row for each split
    if not counts or any(r["n"] < LEAST_INSTANCES for r in counts):
        raise RuntimeError(f"fewer than {LEAST_INSTANCES} annotated instances")
    if any(r["e"] < r["n"] for r in counts):
        raise RuntimeError("instances without an embedding: give an embeddings table or an embed function")
    tight = data.boxes.join(inst.select(*by, "image_id", "box_id"), [*by, "image_id", "box_id"], "left_semi")
    parts = [
        A.fisher_separability(inst, by).drop("n_classes"),
        A.neighbour_impurity(inst, k, by, "uid"),
        A.split_consistency(tight, threshold, expand, by),
        A.coverage_variation(inst, by, least=min_per_class),
        A.class_distribution(inst, by),
        A.positive_images(data.images, data.every_box, by),
    ]
    m = joined(parts, by)
    return joined([m, A.annotation_scores(m, by)], by)


def dataset_score(spatial: DataFrame, light: DataFrame, style: DataFrame, annotation: DataFrame, by: list[str] = BY) -> DataFrame:
    """The four family scores and their geometric mean."""
    parts = [t.select(*by, f"{k}_score") for k, t in zip(FAMILIES, (spatial, light, style, annotation), strict=True)]
    return joined(parts, by).withColumn("dataset_score", S.geo_mean(*(F.col(f"{k}_score") for k in FAMILIES)))


def check_folders(spark: SparkSession, *folders: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for d in folders:
        path = hadoop(d)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raise FileNotFoundError(d)


def evaluate_splits(spark: SparkSession, splits: dict[str, tuple[str, str]], embeddings: DataFrame | None = None, embed: Callable | None = None, mode: str = "permissive", reference_compat: bool = False, reports: bool = False, **options) -> tuple[dict[str, dict[str, float]], list]:
    """The five scores of each split, and with `reports` every metric as rows (dataset_id, family, metric, value).

    All splits are one job, and each image is decoded once. A component that isn't positive raises; NaN raises
    too, unless reference_compat.
    """
    check_folders(spark, *(d for pair in splits.values() for d in pair))
    data = load_splits(spark, splits, mode, embed, **options).cache()
    try:
        families = spatial_metrics(data), light_metrics(data), style_metrics(data), annotation_metrics(data, embeddings)
        rows = {r["dataset_id"]: r.asDict() for r in dataset_score(*families).collect()}  # a row for each split
        report = reduce(DataFrame.union, (long_form(m, name) for m, name in zip(families, FAMILIES, strict=True))).collect() if reports else []
    finally:
        data.release()
    out = {}
    for name in splits:
        row = rows.get(name, {})
        for k in FAMILIES:
            x = row.get(f"{k}_score")
            if x is None or x <= 0 or (math.isnan(x) and not reference_compat):
                raise ValueError(f"{name}: {k} score is {x}")
        out[name] = {k: v for k, v in row.items() if k.endswith("_score")}
    return out, report


def evaluate_dataset(spark: SparkSession, images_dir: str, labels_dir: str, embeddings: DataFrame | None = None, embed: Callable | None = None, mode: str = "permissive", reference_compat: bool = False) -> dict[str, float]:
    """The five scores of one split: evaluate_splits() of it alone, under the name `dataset`."""
    return evaluate_splits(spark, {"dataset": (images_dir, labels_dir)}, embeddings, embed, mode, reference_compat)[0]["dataset"]


def long_form(metrics: DataFrame, family: str, by: list[str] = BY) -> DataFrame:
    """(dataset_id, family, metric, value): a wide metric table as a report."""
    names = [f.name for f in metrics.schema if f.name not in by and f.dataType.typeName() in ("double", "long", "integer", "float")]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")
    return metrics.select(*by, F.lit(family).alias("family"), pairs).select(*by, "family", "m.metric", "m.value")
