"""Annotation consistency: separability, neighbour purity, splitting, coverage and balance of classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import stats as S
from tessera.operators.vectors import moments

BY = ["dataset_id"]
#: Vectors in a block of the neighbour search.
BLOCK = 2048
#: Digits to which similarities are compared, so that equal vectors tie whatever the order of sums; ties go to the lower id.
DIGITS = 9


def fisher_separability(instances: DataFrame, by: list[str] = BY, emb: str = "emb", cls: str = "cls") -> DataFrame:
    """Between-class over within-class scatter; the overall mean counts all rows, the scatters classes of two or more.

    One pass, with means and squared deviations of whole vectors summed in tasks. `comparable` tells whether any
    class counts while there is another: otherwise the value is 0 but for rounding.
    """
    x = instances.select(*by, F.col(cls).alias("c"), F.col(emb).alias("e"))
    g = moments(x, "e", [*by, "c"])
    total = F.aggregate("gs", F.lit(0).cast("long"), lambda s, r: s + r["n"])
    weigh = lambda r, k: F.transform(r["mean"], lambda m: m * r["n"] / k)
    # One row a class is gathered for each group.
    out = g.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("c", "n", "mean", "dev"))).alias("gs")).withColumn("n", total)
    first = weigh(F.col("gs")[0], F.col("n"))
    out = out.withColumn("mu", F.aggregate(F.slice("gs", F.lit(2), F.greatest(F.size("gs") - 1, F.lit(0))), first, lambda s, r: F.zip_with(s, weigh(r, F.col("n")), lambda a, b: a + b)))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    big = F.filter("gs", lambda r: r["n"] >= 2)
    between = lambda r: r["n"] * add(F.zip_with(r["mean"], "mu", lambda m, mu: (m - mu) * (m - mu)))
    out = out.withColumns({"sw": F.aggregate(big, F.lit(0.0), lambda s, r: s + add(r["dev"])), "sb": F.aggregate(big, F.lit(0.0), lambda s, r: s + between(r))})
    comparable = (F.size(big) > 0) & (F.size("gs") > 1)
    return out.select(*by, (F.col("sb") / (F.col("sw") + S.EPS)).alias("A_sep"), comparable.alias("comparable"), F.size("gs").cast("long").alias("n_classes"))


def nearest(instances: DataFrame, k: int = 10, by: list[str] = BY, id_col: str = "box_id", emb: str = "emb", cls: str = "cls", block: int = BLOCK) -> DataFrame:
    """(by, id, cls, rank, near_id, near_cls, similarity): the k nearest others of each vector by inner product.

    Exact. Vectors are packed into blocks, and each pair of blocks is dealt out as a unit: a task multiplies
    one with the other, once for both, and keeps the k best of each row; the pairs' best are merged, by
    partial limits before they are shuffled. Similarities are compared rounded, ties go to the lower id.
    """
    x = instances.select(*by, F.col(id_col).cast("long").alias("id"), F.col(cls).alias("c"), F.col(emb).cast("array<double>").alias("v"))
    n = x.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    packed = x.join(n, by).groupBy(*by, "blocks", F.pmod(F.xxhash64("id"), "blocks").alias("block")).agg(F.collect_list("id").alias("ids"), F.collect_list(F.col("c").cast("string")).alias("cs"), F.collect_list("v").alias("vs"))
    pairs = packed.withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select(*by, F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"), "block", "ids", "cs", "vs")
    pairs = pairs.repartition(*by, "i", "j").sortWithinPartitions(*by, "i", "j", "block")
    keys = [f"{f.name} {f.dataType.simpleString()}" for f in x.select(*by).schema]

    def best_of(similar: np.ndarray, ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, similarity) of the k best others of each row."""
        similar = np.where(ids[:, None] == near, -np.inf, similar)
        order = np.argsort(near)
        top = order[np.argsort(-similar[:, order], axis=1, kind="stable")[:, : min(k, len(near))]]
        value = np.take_along_axis(similar, top, 1).ravel()
        ok = value > -np.inf
        return np.repeat(np.arange(len(ids)), top.shape[1])[ok], top.ravel()[ok], value[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                key = [row.column(c)[0].as_py() for c in (*by, "i", "j")]
                own = [np.array(row.column("ids")[0].as_py()), np.array(row.column("cs")[0].as_py(), object), np.array(row.column("vs")[0].as_py())]
                sides = [(own, own)] if key[-2] == key[-1] else []
                if held is not None and held[0] == key:
                    sides = [(held[1], own), (own, held[1])]
                held = (key, own)
                product = np.round(sides[0][0][2] @ sides[0][1][2].T, DIGITS) if sides else None
                for (ids, cs, _), (near, near_cs, _) in sides:
                    who, to, value = best_of(product, ids, near)
                    product = product.T
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([v] * len(who), row.schema.field(b).type) for v, b in zip(key, by, strict=False)), pa.array(ids[who]), pa.array(cs[who], pa.string()), pa.array(near[to]), pa.array(near_cs[to], pa.string()), pa.array(value)],
                        names=[*by, "id", "cls", "near_id", "near_cls", "similarity"],
                    )

    from pyspark.sql import Window

    found = pairs.mapInArrow(run, ", ".join([*keys, "id long, cls string, near_id long, near_cls string, similarity double"]))
    w = Window.partitionBy(*by, "id").orderBy(F.col("similarity").desc(), "near_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbour_impurity(instances: DataFrame, k: int = 10, by: list[str] = BY, id_col: str = "box_id", emb: str = "emb", cls: str = "cls") -> DataFrame:
    """One less the mean share of a vector's k nearest others that have its class; a lone vector: 0."""
    near = nearest(instances, k, by, id_col, emb, cls)
    share = near.groupBy(*by, "id").agg(F.avg((F.col("near_cls") == F.col("cls")).cast("double")).alias("same"))
    out = share.groupBy(*by).agg((1.0 - F.sum("same") / (F.count(F.lit(1)) + S.EPS)).alias("A_imp"))
    return instances.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items")).join(out, by, "left").withColumn("A_imp", F.coalesce("A_imp", F.lit(0.0)))


def overlapping_pairs(boxes: DataFrame, threshold: float = 0.10, expand: float = 0.10, by: list[str] = BY) -> DataFrame:
    """(by, image_id, cls, a, b, iou): boxes of one class and image whose grown boxes overlap enough, a before b."""
    grown = boxes.select(*by, "image_id", "cls", "box_id", *(c.alias(k) for k, c in G.expanded(*(F.col(k) for k in G.CORNERS), expand).items()))
    x, y = grown.alias("x"), grown.alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*by, "image_id", "cls")]
    both = x.join(y, [*on, F.col("x.box_id") < F.col("y.box_id")])
    value = G.iou({k: F.col(f"x.{k}") for k in G.CORNERS}, {k: F.col(f"y.{k}") for k in G.CORNERS})
    out = both.select(*(F.col(f"x.{c}") for c in (*by, "image_id", "cls")), F.col("x.box_id").alias("a"), F.col("y.box_id").alias("b"), value.alias("iou"))
    return out.where(F.col("iou") >= threshold)


def component_sizes(pairs: list[tuple[int, int]]) -> list[int]:
    """Sizes of the components that the pairs tie together."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    sizes: dict[int, int] = {}
    for x in list(root):
        r = find(x)
        sizes[r] = sizes.get(r, 0) + 1
    return sorted(sizes.values())


def split_consistency(boxes: DataFrame, threshold: float = 0.10, expand: float = 0.10, by: list[str] = BY) -> DataFrame:
    """Spread of the sizes of overlapping components over all images and classes; under two components: 0.

    Only groups with an overlap reach Python; boxes without one are components of one, which are counted.
    """
    pairs = overlapping_pairs(boxes, threshold, expand, by)
    groups = pairs.groupBy(*by, "image_id", "cls").agg(F.collect_list(F.struct("a", "b")).alias("pairs")).select(*by, "pairs")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.select(*by).schema)

    def sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [component_sizes([(p["a"], p["b"]) for p in row]) for row in batch.column("pairs").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(b) for b in by), pa.array(sizes, pa.list_(pa.int64()))], names=[*by, "sizes"])

    tied = groups.mapInArrow(sizes_of, f"{keys}, sizes array<long>").select(*by, F.explode("sizes").alias("s"))
    tied = tied.groupBy(*by).agg(F.count("s").alias("k"), F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2"), F.max("s").alias("most"))
    out = boxes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_boxes")).join(tied, by, "left")
    lone = F.col("n_boxes") - F.coalesce("s1", F.lit(0))
    out = out.withColumn("n_components", (lone + F.coalesce("k", F.lit(0))).cast("long"))
    mean = F.col("n_boxes") / F.col("n_components")
    var = (lone + F.coalesce("s2", F.lit(0))) / F.col("n_components") - mean * mean
    cv = F.sqrt(F.greatest(var, F.lit(0.0))) / (mean + S.EPS)
    return out.select(*by, "n_components", F.coalesce("most", F.lit(1)).cast("long").alias("max_size"), F.when(F.col("n_components") < 2, 0.0).otherwise(cv).alias("A_split"))


def coverage_variation(instances: DataFrame, by: list[str] = BY, column: str = "cover_ratio_b2", least: int = 10) -> DataFrame:
    """Mean over classes of `least` members or more of the spread of their coverage; no such class: 0."""
    c = instances.groupBy(*by, "cls").agg(F.count(column).alias("n"), S.variation(F.col(column)).alias("cv"))
    return c.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("n") >= least, F.col("cv"))), F.lit(0.0)).alias("A_b2"), F.count_if(F.col("n") >= least).alias("n_classes_used"))


def class_distribution(instances: DataFrame, by: list[str] = BY, cls: str = "cls") -> DataFrame:
    """Normalised entropy and effective share of the classes; a lone class: 1 and 1."""
    c = instances.groupBy(*by, F.col(cls).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    a = c.groupBy(*by).agg(F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_classes"), F.array_sort(F.collect_list("n")).alias("ns"))
    p = lambda n: n / (F.col("n_items") + S.EPS)
    h = F.aggregate("ns", F.lit(0.0), lambda s, n: s + S.entropy_term(p(n)))
    square = F.aggregate("ns", F.lit(0.0), lambda s, n: s + p(n) * p(n))
    one = F.col("n_classes") <= 1
    return a.select(
        *by,
        "n_items",
        "n_classes",
        F.when(one, 1.0).otherwise(h / (F.log(F.col("n_classes").cast("double")) + S.EPS)).alias("H_norm"),
        F.when(one, 1.0).otherwise(1.0 / (square + S.EPS) / F.col("n_classes")).alias("N_eff_norm"),
    )


def positive_images(images: DataFrame, boxes: DataFrame, by: list[str] = BY) -> DataFrame:
    """Share of images with a label; no images: no row."""
    with_box = boxes.select(*by, "image_id").distinct().withColumn("has", F.lit(1.0))
    out = images.select(*by, "image_id").join(with_box, [*by, "image_id"], "left")
    return out.groupBy(*by).agg(F.count(F.lit(1)).alias("n_images"), F.sum(F.coalesce("has", F.lit(0.0))).cast("long").alias("n_positive"), F.avg(F.coalesce("has", F.lit(0.0))).alias("P_img"))


def annotation_scores(metrics: DataFrame, by: list[str] = BY) -> DataFrame:
    """From A_sep, comparable, A_imp, A_split, A_b2, N_eff_norm and P_img: six scores and their geometric mean.

    A separability of exactly nothing scores 1: no second class to be told apart.
    """
    s = metrics.select(
        *by,
        F.when(~F.col("comparable"), 1.0).otherwise(F.col("A_sep") / (1.0 + F.col("A_sep"))).alias("sep_score"),
        (1.0 - F.col("A_imp")).alias("imp_score"),
        S.falling(F.col("A_split")).alias("split_score"),
        S.falling(F.col("A_b2")).alias("b2_score"),
        F.col("N_eff_norm").alias("class_score"),
        F.col("P_img").alias("p_img_score"),
    )
    return s.withColumn("annotation_score", S.geo_mean(*(F.col(f"{k}_score") for k in ("sep", "imp", "split", "b2", "class", "p_img")), plus=1e-12))
