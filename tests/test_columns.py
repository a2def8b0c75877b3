"""Column expressions: geometry, score maps, geometric means; aggregates of nothing."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import stats as S
from tessera.operators import annotations as A
from tessera.operators import spatial as P
from tessera.operators import style as Y

NAN = float("nan")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(
    ("xs", "kw", "want"),
    [((4.0, 9.0), {}, 6.0), ((0.0, 5.0), {}, 0.0), ((-1.0, 5.0), {}, NAN), ((NAN, 5.0), {}, NAN), ((None, 5.0), {}, NAN), ((0.0, 1.0), {"guard": 1e-6}, 1e-3), ((2.0, 1.0), {"guard": 1e-6}, 1.0), ((0.0, 1.0), {"plus": 1e-12}, 1e-6)],
)
def test_geo_mean(spark, xs, kw, want):
    got = value(spark, S.geo_mean(*(F.lit(x).cast("double") for x in xs), **kw))
    assert math.isnan(got) if math.isnan(want) else got == pytest.approx(want)


def test_halves_round_to_even(spark):
    got = [value(spark, G.clamp_int(F.lit(x), F.lit(0).cast("long"), F.lit(10).cast("long"))) for x in (0.5, 1.5, 2.5, -3.0, 99.0)]
    assert got == [0, 2, 2, 0, 10]


def test_iou_is_symmetric_and_bounded(spark):
    a = {k: F.lit(float(v)) for k, v in zip(G.CORNERS, (0, 0, 10, 10), strict=True)}
    b = {k: F.lit(float(v)) for k, v in zip(G.CORNERS, (5, 5, 15, 15), strict=True)}
    far = {k: F.lit(float(v)) for k, v in zip(G.CORNERS, (50, 50, 60, 60), strict=True)}
    assert value(spark, G.iou(a, b)) == value(spark, G.iou(b, a)) == pytest.approx(25 / 175)
    assert value(spark, G.iou(a, a)) == pytest.approx(1) and value(spark, G.iou(a, far)) == 0


def boxes(spark, rows):
    return spark.createDataFrame(rows, "dataset_id string, image_id string, box_id long, cls int, cx double, cy double, bw double, bh double, w_img double, h_img double")


def test_scale_keeps_boxes_without_area_and_min_pixel_does_not(spark):
    b = boxes(spark, [("d", "i", 1, 0, 0.5, 0.5, 0.1, 0.4, 100.0, 100.0), ("d", "i", 2, 0, 0.5, 0.5, 0.0, 0.4, 100.0, 100.0)])
    row = P.scale_variation(b).collect()[0]
    assert row["n_bboxes"] == 2 and row["scale_mu"] == pytest.approx(10)
    assert P.pixel_sufficiency(b).collect()[0]["n_bboxes_valid"] == 1


def test_many_splits_in_one_job(spark):
    rows = [(f"d{k}", f"i{j}", j, j % 2, 0.1 * j, 0.2, 0.1 * (k + 1), 0.2, 100.0, 100.0) for k in range(3) for j in range(5)]
    got = {r["dataset_id"]: r for r in P.scale_variation(boxes(spark, rows)).collect()}
    assert len(got) == 3 and got["d1"]["scale_mu"] > got["d0"]["scale_mu"]


def test_component_sizes():
    assert A.component_sizes([]) == []
    assert A.component_sizes([(1, 2), (2, 3), (7, 8)]) == [2, 3]


def test_split_consistency_of_touching_boxes(spark):
    rows = [("d", "i", k, 0, 0.1 + 0.05 * k, 0.5, 0.1, 0.1, 100.0, 100.0) for k in range(4)] + [("d", "i", 9, 1, 0.1, 0.5, 0.1, 0.1, 100.0, 100.0)]
    row = A.split_consistency(P.with_corners(boxes(spark, rows))).collect()[0]
    assert (row["n_components"], row["max_size"]) == (2, 4)
    assert row["A_split"] == pytest.approx(1.5 / 2.5)


def test_lone_class_and_lone_vector(spark):
    x = spark.createDataFrame([("d", 1, 0, [1.0, 0.0])], "dataset_id string, box_id long, cls int, emb array<double>")
    assert A.neighbour_impurity(x).collect()[0]["A_imp"] == 0
    assert not A.fisher_separability(x).collect()[0]["comparable"]
    row = A.class_distribution(x).collect()[0]
    assert (row["H_norm"], row["N_eff_norm"]) == (1, 1)


def test_neighbours_in_blocks_equal_one_block(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("d", k, int(rng.integers(3)), [float(v) for v in rng.normal(size=4)]) for k in range(60)]
    rows += [("d", 100 + k, 1, rows[k][3]) for k in range(5)]  # ties
    x = spark.createDataFrame(rows, "dataset_id string, box_id long, cls int, emb array<double>")
    one, many = (sorted((r["id"], r["rank"], r["near_id"]) for r in A.nearest(x, 5, block=b).collect()) for b in (2048, 7))
    assert one == many and len(one) == 65 * 5


def test_aggregates_do_not_depend_on_order(spark, sf_dir):
    from tessera import catalog

    x = catalog.instances(spark, sf_dir)
    a = Y.dispersion(x, "emb", "C").collect()[0]["C"]
    assert Y.dispersion(x.orderBy(F.rand(1)), "emb", "C").collect()[0]["C"] == pytest.approx(a)
