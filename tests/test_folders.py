"""Folders of images and labels, end to end."""

import math

import numpy as np
import pytest

from tessera.functions import kernels as K
from tessera.operators.features import SCALARS
from tessera.plans.evaluate import annotation_metrics, dataset_score, evaluate_dataset, light_metrics, load, long_form, spatial_metrics, style_metrics
from tessera.sources.images import list_images, ordinals, quarantine, read_images
from tessera.sources.labels import parse_lines, read_labels
from tests.conftest import png

EDGES = "\n\n0 .5 .5 .2\n1.0 0.5 0.5 0.2 0.2 9 9 9\r\n-0.9 .4 .4 .1 .1\n2 1.2 -0.1 .3 .3\n"


def texture(rng, h=96, w=96):
    y, x = np.indices((h, w))
    img = 120 + 40 * np.sin(x / 7) + 30 * np.cos(y / 5) + rng.normal(0, 12, (h, w))
    return np.clip(np.stack([img, img + 10, img - 15], -1), 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("split")
    (root / "images").mkdir()
    (root / "labels").mkdir()
    rng = np.random.default_rng(1)
    for k, name in enumerate(("a", "b c#é", "x+y", "p.q")):
        (root / "images" / f"{name}.png").write_bytes(png(texture(rng)))
        lines = [f"{j % 2} {0.2 + 0.15 * j:.3f} {0.3 + 0.1 * k:.3f} {0.15 + 0.03 * j:.3f} 0.25" for j in range(4)]
        (root / "labels" / f"{name}.txt").write_text("\n".join(lines))
    (root / "images" / "none.png").write_bytes(png(texture(rng)))
    (root / "images" / "bad.png").write_bytes(b"\0\1")
    (root / "images" / "note.txt").write_text("not an image")
    (root / "labels" / "orphan.txt").write_text("0 .5 .5 .5 .5")
    return root


def embed(crops):
    return [[c.mean(), c.std(), c[..., 0].mean(), 1.0] for c in crops]


def test_label_lines(spark):
    got = parse_lines(spark.createDataFrame([(x,) for x in EDGES.split("\n")], "line string")).collect()
    assert [(r["cls"], r["cx"]) for r in got] == [(1, 0.5), (0, 0.4), (2, 1.2)]


def test_strict_labels_raise(spark):
    lines = spark.createDataFrame([("a b c d e",)], "line string")
    assert parse_lines(lines).count() == 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        parse_lines(lines, "strict").collect()


def test_names_and_pixels(spark, folders):
    listed = read_images(spark, str(folders / "images"), "d")
    assert {r["image_id"] for r in quarantine(listed).collect()} == {"bad.png"}
    names = list_images(spark, str(folders / "images"), "d")
    assert names.count() == 6 and {r["image_id"] for r in names.where("NOT known").collect()} == {"bad.png"}
    rows = listed.join(ordinals(names), ["dataset_id", "image_id"]).orderBy("ordinal").collect()
    assert [r["stem"] for r in rows] == ["a", "b c#é", "none", "p.q", "x+y"]
    bgr = np.frombuffer(rows[0]["data"], np.uint8).reshape(96, 96, 3)
    assert (bgr[..., ::-1] == texture(np.random.default_rng(1))).all()
    assert {r["stem"] for r in read_labels(spark, str(folders / "labels")).select("stem").distinct().collect()} == {"a", "b c#é", "x+y", "p.q", "orphan"}


def test_two_images_share_a_label_file(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "l").mkdir()
    img = texture(np.random.default_rng(2), 40, 40)
    (tmp_path / "i" / "a.png").write_bytes(png(img))
    (tmp_path / "i" / "a.PNG").write_bytes(png(img))
    (tmp_path / "l" / "a.txt").write_text("0 .5 .5 .5 .5\n")
    data = load(spark, str(tmp_path / "i"), str(tmp_path / "l"))
    assert data.boxes.count() == 2 and data.instances.count() == 2


def test_features_equal_the_kernels(spark, folders):
    data = load(spark, str(folders / "images"), str(folders / "labels"), columns=tuple(c for c in SCALARS if c != "ssi"))
    row = data.features.where("image_id = 'a.png'").collect()[0]
    bgr = texture(np.random.default_rng(1))[..., ::-1]
    gray = K.gray_of(bgr)
    assert row["lap0"] == pytest.approx(K.mean_abs_laplacian(gray / 255))
    assert row["goe"] == pytest.approx(K.orientation_concentration(gray / 255))
    assert row["noise"] == pytest.approx(K.residual_energy(gray))
    assert len(row["box_details"]) == 4 and row["ssi"] is None


def test_whole_evaluation(spark, folders):
    args = (str(folders / "images"), str(folders / "labels"))
    data = load(spark, *args, embed=embed).cache()
    spatial, light, style = spatial_metrics(data), light_metrics(data), style_metrics(data)
    annotation = annotation_metrics(data)
    row = dataset_score(spatial, light, style, annotation).collect()[0]
    families = [row[f"{k}_score"] for k in ("spatial", "optical", "style", "annotation")]
    assert all(0 < x <= 1 for x in families)
    assert row["dataset_score"] == pytest.approx(math.prod(families) ** 0.25)
    a = annotation.collect()[0]
    assert a["n_items"] == 16 and a["P_img"] == pytest.approx(4 / 6)
    scores = evaluate_dataset(spark, *args, embed=embed)
    assert scores["dataset_score"] == pytest.approx(row["dataset_score"])
    assert long_form(style, "style").where("metric = 'C_color'").count() == 1
    # The same by hand from the features.
    f = data.features.collect()
    d = [1 - r["lap1"] / (r["lap0"] + 1e-12) for r in f if r["lap0"] >= 0.005]
    assert spatial.collect()[0]["rs_interp_D_mean"] == pytest.approx(np.mean(d))
    color = np.array([r["color"] for r in f])
    assert style.collect()[0]["C_color"] == pytest.approx(np.linalg.norm(color - color.mean(0), axis=1).mean())


def test_images_are_decoded_once(spark, folders):
    """Whatever is computed of a kept data set: one scan of images, one run of the kernel."""
    runs = spark.sparkContext.accumulator(0)

    def counting(crops):
        runs.add(1)
        return embed(crops)

    data = load(spark, str(folders / "images"), str(folders / "labels"), embed=counting).cache()
    for table in (spatial_metrics(data), light_metrics(data), style_metrics(data), annotation_metrics(data), data.boxes, data.unreadable):
        table.collect()
    assert runs.value == 4  # images with boxes
    assert data.decoded._jdf.queryExecution().optimizedPlan().toString().count("Relation [image") <= 1
    plan = load(spark, str(folders / "images"), str(folders / "labels")).decoded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan image") == 1
    names = data.images._jdf.queryExecution().executedPlan().toString()
    assert "FileScan image" not in names and "content" not in names
    data.release()


def test_splits_in_one_job(spark, folders, capsys, tmp_path):
    from tessera.operators.extract import extractor
    from tessera.plans import cli
    from tessera.plans.evaluate import evaluate_splits

    args = str(folders / "images"), str(folders / "labels")
    one = evaluate_splits(spark, {"a": args}, embed=extractor(cli.STAND_IN, 3))[0]["a"]
    both, report = evaluate_splits(spark, {"a": args, "b": args}, embed=extractor(cli.STAND_IN), reports=True)
    assert all(both[k][n] == pytest.approx(one[n]) for k in "ab" for n in one)
    assert {(r["dataset_id"], r["family"]) for r in report} == {(d, f) for d in "ab" for f in ("spatial", "optical", "style", "annotation")}
    cli.main(["--images", args[0], "--labels", args[1], "--reports", "--set", "ssi_radius=30"])
    lines = capsys.readouterr()
    assert any(x.startswith("dataset_score: ") for x in lines.out.splitlines()) and "dataset style C_tex: " in lines.out and "no network" in lines.err
    with pytest.raises(TypeError, match="unknown options"):
        load(spark, *args, no_such=1)


def test_network_input():
    rng = np.random.default_rng(4)
    flat = np.full((50, 30, 3), (10, 20, 30), np.uint8)
    x = K.network_input([flat, rng.integers(0, 256, (448, 448, 3)).astype(np.uint8)])
    assert x.shape == (2, 3, 224, 224) and x.dtype == np.float32
    assert np.allclose(x[0].mean((1, 2)), [(v / 255 - m) / d for v, m, d in zip((30, 20, 10), K.MEAN, K.DEVIATION, strict=True)], atol=1e-5)
    # Twice as large: weights 1, 3, 3, 1 of four samples a side.
    img = rng.integers(0, 256, (8, 8, 1)).astype(np.uint8)
    got = K.resize_smooth(img, 4, 4)[..., 0].astype(int)
    w = np.array([1, 3, 3, 1]) / 8
    assert abs(got[1, 1] - w @ img[1:5, 1:5, 0] @ w) <= 1


def test_errors(spark, folders):
    args = (str(folders / "images"), str(folders / "labels"))
    with pytest.raises(FileNotFoundError):
        evaluate_dataset(spark, args[0], args[1] + "-none")
    with pytest.raises(ValueError, match="unreadable"):
        load(spark, *args, mode="strict")
    with pytest.raises(RuntimeError, match="embedding"):
        annotation_metrics(load(spark, *args, columns=()))
    with pytest.raises(RuntimeError, match="fewer than"):
        annotation_metrics(load(spark, *args, columns=(), max_patches=3, embed=embed))


def test_label_stream(spark, folders, tmp_path):
    from tessera.streaming.labels import position_counts, stream_labels

    q = position_counts(stream_labels(spark, str(folders / "labels"), "d")).writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM cells").collect()[0]["n"] == 17
