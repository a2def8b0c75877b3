"""More registered queries over the proxies of tessera.catalog: whole metrics, families' scores and the data set's."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import BLUR, BOXES, GRADIENTS, LAPLACIAN, ORACLES, PATTERNS, PIXELS, QUERIES, boxes, filtered, instances, pixels, query, rounded
from tessera.functions import geometry as G
from tessera.functions import kernels as K
from tessera.operators import annotations as A
from tessera.operators import light as L
from tessera.operators import spatial as P
from tessera.operators import style as Y
from tessera.operators.features import image_features
from tessera.plans import evaluate as E

BY = ["dataset_id"]


def features(spark: SparkSession, sf_dir: str, *columns: str, **options) -> DataFrame:
    return image_features(pixels(spark, sf_dir), columns=columns, **options)


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proxy images in colour: blue is the gray level v, green 255 - v, red 7 v modulo 256."""
    images = pixels(spark, sf_dir)
    level = lambda k: F.conv(F.substring(F.hex("data"), 2 * k + 1, 2), 16, 10).cast("int")
    pair = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    each = F.transform(F.transform(F.sequence(F.lit(0), F.lit(63)), level), lambda v: F.concat(pair(v), pair(255 - v), pair(v * 7 % 256)))
    return images.withColumn("data", F.unhex(F.array_join(each, ""))).withColumn("channels", F.lit(3))


def within(name: str) -> str:
    """A registered query's SQL as a table expression."""
    return f"{name} AS ({ORACLES[name]})"


def summary_sql(column: str, name: str, source: str) -> str:
    return f"round(avg({column}), 6) AS {name}_mean, round(quantile_cont({column}, 0.1), 6) AS {name}_L10, round(quantile_cont({column}, 0.9), 6) AS {name}_L90, count({column})::BIGINT AS n_images_valid FROM {source}"


# Space.

RESAMPLED = f"""small AS (SELECT image_id, x // 2 AS x, y // 2 AS y, avg(v) AS v FROM px GROUP BY ALL),
lin(i, j, w) AS (SELECT i, lo + k, CASE k WHEN 0 THEN 1 - t ELSE t END FROM (
  SELECT i, least(floor(pos), 2)::INT AS lo, pos - least(floor(pos), 2) AS t FROM (SELECT i, greatest(0, least((i + 0.5::DOUBLE) * 0.5 - 0.5, 3)) AS pos FROM range(8) r(i))), range(2) s(k)),
up AS (SELECT s.image_id, a.i AS x, b.i AS y, sum(a.w * b.w * s.v) AS v FROM small s JOIN lin a ON a.j = s.x JOIN lin b ON b.j = s.y GROUP BY ALL),
{filtered("lap_up", "VALUES (-1,-1,2.0::DOUBLE), (1,-1,2.0), (0,0,-8.0), (-1,1,2.0), (1,1,2.0)", source="up")},
kept AS (SELECT a.image_id, lap0, lap1 FROM (SELECT image_id, avg(abs(v)) / 255 AS lap0 FROM lap GROUP BY image_id) a JOIN (SELECT image_id, avg(abs(v)) / 255 AS lap1 FROM lap_up GROUP BY image_id) b USING (image_id))"""


@query(f"""WITH {PIXELS}, {LAPLACIAN}, {RESAMPLED}
SELECT 'all' AS dataset_id, round(avg(1 - lap1 / (lap0 + 1e-12)) FILTER (WHERE lap0 >= 0.5), 6) AS rs_interp_D_mean, count(*) FILTER (WHERE lap0 >= 0.5)::BIGINT AS n_images_valid,
  count(*) FILTER (WHERE lap0 < 0.5)::BIGINT AS n_images_filtered FROM kept""")
def resampling_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit that some of the proxy images fall below."""
    return rounded(P.resampling_loss(features(spark, sf_dir, "lap0", "lap1"), least=0.5))


SLOPE = math.tan(math.pi / 8)
AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
NEIGHBOUR = {d: f"n{k}" for k, d in enumerate(AROUND)}
CANNY = f"""steep AS (SELECT image_id, x, y, gx.v AS gx, gy.v AS gy, abs(gx.v) + abs(gy.v) AS m FROM gx JOIN gy USING (image_id, x, y)),
around AS (
  SELECT s.*, {", ".join(f"coalesce(max(n.m) FILTER (WHERE n.x = s.x + {dx} AND n.y = s.y + {dy}), 0) AS {name}" for (dx, dy), name in NEIGHBOUR.items())}
  FROM steep s JOIN steep n ON n.image_id = s.image_id AND abs(n.x - s.x) <= 1 AND abs(n.y - s.y) <= 1 GROUP BY ALL),
weak AS (
  SELECT image_id, x, y, m FROM around WHERE m > 100 AND CASE
    WHEN abs(gy) < {SLOPE!r}::DOUBLE * abs(gx) THEN m > {NEIGHBOUR[-1, 0]} AND m >= {NEIGHBOUR[1, 0]}
    WHEN abs(gy) > {SLOPE + 2!r}::DOUBLE * abs(gx) THEN m > {NEIGHBOUR[0, -1]} AND m >= {NEIGHBOUR[0, 1]}
    WHEN gx * gy >= 0 THEN m > {NEIGHBOUR[-1, -1]} AND m > {NEIGHBOUR[1, 1]} ELSE m > {NEIGHBOUR[1, -1]} AND m > {NEIGHBOUR[-1, 1]} END),
edges AS (SELECT image_id, x, y FROM weak WHERE m > 200 UNION SELECT w.image_id, w.x, w.y FROM edges e JOIN weak w ON w.image_id = e.image_id AND abs(w.x - e.x) <= 1 AND abs(w.y - e.y) <= 1),
density AS (SELECT p.image_id, count(e.x) / (64 + 1e-12::DOUBLE) AS d FROM px p LEFT JOIN edges e USING (image_id, x, y) GROUP BY p.image_id)"""


@query(f"""WITH RECURSIVE {PIXELS}, {GRADIENTS}, {CANNY}
SELECT 'all' AS dataset_id, {summary_sql("d", "edge_density", "density").replace(" FROM density", "")}, round(1 - avg(d), 6) AS edge_density_score FROM density""")
def edge_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.edge_density(features(spark, sf_dir, "edge_density")))


SPECTRUM = """waves(k, i, c, s) AS (SELECT k, i, cos(2 * pi() * k * i / 8), sin(2 * pi() * k * i / 8) FROM range(-4, 4) a(k), range(8) b(i)),
across AS (SELECT image_id, y, k, sum(v / 255 * c) AS re, -sum(v / 255 * s) AS im FROM px JOIN waves ON i = x GROUP BY ALL),
power AS (SELECT image_id, a.k AS kx, w.k AS ky, sum(re * c + im * s) ^ 2 + sum(im * c - re * s) ^ 2 AS p FROM across a JOIN waves w ON i = y GROUP BY ALL),
high AS (SELECT image_id, sum(p) FILTER (WHERE sqrt(kx * kx + ky * ky) >= 0.55 * sqrt(32)) / (sum(p) + 1e-12) AS share FROM power GROUP BY image_id)"""


@query(f"WITH {PIXELS}, {SPECTRUM} SELECT 'all' AS dataset_id, {summary_sql('share', 'hf_ratio', 'high')}")
def hf_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.high_frequency(features(spark, sf_dir, "hf_share")))


@query(f"WITH {PIXELS}, {SPECTRUM} SELECT 'all' AS dataset_id, {summary_sql('share', 'ssi', 'high').replace(' FROM high', '')}, round(1 - avg(share), 6) AS ssi_score FROM high")
def self_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric over a proxy: patches are sampled by numpy's generator, which SQL doesn't have, and so the spectrum's share stands for an image's dissimilarity."""
    return rounded(P.self_similarity(features(spark, sf_dir, "hf_share").withColumn("ssi", F.col("hf_share"))))


MATCH = """windows AS (
  SELECT p.image_id, o.x AS wx, o.y AS wy, p.x - o.x AS i, p.y - o.y AS j, p.v - avg(p.v) OVER (PARTITION BY p.image_id, o.x, o.y) AS z
  FROM px p JOIN (SELECT a.x, b.y FROM range(1, 5) a(x), range(1, 5) b(y)) o ON p.x BETWEEN o.x AND o.x + 2 AND p.y BETWEEN o.y AND o.y + 2),
matches AS (
  SELECT t.image_id, w.wx, w.wy, sum(t.z * w.z) / sqrt(sum(t.z * t.z) * sum(w.z * w.z)) AS c FROM windows t JOIN windows w USING (image_id, i, j)
  WHERE t.wx = 3 AND t.wy = 3 AND greatest(abs(w.wx - 3), abs(w.wy - 3)) > 1 GROUP BY ALL)"""


@query(f"WITH {PIXELS}, {MATCH} SELECT image_id::VARCHAR AS image_id, round((max(c) + 1) / 2, 6) AS best FROM matches GROUP BY image_id")
def patch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best correlation of the patch of three samples a side around (4, 4) with those two before it to one after it, as an odd patch has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grays = [np.frombuffer(d, np.uint8).reshape(8, 8) for d in batch.column("data").to_pylist()]
            best = [float(K.best_matches(g, np.array([[4, 4]]), 3, 2, 1)[0]) for g in grays]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(best, pa.float64())], names=["image_id", "best"])

    return rounded(pixels(spark, sf_dir).select("image_id", "data").mapInArrow(run, "image_id string, best double"))


@query(f"""WITH {BOXES}, half AS (
  SELECT greatest(0, least((cx + s * bw / 4) * w_img, w_img)) AS x, greatest(0, least((cy + s * bh / 4) * h_img, h_img)) AS y, s, image_id, box_id FROM x1, (VALUES (-1), (1)) t(s)),
r AS (SELECT a.image_id, CASE WHEN b.x > a.x AND b.y > a.y THEN least(b.x - a.x, b.y - a.y) END AS r FROM half a JOIN half b ON a.image_id = b.image_id AND a.box_id = b.box_id AND a.s = -1 AND b.s = 1)
SELECT 'all' AS dataset_id, count(r)::BIGINT AS n_bboxes_valid, round(avg((r > 8)::INT), 6) AS px_prob_r_gt_tau FROM r""")
def min_pixel_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of half their sides."""
    return rounded(P.pixel_sufficiency(boxes(spark, sf_dir), shrink=0.5))


SHRUNK = f"""half AS (SELECT image_id, x // 2 AS x, y // 2 AS y, round_even(avg(v), 0) AS v FROM px GROUP BY ALL),
{filtered("lap_half", "VALUES (-1,-1,2.0::DOUBLE), (1,-1,2.0), (0,0,-8.0), (-1,1,2.0), (1,1,2.0)", source="half", last=3)}"""


@query(f"WITH {PIXELS}, {SHRUNK} SELECT image_id::VARCHAR AS image_id, round(var_pop(v), 6) AS lap_var FROM lap_half GROUP BY image_id")
def shrunk_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness of images brought to a longer side of four samples."""
    return rounded(features(spark, sf_dir, "lap_var", long_side=4).select("image_id", "lap_var"))


# Light.


def exposed(source: str, level: str = "v") -> str:
    return f"""exposed AS (SELECT image_id, avg(({level} >= 230)::INT) AS R_over, coalesce(avg({level} / 255 - 0.9) FILTER (WHERE {level} >= 230), 0)::DOUBLE AS I_over,
  avg(({level} <= 12)::INT) AS R_under, coalesce(avg(0.05 - {level} / 255) FILTER (WHERE {level} <= 12), 0)::DOUBLE AS I_under FROM {source} GROUP BY image_id)"""


EXPOSURE = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(quantile_cont({c}, 0.1), 6) AS {c}_L10, round(quantile_cont({c}, 0.9), 6) AS {c}_L90" for c in L.EXPOSURE)


@query(f"WITH {PIXELS}, {exposed('px')} SELECT 'all' AS dataset_id, {EXPOSURE}, count(*)::BIGINT AS n_images_valid FROM exposed")
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.exposure(features(spark, sf_dir, *L.EXPOSURE)))


COLOURS = "rgb AS (SELECT image_id, x, y, v AS b, 255 - v AS g, (v::INT * 7 % 256)::DOUBLE AS r FROM px)"


@query(f"""WITH {PIXELS}, {COLOURS}, levels AS (SELECT image_id, greatest(b, g, r) AS v FROM rgb), {exposed("levels")}, luma AS (SELECT image_id, floor((r * 4899 + g * 9617 + b * 1868 + 8192) / 16384) AS y FROM rgb),
dark AS (SELECT image_id, avg((y <= 51)::INT) AS dark FROM luma GROUP BY image_id)
SELECT image_id::VARCHAR AS image_id, round(R_over, 6) AS R_over, round(I_over, 6) AS I_over, round(dark, 6) AS dark FROM exposed JOIN dark USING (image_id)""")
def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure of colour images by their largest channel, and the share of samples of low luma."""
    images = colours(spark, sf_dir)
    largest = image_features(images, columns=("R_over", "I_over"), brightness="v").select("image_id", "R_over", "I_over")
    luma = image_features(images, columns=("R_under",), exposed=(0.9, 0.2)).select("image_id", F.col("R_under").alias("dark"))
    return rounded(largest.join(luma, "image_id"))


def weights(sigma: float, by: int) -> str:
    """SQL of the weight of each sample j in the blur of sample i along a side of eight, mirrored as often as it takes."""
    return f"""blurs(i, j, w) AS (SELECT i, abs(((i + d + 7) % 14 + 14) % 14 - 7), sum(exp(-(d * d) / {2 * sigma * sigma!r}::DOUBLE)) / (SELECT sum(exp(-(e * e) / {2 * sigma * sigma!r}::DOUBLE)) FROM range({-by}, {by + 1}) s(e))
  FROM range(8) r(i), range({-by}, {by + 1}) q(d) GROUP BY ALL)"""


UNEVEN = f"""{weights(25.0, 100)}, smooth AS (SELECT p.image_id, a.i AS x, b.i AS y, sum(a.w * b.w * p.v) / 255 AS v FROM px p JOIN blurs a ON a.j = p.x JOIN blurs b ON b.j = p.y GROUP BY ALL),
uneven AS (SELECT image_id, stddev_pop(v) / (avg(v) + 1e-12) AS iu FROM smooth GROUP BY image_id)"""


@query(f"WITH {PIXELS}, {UNEVEN} SELECT 'all' AS dataset_id, {summary_sql('iu', 'IU', 'uneven')}")
def illumination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.illumination(features(spark, sf_dir, "illum_iu")))


def derivative(name: str, dx: int, dy: int) -> str:
    taps = {0: (1, 2, 1), 1: (-1, 0, 1), 2: (1, -2, 1)}
    rows = ", ".join(f"({i - 1},{j - 1},{a * b}.0::DOUBLE)" for i, a in enumerate(taps[dx]) for j, b in enumerate(taps[dy]) if a * b)
    return filtered(name, f"VALUES {rows}")


DIRECTIONS = f"""{derivative("d10", 1, 0)}, {derivative("d01", 0, 1)}, {derivative("d20", 2, 0)}, {derivative("d11", 1, 1)}, {derivative("d02", 0, 2)}, {weights(1.7, 4)},
columns AS (SELECT j, sum(w) AS w FROM blurs GROUP BY j),
tensor AS (
  SELECT image_id, sum(a.w * b.w * d10.v * d10.v) / 64 / 255 ^ 2 AS xx, sum(a.w * b.w * d10.v * d01.v) / 64 / 255 ^ 2 AS xy, sum(a.w * b.w * d01.v * d01.v) / 64 / 255 ^ 2 AS yy
  FROM d10 JOIN d01 USING (image_id, x, y) JOIN columns a ON a.j = x JOIN columns b ON b.j = y GROUP BY image_id),
turned AS (SELECT image_id, 0.5 * atan2(2 * xy, xx - yy + 1e-8) + pi() / 2 AS t FROM tensor),
lost AS (
  SELECT image_id, greatest(0, least(1, 1 - avg((cos(t) ^ 2 * d20.v + 2 * cos(t) * sin(t) * d11.v + sin(t) ^ 2 * d02.v) ^ 2) / 255 ^ 2 / (avg(lap.v ^ 2) / 255 ^ 2 + 1e-8)))::DOUBLE AS loss
  FROM d20 JOIN d11 USING (image_id, x, y) JOIN d02 USING (image_id, x, y) JOIN lap USING (image_id, x, y) JOIN turned USING (image_id) GROUP BY image_id)"""


@query(f"WITH {PIXELS}, {LAPLACIAN}, {DIRECTIONS} SELECT 'all' AS dataset_id, {summary_sql('loss', 'DHFEL', 'lost')}")
def directional_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.directional_loss(features(spark, sf_dir, "dhfel")))


ACROSS = """across_30 AS (SELECT image_id, greatest(0, least(1, 1 - avg((0.75 * d20.v + sqrt(3) / 2 * d11.v + 0.25 * d02.v) ^ 2) / 255 ^ 2 / (avg(lap.v ^ 2) / 255 ^ 2 + 1e-8)))::DOUBLE AS loss
  FROM d20 JOIN d11 USING (image_id, x, y) JOIN d02 USING (image_id, x, y) JOIN lap USING (image_id, x, y) GROUP BY image_id)"""


@query(f"WITH {PIXELS}, {LAPLACIAN}, {DIRECTIONS}, {ACROSS} SELECT image_id::VARCHAR AS image_id, round(loss, 6) AS dhfel FROM across_30")
def directional_loss_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a direction that is given, 30 degrees."""
    return rounded(features(spark, sf_dir, "dhfel", dhfel_degrees=30.0).select("image_id", "dhfel"))


@query("SELECT vec_id AS image_id, round(cos(radians(label * 18.0)), 6) AS u, round(sin(radians(label * 18.0)), 6) AS v FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = G.unit_vector(F.col("cls") * 18.0)
    return rounded(instances(spark, sf_dir).select(F.col("box_id").alias("image_id"), u.alias("u"), v.alias("v")))


@query(f"WITH {PIXELS}, {SPECTRUM} SELECT 'all' AS dataset_id, {summary_sql('share', 'GOE', 'high')}")
def gradient_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric over a proxy: the kernel compares in single precision, and so the spectrum's share stands for an image's concentration."""
    return rounded(L.gradient_concentration(features(spark, sf_dir, "hf_share").withColumn("goe", F.col("hf_share"))))


# Style.

LAB = """linear AS (SELECT image_id, x, y, c(b) AS b, c(g) AS g, c(r) AS r FROM rgb),
xyz AS (SELECT image_id, (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456 AS x, 0.212671 * r + 0.715160 * g + 0.072169 * b AS y, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754 AS z FROM linear),
lab AS (SELECT image_id, w(CASE WHEN y > 0.008856 THEN 116 * cbrt(y) - 16 ELSE 903.3 * y END * 255 / 100) AS l, w(500 * (f(x) - f(y)) + 128) AS a, w(200 * (f(y) - f(z)) + 128) AS b FROM xyz),
vectors AS (SELECT image_id, avg(l) AS ml, avg(a) AS ma, avg(b) AS mb, stddev_pop(l) AS sl, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM lab GROUP BY image_id),
tones AS (SELECT l.image_id, ml, sl, avg((l - ml) ^ 3) / (sl + 1e-12) ^ 3 AS kl FROM lab l JOIN vectors USING (image_id) GROUP BY l.image_id, ml, sl)"""


def spelled(sql: str) -> str:
    """LAB with its three functions written out."""
    import re

    forms = {
        "c": lambda x: f"(CASE WHEN {x} / 255 <= 0.04045 THEN {x} / 255 / 12.92 ELSE (({x} / 255 + 0.055) / 1.055) ^ 2.4::DOUBLE END)",
        "f": lambda x: f"(CASE WHEN {x} > 0.008856 THEN cbrt({x}) ELSE 7.787 * {x} + 16.0::DOUBLE / 116 END)",
    }
    sql = re.sub(r"\b([cf])\((\w)\)", lambda m: forms[m[1]](m[2]), sql)
    out, at = "", 0
    for m in re.finditer(r"\bw\(", sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at : m.start()] + f"greatest(0, least(255, round_even({sql[m.end() : end - 1]}, 0)))"
        at = end
    return out + sql[at:]


LAB = spelled(LAB)


def apart(source: str, columns: tuple[str, ...], name: str) -> str:
    """SQL of the mean distance of vectors from their mean."""
    square = " + ".join(f"({c} - m_{c}) ^ 2" for c in columns)
    means = ", ".join(f"avg({c}) AS m_{c}" for c in columns)
    return f"SELECT 'all' AS dataset_id, round(avg(sqrt({square})), 6) AS {name}, count(*)::BIGINT AS n_images FROM {source}, (SELECT {means} FROM {source})"


@query(f"WITH {PIXELS}, {COLOURS}, {LAB} {apart('vectors', ('ml', 'ma', 'mb', 'sl', 'sa', 'sb'), 'C_color')}")
def colour_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.dispersion(image_features(colours(spark, sf_dir), columns=("color",)), "color", "C_color"))


@query(f"WITH {PIXELS}, {COLOURS}, {LAB} {apart('tones', ('ml', 'sl', 'kl'), 'C_tone')}")
def tone_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.dispersion(image_features(colours(spark, sf_dir), columns=("tone",)), "tone", "C_tone"))


def deviation_sql(name: str) -> str:
    return f"SELECT 'all' AS dataset_id, round(avg(abs(f - mu)), 6) AS {name}, count(*)::BIGINT AS n_images FROM one, (SELECT avg(f) AS mu FROM one)"


STEPS = """one AS (SELECT p.image_id, 0.5 * (avg(abs(p.v - q.v)) FILTER (WHERE p.x = 4 AND q.y = p.y) + avg(abs(p.v - q.v)) FILTER (WHERE p.y = 4 AND q.x = p.x)) AS f
  FROM px p JOIN px q ON q.image_id = p.image_id AND (p.x = 4 AND q.x = 3 AND q.y = p.y OR p.y = 4 AND q.y = 3 AND q.x = p.x) GROUP BY p.image_id)"""


@query(f"WITH {PIXELS}, {STEPS} {deviation_sql('C_blk')}")
def blockiness_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.deviation(features(spark, sf_dir, "blockiness", block=4), "blockiness", "C_blk"))


@query(f"WITH {PIXELS}, {LAPLACIAN}, one AS (SELECT image_id, var_pop(v) AS f FROM lap GROUP BY image_id) {deviation_sql('C_sharp')}")
def sharpness_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.deviation(features(spark, sf_dir, "lap_var"), "lap_var", "C_sharp"))


# Annotations.

RINGS = """rings AS (
  SELECT image_id, t, sqrt((gx.v / 255) ^ 2 + (gy.v / 255) ^ 2)::FLOAT::DOUBLE AS g FROM gx JOIN gy USING (image_id, x, y), (VALUES (1), (2)) w(t) WHERE NOT (x BETWEEN t AND 7 - t AND y BETWEEN t AND 7 - t)),
low AS (SELECT image_id, t, avg((g <= thr)::INT) AS share FROM rings JOIN (SELECT image_id, t, quantile_cont(g, 0.4) AS thr FROM rings GROUP BY image_id, t) USING (image_id, t) GROUP BY image_id, t)"""


@query(f"WITH {PIXELS}, {GRADIENTS}, {RINGS} SELECT image_id::VARCHAR AS image_id, round(avg(share), 6) AS cover_ratio_b2 FROM low GROUP BY image_id")
def ring_ratio_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of one and two samples, at another quantile, by their mean."""
    d = features(spark, sf_dir, ring_widths=(1, 2), ring_q=0.4, ring_middle="mean").select("image_id", F.explode("box_details").alias("d"))
    return rounded(d.select("image_id", F.col("d.cover_ratio_b2").alias("cover_ratio_b2")))


@query(f"""WITH {PIXELS}, raw AS (SELECT image_id, avg(v) AS a, stddev_pop(v) AS b, max(v) AS c FROM px GROUP BY image_id)
SELECT image_id::VARCHAR AS image_id, round(a / (sqrt(a * a + b * b + c * c) + 1e-12), 6) AS a, round(b / (sqrt(a * a + b * b + c * c) + 1e-12), 6) AS b, round(c / (sqrt(a * a + b * b + c * c) + 1e-12), 6) AS c FROM raw""")
def instance_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of crops, brought to length 1."""
    embed = lambda crops: [[c[..., 0].mean(), c[..., 0].std(), c[..., 0].max()] for c in crops]
    d = image_features(pixels(spark, sf_dir), embed, columns=()).select("image_id", F.explode("box_details").alias("d"))
    return rounded(d.select("image_id", *(F.col("d.emb")[k].alias(n) for k, n in enumerate("abc"))))


# Scores. What they are made of is rounded on both sides.


def geo_sql(*xs: str, guard: float | None = None, plus: str = "0") -> str:
    """Geometric mean of positive numbers."""
    each = [f"greatest({guard!r}::DOUBLE, least({x}, 1))" if guard else f"({x} + {plus})" for x in xs]
    return f"exp(({' + '.join(f'ln({x})' for x in each)}) / {len(xs)})"


def one_row(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return E.joined([QUERIES[n](spark, sf_dir) for n in names], BY)


SPATIAL = ("scale_cv", "position_entropy", "hf_insufficiency", "resampling_loss", "min_pixel", "edge_density", "self_similarity")


@query(f"""WITH {", ".join(map(within, SPATIAL))},
t AS (SELECT scale_score, pos_score, hf_score, rs_interp_D_mean, px_prob_r_gt_tau, edge_density_score, ssi_score FROM {", ".join(SPATIAL)}),
s AS (SELECT {geo_sql("scale_score", "pos_score")} AS stable, {geo_sql("hf_score", "rs_interp_D_mean", "px_prob_r_gt_tau")} AS info, {geo_sql("edge_density_score", "ssi_score")} AS complex FROM t)
SELECT 'all' AS dataset_id, round(stable, 6) AS stable_score, round(info, 6) AS info_score, round(complex, 6) AS complex_score, round({geo_sql("stable", "info", "complex")}, 6) AS spatial_score FROM s""")
def spatial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.spatial_scores(one_row(spark, sf_dir, *SPATIAL))
    return rounded(m.select(*BY, "stable_score", "info_score", "complex_score", "spatial_score"))


OPTICAL = ("exposure", "illumination", "gradient_concentration", "directional_loss")


@query(f"""WITH {", ".join(map(within, OPTICAL))},
s AS (SELECT 1 - (sqrt(R_over_mean * I_over_mean) + sqrt(R_under_mean * I_under_mean)) AS e, 1 - IU_mean AS i, 1 - sqrt((GOE_mean + 1e-12) * (DHFEL_mean + 1e-12)) AS b FROM {", ".join(OPTICAL)})
SELECT 'all' AS dataset_id, round(e, 6) AS exposure_score, round(i, 6) AS illumination_score, round(b, 6) AS blur_score, round({geo_sql("e", "i", "b", guard=1e-6)}, 6) AS optical_score FROM s""")
def optical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {**{f"{c}_mean": c for c in L.EXPOSURE}, "IU_mean": "illum_iu", "GOE_mean": "goe", "DHFEL_mean": "dhfel"}
    m = one_row(spark, sf_dir, *OPTICAL)
    return rounded(L.scores_of(m.select(*BY, *(F.col(a).alias(b) for a, b in names.items()))))


STYLE = {"colour_dispersion": "C_color", "tone_dispersion": "C_tone", "texture_dispersion": "C_tex", "mae_to_mean": "C_noise", "blockiness_deviation": "C_blk", "sharpness_deviation": "C_sharp"}
SLOW = [f"1 / (1 + ln(1 + {c}))" for c in ("C_color", "C_tone", "C_tex", "C_noise", "C_blk")]


@query(f"""WITH {", ".join(map(within, STYLE))},
s AS (SELECT C_sharp, {", ".join(f"{x} AS {n}" for x, n in zip(SLOW, ("color", "tone", "texture", "noise", "blockiness"), strict=True))} FROM {", ".join(STYLE)}),
t AS (SELECT *, {geo_sql("noise", "blockiness", guard=1e-6)} AS compression FROM s)
SELECT 'all' AS dataset_id, C_sharp, {", ".join(f"round({n}, 6) AS {n}_score" for n in ("color", "tone", "texture", "noise", "blockiness", "compression"))}, round({geo_sql("color", "tone", "texture", "compression", guard=1e-6)}, 6) AS style_score FROM t""")
def style_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Y.scores_of(one_row(spark, sf_dir, *STYLE))
    return rounded(m.select(*BY, "C_sharp", *(f"{k}_score" for k in ("color", "tone", "texture", "noise", "blockiness", "compression", "style"))))


ANNOTATION = ("fisher", "knn_impurity", "split_consistency", "b2_cv", "class_distribution", "positive_image_ratio")


@query(f"""WITH {", ".join(map(within, ANNOTATION))},
s AS (SELECT CASE WHEN comparable THEN A_sep / (1 + A_sep) ELSE 1 END AS sep, 1 - A_imp AS imp, 1 / (1 + A_split) AS split, 1 / (1 + A_b2) AS b2, N_eff_norm AS class, P_img AS p_img FROM {", ".join(ANNOTATION)})
SELECT 'all' AS dataset_id, {", ".join(f"round({n}, 6)::DOUBLE AS {n}_score" for n in ("sep", "imp", "split", "b2", "class", "p_img"))}, round({geo_sql("sep", "imp", "split", "b2", "class", "p_img", plus="1e-12")}, 6) AS annotation_score FROM s""")
def annotation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.annotation_scores(one_row(spark, sf_dir, *ANNOTATION)))


FAMILIES = {"spatial_scores": "spatial_score", "optical_scores": "optical_score", "style_scores": "style_score", "annotation_scores": "annotation_score"}


@query(f"""WITH {", ".join(map(within, FAMILIES))}
SELECT 'all' AS dataset_id, {", ".join(FAMILIES.values())}, round({geo_sql(*FAMILIES.values())}, 6) AS dataset_score FROM {", ".join(FAMILIES)}""")
def dataset_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.dataset_score(*(QUERIES[n](spark, sf_dir) for n in FAMILIES)))


@query(f"""WITH {", ".join(map(within, FAMILIES))}
{" UNION ALL ".join(f"SELECT 'all' AS dataset_id, '{f}' AS family, '{c}' AS metric, {c} AS value FROM {n}" for f, (n, c) in zip(E.FAMILIES, FAMILIES.items(), strict=True))}""")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric tables as a report: one row a metric."""
    parts = [E.long_form(QUERIES[n](spark, sf_dir).select(*BY, c), f) for f, (n, c) in zip(E.FAMILIES, FAMILIES.items(), strict=True)]
    return reduce(DataFrame.union, parts)
