"""The registered queries of the dataset-quality engine and their DuckDB counterparts.

The given tables hold no images. The queries run the engine's own operators over proxies of the right shape,
which carry no visual meaning: boxes are line items and images orders, instances are embeddings, and each
embedding is also an image of 8 by 8 gray samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import stats as S
from tessera.operators import annotations as A
from tessera.operators import light as L
from tessera.operators import spatial as P
from tessera.operators import style as Y
from tessera.operators.features import image_features
from tessera.sources.labels import parse_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Order of a proxy image's boxes: the keys of a line item aren't unique.
LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def query(sql: str | None):
    """Register a query under its function's name, and the SQL that it is held against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema))


# Proxies.


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.lit("all").alias("dataset_id"),
        F.col("l_orderkey").cast("long").alias("image_id"),
        F.concat("l_returnflag", "l_linestatus").alias("cls"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE)).cast("long").alias("box_id"),
        F.lit(640.0).alias("w_img"),
        (480 + (F.col("l_orderkey") % 3) * 80).cast("double").alias("h_img"),
        (F.col("l_discount") * 10).alias("cx"),
        (F.col("l_tax") * 12.5).alias("cy"),
        (F.col("l_quantity") / 100).alias("bw"),
        (F.col("l_extendedprice") / 210000).alias("bh"),
    )


BOXES = f"""x1 AS (
  SELECT 'all' AS dataset_id, l_orderkey::BIGINT AS image_id, l_returnflag || l_linestatus AS cls,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE)})::BIGINT AS box_id,
    640.0::DOUBLE AS w_img, (480 + (l_orderkey % 3) * 80)::DOUBLE AS h_img,
    l_discount * 10 AS cx, l_tax * 12.5::DOUBLE AS cy, l_quantity / 100 AS bw, l_extendedprice / 210000 AS bh
  FROM lineitem),
corners AS (
  SELECT *, greatest(0, least((cx - bw / 2) * w_img, w_img)) AS x1, greatest(0, least((cy - bh / 2) * h_img, h_img)) AS y1,
    greatest(0, least((cx + bw / 2) * w_img, w_img)) AS x2, greatest(0, least((cy + bh / 2) * h_img, h_img)) AS y2
  FROM x1)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.lit("all").alias("dataset_id"), F.col("o_orderkey").cast("long").alias("image_id"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("all").alias("dataset_id"), F.col("vec_id").alias("box_id"), F.col("label").alias("cls"), F.col("embedding").alias("emb"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 by 8 gray images."""
    level = lambda e: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.999999), (e.cast("double") + 0.6) / 1.2)) * 256)
    return table(spark, sf_dir, "embeddings").select(
        F.lit("all").alias("dataset_id"),
        F.col("vec_id").cast("string").alias("image_id"),
        F.col("vec_id").cast("long").alias("ordinal"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("channels"),
        F.unhex(F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(level(e).cast("long")), 2, "0")), "")).alias("data"),
        F.array(F.struct(F.lit(1).cast("long").alias("box_id"), F.col("label").cast("int").alias("cls"), F.array(*[F.lit(v).cast("long") for v in (0, 0, 8, 8)]).alias("crop"), F.array(*[F.lit(v).cast("long") for v in (0, 0, 8, 8)]).alias("tight"))).alias("boxes"),
    )


PIXELS = """px AS (
  SELECT vec_id::BIGINT AS image_id, label, (i - 1) % 8 AS x, (i - 1) // 8 AS y,
    floor(greatest(0.0::DOUBLE, least(0.999999::DOUBLE, (embedding[i]::DOUBLE + 0.6::DOUBLE) / 1.2::DOUBLE)) * 256)::DOUBLE AS v
  FROM embeddings, unnest(range(1, 65)) AS r(i))"""


def filtered(name: str, taps: str, border: str = "mirror", source: str = "px", last: int = 7) -> str:
    """SQL of one filter over images of last + 1 samples a side: taps are rows (dx, dy, k)."""
    at = (lambda c, d: f"greatest(0, least({last}, {c} + {d}))") if border == "edge" else (lambda c, d: f"{last} - abs({last} - abs({c} + {d}) % {2 * last})")
    return f"""{name} AS (
  SELECT p.image_id, p.x, p.y, sum(t.k * q.v) AS v FROM {source} p CROSS JOIN ({taps}) t(dx, dy, k)
  JOIN {source} q ON q.image_id = p.image_id AND q.x = {at("p.x", "t.dx")} AND q.y = {at("p.y", "t.dy")} GROUP BY p.image_id, p.x, p.y)"""


LAPLACIAN = filtered("lap", "VALUES (-1,-1,2.0::DOUBLE), (1,-1,2.0), (0,0,-8.0), (-1,1,2.0), (1,1,2.0)")
BLUR = filtered(
    "blur",
    "SELECT a.d, b.d, exp(-(a.d * a.d + b.d * b.d) / 2.88::DOUBLE) / (SELECT sum(exp(-(c.d * c.d) / 2.88::DOUBLE)) FROM range(-4, 5) c(d)) ^ 2 FROM range(-4, 5) a(d), range(-4, 5) b(d)",
)
GRADIENTS = (
    filtered("gx", "VALUES (-1,-1,-1.0::DOUBLE), (1,-1,1.0), (-1,0,-2.0), (1,0,2.0), (-1,1,-1.0), (1,1,1.0)", "edge")
    + ",\n"
    + filtered("gy", "VALUES (-1,-1,-1.0::DOUBLE), (0,-1,-2.0), (1,-1,-1.0), (-1,1,1.0), (0,1,2.0), (1,1,1.0)", "edge")
    + """,
ring AS (
  SELECT image_id, x, y, sqrt((gx.v / 255) ^ 2 + (gy.v / 255) ^ 2)::FLOAT::DOUBLE AS g FROM gx JOIN gy USING (image_id, x, y)
  WHERE NOT (x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5)),
cover AS (
  SELECT image_id, avg((g <= thr)::INT) AS b2 FROM ring JOIN (SELECT image_id, quantile_cont(g, 0.3) AS thr FROM ring GROUP BY image_id) USING (image_id) GROUP BY image_id)"""
)


# Boxes.


@query(f"""WITH {BOXES}, s AS (SELECT sqrt(greatest((x2 - x1) * (y2 - y1), 0)) AS s FROM corners)
SELECT 'all' AS dataset_id, round(avg(s), 6) AS scale_mu, round(stddev_pop(s), 6) AS scale_sd, count(*)::BIGINT AS n_bboxes,
  round(stddev_pop(s) / (avg(s) + 1e-12), 6) AS scale_cv, round(1 / (1 + stddev_pop(s) / (avg(s) + 1e-12)), 6) AS scale_score FROM s""")
def scale_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.scale_variation(boxes(spark, sf_dir)))


POSITION = """cells AS (
  SELECT least(floor(greatest(0, least(cy, 1)) * 8), 7) AS gy, least(floor(greatest(0, least(cx, 1)) * 8), 7) AS gx, count(*) AS n FROM x1 GROUP BY ALL),
pos AS (SELECT sum(n)::BIGINT AS n, -sum(n / t * ln(n / t + 1e-12)) AS h FROM (SELECT n, sum(n) OVER () + 1e-12 AS t FROM cells))"""


@query(f"""WITH {BOXES}, {POSITION}
SELECT 'all' AS dataset_id, n AS n_bboxes, round(h, 6) AS pos_entropy, round(h / (ln(64) + 1e-12), 6) AS pos_entropy_norm,
  round(1 - greatest(0, least(h / (ln(64) + 1e-12), 1)), 6) AS pos_score FROM pos""")
def position_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.position_entropy(boxes(spark, sf_dir)))


@query(f"""WITH {BOXES}, r AS (SELECT least(x2 - x1, y2 - y1) AS r FROM corners WHERE x2 > x1 AND y2 > y1)
SELECT 'all' AS dataset_id, count(*)::BIGINT AS n_bboxes_valid, round(avg((r > 8)::INT), 6) AS px_prob_r_gt_tau FROM r""")
def min_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.pixel_sufficiency(boxes(spark, sf_dir)))


def class_sql(source: str) -> str:
    return f"""c AS (SELECT cls, count(*) AS n FROM {source} GROUP BY cls), p AS (SELECT n, n / (sum(n) OVER () + 1e-12) AS p FROM c),
classes AS (SELECT sum(n)::BIGINT AS n_items, count(*)::BIGINT AS n_classes, -sum(p * ln(p + 1e-12)) AS h, sum(p * p) AS q FROM p),
spread AS (SELECT n_items, n_classes, CASE WHEN n_classes <= 1 THEN 1 ELSE h / (ln(n_classes) + 1e-12) END AS h_norm, CASE WHEN n_classes <= 1 THEN 1 ELSE 1 / (q + 1e-12) / n_classes END AS n_eff FROM classes)"""


SPREAD = "SELECT 'all' AS dataset_id, n_items, n_classes, round(h_norm, 6)::DOUBLE AS H_norm, round(n_eff, 6)::DOUBLE AS N_eff_norm FROM spread"


@query(f"WITH {BOXES}, {class_sql('x1')} {SPREAD}")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.class_distribution(boxes(spark, sf_dir)))


@query(f"WITH l AS (SELECT quality * 2 + toxic AS cls FROM labels), {class_sql('l')} {SPREAD}")
def class_distribution_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")  # noqa: E741
    return rounded(A.class_distribution(l.select(F.lit("all").alias("dataset_id"), (F.col("quality") * 2 + F.col("toxic")).alias("cls"))))


POSITIVE = "has AS (SELECT o_orderkey, count(l.k) > 0 AS has FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON l.k = o_orderkey GROUP BY o_orderkey)"


@query(f"WITH {POSITIVE} SELECT 'all' AS dataset_id, count(*)::BIGINT AS n_images, count(*) FILTER (WHERE has)::BIGINT AS n_positive, round(avg(has::INT), 6) AS P_img FROM has")
def positive_image_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.positive_images(images(spark, sf_dir), boxes(spark, sf_dir)))


TOKENS = ("cx", "cy", "bw", "bh")


@query(f"""WITH {BOXES}, names AS (SELECT cls, (row_number() OVER (ORDER BY cls) - 1)::INT AS n FROM (SELECT DISTINCT cls FROM x1)),
files AS (SELECT image_id, string_agg(n::VARCHAR || ' ' || cx::VARCHAR || ' ' || cy::VARCHAR || ' ' || bw::VARCHAR || ' ' || bh::VARCHAR, chr(10) ORDER BY box_id) AS t FROM x1 JOIN names USING (cls) GROUP BY image_id),
lines AS (SELECT image_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS k FROM files),
tokens AS (SELECT image_id, k, regexp_split_to_array(trim(l), '\\s+') AS w FROM lines)
SELECT image_id::VARCHAR AS stem, k::INT AS line_no, trunc(w[1]::DOUBLE)::INT AS cls, round(w[2]::DOUBLE, 6) AS cx, round(w[3]::DOUBLE, 6) AS cy, round(w[4]::DOUBLE, 6) AS bw, round(w[5]::DOUBLE, 6) AS bh FROM tokens WHERE len(w) >= 5""")
def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes rendered as label files, and parsed."""
    x = boxes(spark, sf_dir)
    names = x.select("cls").distinct()
    lesser = names.alias("a").join(names.withColumnRenamed("cls", "other").alias("b"), F.col("other") < F.col("a.cls"), "left").groupBy("cls").agg(F.count("other").alias("n"))
    line = F.concat_ws(" ", F.col("n").cast("string"), *(F.col(c).cast("string") for c in TOKENS))
    files = x.join(F.broadcast(lesser), "cls").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_id", line.alias("line")))).alias("ls"))
    texts = files.select(F.col("image_id").cast("string").alias("stem"), F.array_join(F.transform("ls", lambda s: s["line"]), "\n").alias("text"))
    return rounded(parse_text(texts))


@query(f"""WITH {BOXES}, pads AS (SELECT *, 0.1::DOUBLE * (x2 - x1) AS px, 0.1::DOUBLE * (y2 - y1) AS py FROM corners)
SELECT image_id, box_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2,
  greatest(0, least(floor(x1)::BIGINT, w_img::BIGINT)) AS out_x1, greatest(0, least(ceil(y2)::BIGINT, h_img::BIGINT)) AS out_y2,
  greatest(0, least(round_even(x1 - px, 0)::BIGINT, w_img::BIGINT)) AS pad_x1, greatest(0, least(round_even(y1 - py, 0)::BIGINT, h_img::BIGINT)) AS pad_y1,
  greatest(0, least(round_even(x2 + px, 0)::BIGINT, w_img::BIGINT)) AS pad_x2, greatest(0, least(round_even(y2 + py, 0)::BIGINT, h_img::BIGINT)) AS pad_y2,
  greatest(0, least(round_even((cx - bw / 2) * w_img, 0)::BIGINT, w_img::BIGINT - 1)) AS int_x1,
  greatest(greatest(1, least(round_even((cx + bw / 2) * w_img, 0)::BIGINT, w_img::BIGINT)), greatest(0, least(round_even((cx - bw / 2) * w_img, 0)::BIGINT, w_img::BIGINT - 1)) + 1) AS int_x2,
  round(x1 - 0.5::DOUBLE * 0.1::DOUBLE * (x2 - x1), 6) AS grown_x1, round(y2 + 0.5::DOUBLE * 0.1::DOUBLE * (y2 - y1), 6) AS grown_y2 FROM pads""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.with_corners(boxes(spark, sf_dir))
    c = [F.col(k) for k in G.CORNERS]
    size = [F.col("w_img"), F.col("h_img")]
    out, pad, grown = G.outward(*c, *size), G.padded(*c, *size), G.expanded(*c, 0.1)
    whole = G.whole_corners(*(F.col(k) for k in TOKENS), *size)
    return rounded(
        b.select(
            "image_id", "box_id", *c,
            out["x1"].alias("out_x1"), out["y2"].alias("out_y2"), *(pad[k].alias(f"pad_{k}") for k in G.CORNERS),
            whole["x1"].alias("int_x1"), whole["x2"].alias("int_x2"), grown["x1"].alias("grown_x1"), grown["y2"].alias("grown_y2"),
        )
    )


IOU = """grown AS (
  SELECT image_id, cls, box_id, x1 - 0.05::DOUBLE * (x2 - x1) AS x1, y1 - 0.05::DOUBLE * (y2 - y1) AS y1, x2 + 0.05::DOUBLE * (x2 - x1) AS x2, y2 + 0.05::DOUBLE * (y2 - y1) AS y2 FROM corners),
both_of AS (
  SELECT a.image_id, a.cls, a.box_id AS a, b.box_id AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
    greatest(0, a.x2 - a.x1) * greatest(0, a.y2 - a.y1) + greatest(0, b.x2 - b.x1) * greatest(0, b.y2 - b.y1) AS s
  FROM grown a JOIN grown b ON a.image_id = b.image_id AND a.cls = b.cls AND a.box_id < b.box_id),
pairs AS (SELECT image_id, cls, a, b, i / (s - i + 1e-12) AS iou FROM both_of WHERE i > 0 AND i / (s - i + 1e-12) >= 0.1)"""


@query(f"WITH {BOXES}, {IOU} SELECT image_id, cls, a, b, round(iou, 6) AS iou FROM pairs")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.overlapping_pairs(P.with_corners(boxes(spark, sf_dir))).drop("dataset_id"))


@query(f"""WITH RECURSIVE {BOXES}, {IOU}, edges AS (SELECT image_id, cls, a, b FROM pairs UNION SELECT image_id, cls, b, a FROM pairs),
reach AS (SELECT image_id, cls, a AS n, a AS r FROM edges UNION SELECT reach.image_id, reach.cls, e.b, reach.r FROM reach JOIN edges e ON e.image_id = reach.image_id AND e.cls = reach.cls AND e.a = reach.n),
roots AS (SELECT x1.image_id, x1.cls, x1.box_id, coalesce(min(r.r), x1.box_id) AS root FROM x1 LEFT JOIN reach r ON r.image_id = x1.image_id AND r.cls = x1.cls AND r.n = x1.box_id GROUP BY x1.image_id, x1.cls, x1.box_id),
sizes AS (SELECT count(*) AS s FROM roots GROUP BY image_id, cls, root)
SELECT 'all' AS dataset_id, count(*)::BIGINT AS n_components, max(s)::BIGINT AS max_size, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(s) / (avg(s) + 1e-12) END, 6)::DOUBLE AS A_split FROM sizes""")
def split_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.split_consistency(P.with_corners(boxes(spark, sf_dir))))


# Vectors.

VECTORS = """e AS (SELECT vec_id, label, embedding FROM embeddings),
z AS (SELECT vec_id, label, i AS pos, embedding[i]::DOUBLE AS x FROM e, unnest(range(1, 65)) AS r(i))"""


@query(f"""WITH {VECTORS}, g AS (SELECT label, pos, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM z GROUP BY ALL), a AS (SELECT pos, avg(x) AS mu FROM z GROUP BY pos)
SELECT 'all' AS dataset_id, round(sum(n * (m - mu) ^ 2) / (sum(n * v) + 1e-12), 6) AS A_sep, count(DISTINCT label) > 1 AS comparable, count(DISTINCT label)::BIGINT AS n_classes FROM g JOIN a USING (pos) WHERE n >= 2""")
def fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.fisher_separability(instances(spark, sf_dir)))


NEAREST = """sims AS (
  SELECT a.vec_id AS id, a.label AS cls, b.vec_id AS near_id, b.label AS near_cls, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, near_id) AS rank FROM sims QUALIFY rank <= 10)"""


@query(f"""WITH {NEAREST}, share AS (SELECT id, avg((near_cls = cls)::INT) AS same FROM top GROUP BY id)
SELECT 'all' AS dataset_id, count(*)::BIGINT AS n_items, round(1 - sum(same) / (count(*) + 1e-12), 6) AS A_imp FROM share""")
def knn_impurity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.neighbour_impurity(instances(spark, sf_dir)))


@query(f"WITH {NEAREST} SELECT id, rank::INT AS rank, near_id, s AS similarity FROM top")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nearest(instances(spark, sf_dir)).select("id", "rank", "near_id", "similarity")


@query(f"""WITH {VECTORS}, c AS (SELECT pos, avg(x) AS m FROM z GROUP BY pos), d AS (SELECT vec_id, sqrt(sum((x - m) ^ 2)) AS d FROM z JOIN c USING (pos) GROUP BY vec_id)
SELECT 'all' AS dataset_id, round(avg(d), 6) AS C, count(*)::BIGINT AS n_images FROM d""")
def dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.dispersion(instances(spark, sf_dir), "emb", "C"))


@query(f"""WITH {VECTORS}, c AS (SELECT label, pos, avg(x) AS m FROM z GROUP BY ALL), d AS (SELECT label, vec_id, sqrt(sum((x - m) ^ 2)) AS d FROM z JOIN c USING (label, pos) GROUP BY ALL)
SELECT label, round(avg(d), 6) AS C, count(*)::BIGINT AS n_images FROM d GROUP BY label""")
def dispersion_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.dispersion(table(spark, sf_dir, "embeddings"), "embedding", "C", ["label"]))


# Pixels.


@query(f"""WITH {PIXELS}, {LAPLACIAN}, {BLUR},
l AS (SELECT image_id, avg(abs(v)) / 255 AS lap0, var_pop(v) AS lap_var FROM lap GROUP BY image_id),
n AS (SELECT image_id, avg((px.v - blur.v) ^ 2) AS noise FROM px JOIN blur USING (image_id, x, y) GROUP BY image_id),
b AS (SELECT p.image_id, 0.5 * (avg(abs(p.v - q.v)) FILTER (WHERE p.x = 4 AND q.y = p.y) + avg(abs(p.v - q.v)) FILTER (WHERE p.y = 4 AND q.x = p.x)) AS blockiness
      FROM px p JOIN px q ON q.image_id = p.image_id AND (p.x = 4 AND q.x = 3 AND q.y = p.y OR p.y = 4 AND q.y = 3 AND q.x = p.x) GROUP BY p.image_id),
o AS (SELECT image_id, avg((v >= 230)::INT) AS R_over, coalesce(avg(v / 255 - 0.9) FILTER (WHERE v >= 230), 0) AS I_over, avg((v <= 12)::INT) AS R_under, coalesce(avg(0.05 - v / 255) FILTER (WHERE v <= 12), 0) AS I_under FROM px GROUP BY image_id)
SELECT image_id::VARCHAR AS image_id, round(lap0, 6) AS lap0, round(lap_var, 6) AS lap_var, round(noise, 6) AS noise, round(blockiness, 6) AS blockiness,
  round(R_over, 6) AS R_over, round(I_over, 6) AS I_over, round(R_under, 6) AS R_under, round(I_under, 6) AS I_under FROM l JOIN n USING (image_id) JOIN b USING (image_id) JOIN o USING (image_id)""")
def pixel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("lap0", "lap_var", "noise", "blockiness", "R_over", "I_over", "R_under", "I_under")
    return rounded(image_features(pixels(spark, sf_dir), block=4, columns=names).select("image_id", *names))


PATTERNS = """inner_px AS (SELECT * FROM px WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6),
codes AS (
  SELECT p.image_id, p.x, p.y, sum(t.k * (q.v >= p.v)::INT) AS code FROM inner_px p CROSS JOIN (VALUES (-1,-1,128), (0,-1,64), (1,-1,32), (1,0,16), (1,1,8), (0,1,4), (-1,1,2), (-1,0,1)) t(dx, dy, k)
  JOIN px q ON q.image_id = p.image_id AND q.x = p.x + t.dx AND q.y = p.y + t.dy GROUP BY ALL),
hist AS (SELECT image_id, code::INT AS code, count(*) / (36 + 1e-12) AS share FROM codes GROUP BY ALL)"""


@query(f"WITH {PIXELS}, {PATTERNS} SELECT image_id::VARCHAR AS image_id, code, round(share, 6) AS share FROM hist")
def lbp_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = image_features(pixels(spark, sf_dir), columns=("lbp",)).select("image_id", F.posexplode("lbp").alias("code", "share"))
    return rounded(h.where("share > 0"))


@query(f"""WITH {PIXELS}, {PATTERNS}, c AS (SELECT code, sum(share) / (SELECT count(*) FROM embeddings) AS m FROM hist GROUP BY code), t AS (SELECT sum(m * m) AS mm FROM c),
d AS (SELECT image_id, sqrt(greatest(sum((share - m) ^ 2 - m * m) + any_value(mm), 0)) AS d FROM hist JOIN c USING (code), t GROUP BY image_id)
SELECT 'all' AS dataset_id, round(avg(d), 6) AS C_tex, count(*)::BIGINT AS n_images FROM d""")
def texture_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.dispersion(image_features(pixels(spark, sf_dir), columns=("lbp",)), "lbp", "C_tex"))


@query(f"""WITH {PIXELS}, {BLUR}, n AS (SELECT image_id, avg((px.v - blur.v) ^ 2) AS noise FROM px JOIN blur USING (image_id, x, y) GROUP BY image_id)
SELECT 'all' AS dataset_id, round(avg(abs(noise - mu)), 6) AS C_noise, count(*)::BIGINT AS n_images FROM n, (SELECT avg(noise) AS mu FROM n)""")
def mae_to_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.deviation(image_features(pixels(spark, sf_dir), columns=("noise",)), "noise", "C_noise"))


@query(f"""WITH {PIXELS}, {LAPLACIAN}, l AS (SELECT image_id, avg(abs(v)) / 255 AS f FROM lap GROUP BY image_id)
SELECT 'all' AS dataset_id, round(avg(f), 6) AS lap_mean, round(quantile_cont(f, 0.1), 6) AS lap_L10, round(quantile_cont(f, 0.9), 6) AS lap_L90, count(*)::BIGINT AS n_images_valid FROM l""")
def summary_l10_l90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.one_feature(image_features(pixels(spark, sf_dir), columns=("lap0",)), "lap0", "lap"))


@query(f"""WITH {PIXELS}, {LAPLACIAN}, l AS (SELECT image_id, avg(abs(v)) / 255 AS f FROM lap GROUP BY image_id), a AS (SELECT count(*)::BIGINT AS n, avg(f) AS m, quantile_cont(f, 0.1) AS q FROM l)
SELECT 'all' AS dataset_id, round(m, 6) AS hf_L_mean, round(q, 6) AS hf_L10, n AS n_bboxes_valid, round((m + q) / 2, 6) AS hf_L_hf, round((m + q) / 2 / ((m + q) / 2 + 1 + 1e-12), 6) AS hf_score FROM a""")
def hf_insufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = image_features(pixels(spark, sf_dir), columns=()).select("dataset_id", F.explode("box_details").alias("d")).select("dataset_id", F.col("d.lap").alias("lap"))
    return rounded(P.detail_insufficiency(d))


@query(f"WITH {PIXELS}, {GRADIENTS} SELECT image_id::VARCHAR AS image_id, round(b2, 6) AS cover_ratio_b2 FROM cover")
def ring_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = image_features(pixels(spark, sf_dir), columns=()).select("image_id", F.explode("box_details").alias("d"))
    return rounded(d.select("image_id", F.col("d.cover_ratio_b2").alias("cover_ratio_b2")))


@query(f"""WITH {PIXELS}, {GRADIENTS}, c AS (SELECT label, count(*) AS n, stddev_pop(b2) / (avg(b2) + 1e-12) AS cv FROM cover JOIN embeddings ON vec_id = image_id GROUP BY label)
SELECT 'all' AS dataset_id, round(coalesce(avg(cv) FILTER (WHERE n >= 10), 0), 6)::DOUBLE AS A_b2, count(*) FILTER (WHERE n >= 10)::BIGINT AS n_classes_used FROM c""")
def b2_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = image_features(pixels(spark, sf_dir), columns=()).select("dataset_id", F.explode("box_details").alias("d")).select("dataset_id", "d.cls", "d.cover_ratio_b2")
    return rounded(A.coverage_variation(d))


# Scores.


@query(f"""WITH {BOXES}, {POSITION}, {class_sql("x1")}, {POSITIVE}, s AS (SELECT sqrt(greatest((x2 - x1) * (y2 - y1), 0)) AS s FROM corners),
r AS (SELECT avg((least(x2 - x1, y2 - y1) > 8)::INT) AS px FROM corners WHERE x2 > x1 AND y2 > y1),
m AS (SELECT 1 / (1 + stddev_pop(s) / (avg(s) + 1e-12)) AS scale_score FROM s),
t AS (SELECT scale_score, 1 - greatest(0, least(h / (ln(64) + 1e-12), 1)) AS pos_score, px, n_eff, (SELECT avg(has::INT) FROM has) AS p_img FROM m, pos, r, spread)
SELECT 'all' AS dataset_id, round(exp((ln(scale_score) + ln(pos_score)) / 2), 6) AS stable_score, round(px, 6) AS px_score, round(n_eff, 6)::DOUBLE AS class_score, round(p_img, 6) AS p_img_score,
  round(exp((ln(scale_score) + ln(pos_score) + ln(px)) / 3), 6) AS structure_score, round(exp((ln(n_eff + 1e-12) + ln(p_img + 1e-12)) / 2), 6) AS label_score FROM t""")
def score_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = boxes(spark, sf_dir)
    m = P.scale_variation(x).select("dataset_id", "scale_score")
    for part in (P.position_entropy(x).select("dataset_id", "pos_score"), P.pixel_sufficiency(x).drop("n_bboxes_valid"), A.class_distribution(x).select("dataset_id", "N_eff_norm"), A.positive_images(images(spark, sf_dir), x).select("dataset_id", "P_img")):
        m = m.join(part, "dataset_id")
    return rounded(
        m.select(
            "dataset_id",
            S.geo_mean(F.col("scale_score"), F.col("pos_score")).alias("stable_score"),
            F.col("px_prob_r_gt_tau").alias("px_score"),
            F.col("N_eff_norm").alias("class_score"),
            F.col("P_img").alias("p_img_score"),
            S.geo_mean(F.col("scale_score"), F.col("pos_score"), F.col("px_prob_r_gt_tau")).alias("structure_score"),
            S.geo_mean(F.col("N_eff_norm"), F.col("P_img"), plus=1e-12).alias("label_score"),
        )
    )


FLAGSHIP = score_composition

from tessera import catalog_metrics  # noqa: E402, F401  registers its queries
