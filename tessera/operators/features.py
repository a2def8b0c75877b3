"""One fused kernel: every image is decoded once, and all features of it and of its boxes come from that."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions import kernels as K

#: Input: one row an image; data are rows of interleaved blue, green, red (or gray, or with alpha) samples. An
#: image that can't be decoded has no height. What else boxes hold (PLACE) is handed on.
INPUT = "dataset_id string, image_id string, ordinal long, height int, width int, channels int, data binary, boxes array<struct<box_id: long, cls: int, crop: array<long>, tight: array<long>>>"
PLACE = ("cx", "cy", "bw", "bh")
SCALARS = ("lap0", "lap1", "edge_density", "ssi", "hf_share", "R_over", "I_over", "R_under", "I_under", "illum_iu", "goe", "dhfel", "noise", "blockiness", "lap_var")
VECTORS = ("color", "tone", "lbp")
SCHEMA = ", ".join(
    [
        "dataset_id string, image_id string, ordinal long, height int, width int, readable boolean",
        *(f"{c} double" for c in SCALARS),
        *(f"{c} array<double>" for c in VECTORS),
        f"box_details array<struct<box_id: long, cls: int, {', '.join(f'{c}: double' for c in PLACE)}, lap: double, cover_ratio_b2: double, emb: array<double>>>",
    ]
)


def as_bgr(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Three channels from one, three or four."""
    img = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return img.repeat(3, 2) if channels == 1 else img[..., :3]


#: Parameters of the features, by name, where they aren't what the functions of the kernel say.
DEFAULTS = {
    "seed": 0,
    "block": 8,
    "dhfel_degrees": None,
    "brightness": "y",
    "long_side": 640,
    "interp_scale": 0.5,
    "canny": (100.0, 200.0),
    "ssi_side": 640,
    "ssi_patches": 64,
    "ssi_patch": 32,
    "ssi_radius": 80,
    "ssi_margin": 4,
    "hf_ratio": 0.55,
    "exposed": (0.90, 0.05),
    "iu_sigma": 25.0,
    "goe_percentile": 70.0,
    "goe_bins": 36,
    "noise_sigma": 1.2,
    "ring_widths": (2, 4, 8, 12),
    "ring_q": 0.30,
    "ring_middle": "median",
}


def features_of(bgr: np.ndarray, gray: np.ndarray, ordinal: int, columns: tuple[str, ...] = (*SCALARS, *VECTORS), **options) -> dict:
    """The image features asked for, with DEFAULTS but for `options`; each reads the resolution that its definition names, and others are null."""
    o = DEFAULTS | options
    gray01 = gray / 255.0
    bright = K.brightness01(bgr, o["brightness"])
    small = K.shrink_to(bgr, o["long_side"])
    small_gray = K.gray_of(small)
    over = K.exposure(bright, *o["exposed"])
    how = {
        "lap0": lambda: K.mean_abs_laplacian(gray01),
        "lap1": lambda: K.mean_abs_laplacian(K.down_and_up(gray01, o["interp_scale"])),
        "edge_density": lambda: K.edge_density(gray, *o["canny"]),
        "ssi": lambda: K.self_dissimilarity(gray, o["seed"] + ordinal, o["ssi_side"], o["ssi_patches"], o["ssi_patch"], o["ssi_radius"], o["ssi_margin"]),
        "hf_share": lambda: K.high_frequency_share(gray01, o["hf_ratio"]),
        "R_over": lambda: over[0],
        "I_over": lambda: over[1],
        "R_under": lambda: over[2],
        "I_under": lambda: over[3],
        "illum_iu": lambda: K.illumination_unevenness(bright, o["iu_sigma"]),
        "goe": lambda: K.orientation_concentration(gray01, *o["exposed"], o["goe_percentile"], o["goe_bins"]),
        "dhfel": lambda: K.directional_loss(gray01, o["dhfel_degrees"]),
        "noise": lambda: K.residual_energy(small_gray, o["noise_sigma"]),
        "blockiness": lambda: K.blockiness(small_gray, o["block"]),
        "lap_var": lambda: K.laplacian_variance(small_gray),
        "color": lambda: K.colour_vector(small),
        "tone": lambda: K.tone_vector(small),
        "lbp": lambda: K.texture_histogram(small_gray),
    }
    return {name: f() if name in columns else None for name, f in how.items()}


def box_features(bgr: np.ndarray, gray: np.ndarray, boxes: list[dict], embed: Callable | None, options: dict) -> list[dict]:
    """Detail of each box's tight crop, and coverage (and embedding) of its padded one; an empty crop has neither."""
    o, out, crops = DEFAULTS | options, [], []
    for b in boxes:
        x1, y1, x2, y2 = b["tight"]
        row = {"box_id": b["box_id"], "cls": b["cls"], **{c: b.get(c) for c in PLACE}, "lap": None, "cover_ratio_b2": None, "emb": None}
        if x2 > x1 and y2 > y1:
            row["lap"] = K.mean_abs_laplacian(gray[y1:y2, x1:x2] / 255.0)
        x1, y1, x2, y2 = b["crop"]
        if x2 > x1 and y2 > y1:
            row["cover_ratio_b2"] = K.ring_low_share(gray[y1:y2, x1:x2] / 255.0, o["ring_widths"], o["ring_q"], o["ring_middle"])
            crops.append((row, bgr[y1:y2, x1:x2]))
        out.append(row)
    if embed and crops:
        z = np.asarray(embed([c for _, c in crops]), np.float64)
        z /= np.linalg.norm(z, axis=1, keepdims=True) + 1e-12
        for (row, _), v in zip(crops, z, strict=True):
            row["emb"] = v.tolist()
    return out


def image_features(images: DataFrame, embed: Callable | None = None, strict: bool = False, columns: tuple[str, ...] = (*SCALARS, *VECTORS), **options) -> DataFrame:
    """images (INPUT) → SCHEMA, one row an image. `embed` turns a list of BGR crops into vectors, in the worker.

    Images pass one at a time; what a task holds is one Arrow batch of them. An image without a height is not
    readable and has no features, or raises if strict. `options` are those of DEFAULTS.
    """
    if unknown := options.keys() - DEFAULTS.keys():
        raise TypeError(f"unknown options: {sorted(unknown)}")
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found = dict.fromkeys((*SCALARS, *VECTORS, "box_details")) | {c: row[c] for c in ("dataset_id", "image_id", "ordinal", "height", "width")}
                found["readable"] = (row["height"] or 0) > 0 and (row["channels"] or 0) > 0
                if found["readable"]:
                    bgr = as_bgr(row["data"], row["height"], row["width"], row["channels"])
                    gray = bgr[..., 0] if row["channels"] == 1 else K.gray_of(bgr)
                    found |= features_of(bgr, gray, row["ordinal"] or 0, columns, **options)
                    found["box_details"] = box_features(bgr, gray, row["boxes"] or [], embed, options)
                elif strict:
                    raise ValueError(f"unreadable image: {row['image_id']}")
                yield pa.RecordBatch.from_arrays([pa.array([found[f.name].tolist() if isinstance(found[f.name], np.ndarray) else found[f.name]], f.type) for f in arrow], schema=arrow)

    return images.mapInArrow(run, SCHEMA)
