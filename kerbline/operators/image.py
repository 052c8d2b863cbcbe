"""Projected points: z-buffers, best observations, view choice and blending, histograms, sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order (which should end in an id)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def zbuffer(projected: DataFrame, depth: str = "depth", rounding: str = "floor") -> DataFrame:
    """Nearest row of each pixel of each image; ties to the smaller pid. 'rint' rounds half to even."""
    px = {"floor": F.floor, "rint": F.rint}[rounding]
    p = projected.withColumn("px", px("u").cast("long")).withColumn("py", px("v").cast("long"))
    return first_by(p, ["image", "px", "py"], [depth, "pid"])


def best_observation(observations: DataFrame, score: str = "score", order: str = "image") -> DataFrame:
    """One row for each point: least score, ties to the earlier image."""
    return first_by(observations, ["pid"], [score, order])


def view_scores(observations: DataFrame, strategy: str, width: int, height: int) -> DataFrame:
    """Adds ``score`` (smaller is better) by centre, frontal angle, closest distance, or agreement with the median colour."""
    from ..functions.camera import centre_distance

    if strategy == "centre":
        return observations.withColumn("score", centre_distance(F.col("u"), F.col("v"), width, height))
    if strategy == "frontal":
        return observations.withColumn("score", F.col("angle"))
    if strategy == "closest":
        return observations.withColumn("score", F.col("distance"))
    if strategy == "consistency":
        w = Window.partitionBy("pid")
        for c in "rgb":
            observations = observations.withColumn(f"_m{c}", F.percentile(c, F.lit(0.5)).over(w))
        d = sum(((F.col(c) - F.col(f"_m{c}")) * (F.col(c) - F.col(f"_m{c}")) for c in "gb"), (F.col("r") - F.col("_mr")) * (F.col("r") - F.col("_mr")))
        return observations.withColumn("score", F.sqrt(d)).drop("_mr", "_mg", "_mb")
    raise ValueError(strategy)


def blend(observations: DataFrame, width: int, height: int, centre_sigma: float = 0.5, frontal_limit: float = 1.0, distance_sigma: float = 20.0, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """pid, r, g, b, n_views: mean colour weighted by centrality, frontality and nearness."""
    from ..functions.camera import centre_distance

    d = centre_distance(F.col("u"), F.col("v"), width, height)
    w = weights[0] * F.exp(-d * d / (2 * centre_sigma * centre_sigma)) + weights[1] * F.greatest(F.lit(0.0), 1 - F.col("angle") / frontal_limit) + weights[2] * F.exp(-F.col("distance") / distance_sigma)
    o = observations.withColumn("_w", w)
    total = F.sum("_w") + 1e-10
    return o.groupBy("pid").agg(*((F.sum(F.col("_w") * F.col(c)) / total).alias(c) for c in "rgb"), F.count("*").alias("n_views"))


def histogram_match(source: DataFrame, target: DataFrame, bins: int = 256) -> DataFrame:
    """value, matched: each source level's first target level whose cumulative share is at least its own.

    Both are tables of integer levels, clamped to [0, bins), so that only histograms of ``bins`` rows meet.
    """
    clamp = lambda df: df.select(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.col("value"))).cast("long").alias("value"))
    source, target = clamp(source), clamp(target)

    def cdf(df: DataFrame, name: str) -> DataFrame:
        h = df.groupBy("value").agg(F.count("*").alias("n"))
        w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return h.select(F.col("value").alias(name), (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())).alias(f"{name}_cdf"))

    s, t = cdf(source, "value"), cdf(target, "level")
    best = s.join(F.broadcast(t), F.col("level_cdf") >= F.col("value_cdf"), "left").groupBy("value").agg(F.min("level").alias("matched"))
    return best


def bilinear(image: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Values at fractional pixels, clamped to the image."""
    h, w = image.shape[:2]
    u, v = np.clip(u, 0, w - 1), np.clip(v, 0, h - 1)
    x, y = np.minimum(u.astype(int), max(w - 2, 0)), np.minimum(v.astype(int), max(h - 2, 0))
    fx, fy = (u - x)[:, None], (v - y)[:, None]
    im = image.reshape(h, w, -1).astype(float)
    x2, y2 = np.minimum(x + 1, w - 1), np.minimum(y + 1, h - 1)
    return im[y, x] * (1 - fx) * (1 - fy) + im[y, x2] * fx * (1 - fy) + im[y2, x] * (1 - fx) * fy + im[y2, x2] * fx * fy


def sample_images(projected: DataFrame, images: DataFrame, method: str = "bilinear") -> DataFrame:
    """pid, image and r, g, b at (u, v). ``images``: image, width, height, pixels (binary, three bytes a pixel,
    row by row). Each image is decoded once for its group of points; unmatched images give no rows."""

    def one(key: tuple, p: pd.DataFrame, im: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(im):
            return pd.DataFrame({"pid": np.zeros(0, np.int64), "image": np.zeros(0, object), "r": np.zeros(0), "g": np.zeros(0), "b": np.zeros(0)})
        r = im.iloc[0]
        a = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3)
        u, v = p["u"].to_numpy(float), p["v"].to_numpy(float)
        c = bilinear(a, u, v) if method == "bilinear" else a[np.clip(np.rint(v), 0, a.shape[0] - 1).astype(int), np.clip(np.rint(u), 0, a.shape[1] - 1).astype(int)].astype(float)
        return pd.DataFrame({"pid": p["pid"].to_numpy(), "image": [key[0]] * len(p), "r": c[:, 0], "g": c[:, 1], "b": c[:, 2]})

    kind = projected.schema["image"].dataType.simpleString()
    return projected.select("pid", "image", "u", "v").groupBy("image").cogroup(images.select("image", "width", "height", "pixels").groupBy("image")).applyInPandas(one, f"pid long, image {kind}, r double, g double, b double")


def flying_pixels(pixels: DataFrame, radius: int, limit: float) -> DataFrame:
    """Pixels (image, px, py, pid, depth) whose depth is off the median of their neighbourhood by more than the limit."""
    around = pixels.select("image", F.col("px").alias("cx"), F.col("py").alias("cy"), F.col("depth").alias("d"))
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    spread = around.select("image", F.explode(F.array(*(F.struct((F.col("cx") + i).alias("px"), (F.col("cy") + j).alias("py")) for i, j in offsets))).alias("o"), "d").select("image", "o.px", "o.py", "d")
    med = spread.join(pixels.select("image", "px", "py"), ["image", "px", "py"], "left_semi").groupBy("image", "px", "py").agg(F.percentile("d", F.lit(0.5)).alias("median"))
    return pixels.join(med, ["image", "px", "py"]).where(F.abs(F.col("depth") - F.col("median")) > limit)


def grey_world(pixels: np.ndarray) -> np.ndarray:
    """White balance of one image: channels scaled to a common mean."""
    mean = pixels.reshape(-1, 3).mean(0)
    return np.clip(pixels * (mean.mean() / np.maximum(mean, 1e-6)), 0, 255).astype(np.uint8)


def vignette(pixels: np.ndarray, strength: float) -> np.ndarray:
    """Brightens towards the corners."""
    h, w = pixels.shape[:2]
    y, x = np.mgrid[0:h, 0:w]
    r2 = ((x - w / 2) ** 2 + (y - h / 2) ** 2) / ((w / 2) ** 2 + (h / 2) ** 2)
    return np.clip(pixels * (1 + strength * r2)[..., None], 0, 255).astype(np.uint8)


def gamma(pixels: np.ndarray, g: float) -> np.ndarray:
    table = np.clip(255 * (np.arange(256) / 255) ** (1 / g), 0, 255).astype(np.uint8)
    return table[pixels]


def stretch(value: str, low: float, high: float) -> Column:
    """Intensity between two limits as grey 50 to 255."""
    return F.greatest(F.lit(50), F.least(F.lit(255), (50 + 205 * (F.col(value) - low) / F.lit(max(high - low, 1e-9))).cast("int")))
