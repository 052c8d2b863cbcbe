"""Rule predicates and CASE chains; thresholds are arguments, so every variant is a set of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_gates(min_w: float, min_h: float, image_h: float, max_cy: float, low: float, high: float, score: float) -> Column:
    """Size, height in the image, aspect and score of a candidate box."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return (w >= min_w) & (h >= min_h) & ((F.col("y1") + F.col("y2")) / 2.0 <= max_cy * image_h) & (w / h.cast("double")).between(low, high) & (F.col("score") >= score)


def status_colour(kind: Column, back_face: Column, source: Column, status: Column) -> Column:
    """Colour of an object's points: poles by their verification status, signs and lights by how they were found."""
    pole = F.when(status == "probable_sign", "pink").when(status == "adjacent_to_detection", "amber").otherwise("cyan")
    found = F.when(source == "camera_only_unverified", "orange")
    sign = F.when(back_face, "purple").otherwise(F.coalesce(found, F.lit("red")))
    return F.when(kind == "pole", pole).when(kind == "sign", sign).when(kind == "light", F.coalesce(found, F.lit("yellow")))


def detection_filter(kind: Column, score: Column, n: Column, width: Column, height: Column, away: Column, unverified: Column, limits: tuple[int, float, float, float, float, float], strict: bool) -> Column:
    """The first rule that drops a localised detection, or 'kept'. limits: points, least and largest width, height,
    distance from the first estimate, confidence of signs.

    Unverified detections are exempt from all rules of geometry, or with ``strict`` only from those of points and
    width; a cluster without points has no width to judge there. A distance of zero is none."""
    points, narrow, wide, low, far, sure = limits
    seen = ~unverified
    judged = F.lit(True) if strict else seen
    off = seen & ~width.between(narrow, wide)
    return (
        F.when(seen & (n < points), "points")
        .when(off & (n > 0) if strict else off, "width")
        .when(judged & (height < low), "height")
        .when(judged & (away > far) & (away > 0), "distance")
        .when((kind == "sign") & (F.coalesce(score, F.lit(0.0)) < sure), "confidence")
        .otherwise("kept")
    )


def tire_like(mean_aspect: Column, best_confidence: Column) -> Column:
    """Groups of sign detections that look like wheels."""
    return (mean_aspect < 1.25) & (best_confidence < 0.85)


def plausible_range(measured: Column, assumed: Column, span: Column) -> Column:
    """Whether a measured distance may replace one assumed from the size: of a compact object, and not far beyond it."""
    return (measured <= 2.5 * assumed) & (span <= 2.0)


def localised(kind: Column, height: Column, width: Column, gap: Column, light: tuple[float, float, float], sign: tuple[float, float, float, float]) -> Column:
    """Gates of clusters near an object: lights by (height, width, gap), signs by (height, width, gap, ratio)."""
    ok_light = (height >= light[0]) & (width <= light[1]) & (gap <= light[2])
    ok_sign = (height >= sign[0]) & (width <= sign[1]) & (gap <= sign[2]) & ((width <= 0.1) | (height / width >= sign[3]))
    return F.when(kind == "light", ok_light).otherwise(ok_sign)


def position_score(kind: Column, height: Column, width: Column, distance: Column) -> Column:
    """Larger is better, among the clusters near an object."""
    return F.when(kind == "light", height / (distance + 1)).otherwise(height / (width + 0.1) / (distance + 1))


def white_paint(r: Column, g: Column, b: Column, intensity: Column, bright: float, strong: float, grey: float = 0.80) -> Column:
    """Colourless, bright and strongly reflecting: paint of road markings."""
    return (F.least(r, g, b) / (F.greatest(r, g, b) + 1e-6) > grey) & ((r + g + b) / 3.0 > bright) & (intensity > strong)


def green(r: Column, g: Column, b: Column, dark: float, lead: float = 1.12) -> Column:
    """Green before red and blue, and not dark: plants."""
    return (g > r * lead) & (g > b * lead) & ((r + g + b) / 3.0 > dark)


def ground_mask(plane_gap: Column, z: Column, local: Column, ground: float, near: float = 0.25, near_local: float = 0.30, below: float = -0.10) -> Column:
    """Near the plane, near the local ground (null: there is none), or below everything."""
    return (plane_gap < near) | F.coalesce(F.abs(z - local) < near_local, F.lit(False)) | (z < ground + below)


def noise_keep(z: Column, ground: float, low: float | None, high: float | None) -> Column:
    """Whether a point of no cluster stays: between two heights above ground; without ``high`` never."""
    if high is None:
        return F.lit(False)
    return (z < ground + high) if low is None else (z > ground + low) & (z < ground + high)
