"""Camera models as column expressions: points in the camera frame (x right, y down, z ahead) to pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pinhole(p: Sequence[Column], fx, fy, cx, cy) -> tuple[Column, Column]:
    return F.lit(fx) * p[0] / p[2] + cx, F.lit(fy) * p[1] / p[2] + cy


def fisheye(p: Sequence[Column], fx, fy, cx, cy, k: Sequence[float]) -> tuple[Column, Column]:
    """Four-coefficient polynomial in the angle from the axis."""
    r = F.sqrt(p[0] * p[0] + p[1] * p[1])
    theta = F.atan2(r, p[2])
    t2 = theta * theta
    bent = theta * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))
    scale = F.when(r > 1e-12, bent / r).otherwise(F.lit(0.0))
    return F.lit(fx) * p[0] * scale + cx, F.lit(fy) * p[1] * scale + cy


def unproject(u: Column, v: Column, depth: Column, fx, fy, cx, cy) -> list[Column]:
    return [(u - cx) / fx * depth, (v - cy) / fy * depth, depth]


def visible(depth: Column, u: Column, v: Column, width: int, height: int, near: float = 0.01, far: float | None = None) -> Column:
    """In front and inside the image (half-open pixel bounds)."""
    ok = (depth > near) & (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return ok if far is None else ok & (depth <= far)


def size_depth(f, size: Column, pixels: Column, low: float, high: float) -> Column:
    """Distance of an object of known size, clipped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.lit(f) * size / pixels))


def bearing(heading_degrees: Column, u: Column, fx, cx) -> Column:
    return -F.radians(heading_degrees) + F.atan2(u - cx, F.lit(fx))


def centre_distance(u: Column, v: Column, width: int, height: int) -> Column:
    """0 at the image's centre, 1 at half its size or beyond."""
    dx, dy = (u - width / 2) / (width / 2), (v - height / 2) / (height / 2)
    return F.least(F.lit(1.0), F.sqrt(dx * dx + dy * dy))


def ray_heading(direction: Sequence[Column]) -> Column:
    """Compass bearing of a direction, degrees from north."""
    return F.pmod(F.degrees(F.atan2(direction[0], direction[1])) + 360.0, F.lit(360.0))


def is_back_face(hx: Column, hy: Column, rx: Column, ry: Column, limit: float = -0.3) -> Column:
    return hx * rx + hy * ry < limit


def projection_matrix(m, t: Sequence[Column], fx, fy, cx, cy) -> list[list[Column]]:
    """K [R' | -R't]: three rows of four, for a camera turned by m (camera to world) and standing at t."""
    back = [[m[j][i] for j in range(3)] for i in range(3)]
    shift = [-(r[0] * t[0] + r[1] * t[1] + r[2] * t[2]) for r in back]
    e = [[*r, s] for r, s in zip(back, shift, strict=True)]
    return [[F.lit(fx) * e[0][k] + F.lit(cx) * e[2][k] for k in range(4)], [F.lit(fy) * e[1][k] + F.lit(cy) * e[2][k] for k in range(4)], e[2]]


def project_homogeneous(p: Sequence[Sequence[Column]], v: Sequence[Column]) -> tuple[Column, Column, Column]:
    """u, v and the depth that divided them; only what has a positive depth stands before the camera."""
    h = [r[0] * v[0] + r[1] * v[1] + r[2] * v[2] + r[3] for r in p]
    return h[0] / h[2], h[1] / h[2], h[2]
