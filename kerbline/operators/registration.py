"""Planes and rigid registration. Spark reduces points to moments; a plane or a motion is a few numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut
from . import spatial


def ransac_plane(points: DataFrame, threshold: float, iterations: int = 2000, sample: int = 20_000, seed: int = 0) -> tuple[float, float, float, float]:
    """(a, b, c, d) of unit normal, c >= 0: the plane of most inliers on a seeded sample of a documented size,
    refitted to the inliers of all points from one aggregate of moments."""
    got = spatial.sample(points.select("pid", "x", "y", "z"), sample, seed).orderBy("pid").toPandas()
    p = got[["x", "y", "z"]].to_numpy()
    if len(p) < 3:
        return 0.0, 0.0, 1.0, -float(p[:, 2].mean()) if len(p) else 0.0
    origin = p.mean(0)
    q = p - origin
    rng = np.random.default_rng(seed)
    best, plane = -1, np.array([0.0, 0.0, 1.0, 0.0])
    for _ in range(iterations):
        a, b, c = q[rng.choice(len(q), 3, replace=False)]
        n = np.cross(b - a, c - a)
        size = np.linalg.norm(n)
        if size < 1e-12:
            continue
        n = n / size
        inliers = int((abs((q - a) @ n) < threshold).sum())
        if inliers > best:
            best, plane = inliers, np.append(n, -(a @ n))
    return refit_plane(points, plane, origin, threshold)


def refit_plane(points: DataFrame, plane: np.ndarray, origin: np.ndarray, threshold: float) -> tuple[float, float, float, float]:
    """Least squares over all points within the threshold of a plane given about a local origin."""
    u = {c: F.col(c) - float(o) for c, o in zip("xyz", origin, strict=True)}
    dist = F.abs(float(plane[0]) * u["x"] + float(plane[1]) * u["y"] + float(plane[2]) * u["z"] + float(plane[3]))
    near = points.where(dist < threshold).select(*(u[c].alias(c) for c in "xyz"))
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    m = near.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"), *(F.covar_pop(a, b).alias(a + b) for a, b in pairs)).first()
    n = plane[:3]
    centre = np.zeros(3)
    if m["n"] >= 3:
        s = np.array([[m["xx"], m["xy"], m["xz"]], [m["xy"], m["yy"], m["yz"]], [m["xz"], m["yz"], m["zz"]]])
        n, centre = np.linalg.eigh(s)[1][:, 0], np.array([m["x"], m["y"], m["z"]])
    else:
        centre = -plane[3] * n
    n = n if n[2] >= 0 else -n
    return float(n[0]), float(n[1]), float(n[2]), float(-(n @ (centre + origin)))


def is_horizontal(plane: tuple[float, ...], least: float = 0.8) -> bool:
    return abs(plane[2]) >= least


def ground_height(points: DataFrame, threshold: float = 0.2, least: float = 0.8) -> DataFrame:
    """Adds ``near_ground``: within the threshold of the plane if it is level enough, else below the 15th percentile."""
    from ..functions.geometry import plane_distance

    plane = ransac_plane(points, threshold)
    if is_horizontal(plane, least):
        return points.withColumn("near_ground", plane_distance(*plane) < threshold)
    low = None if points.isEmpty() else spatial.quantiles(points, "z", (0.15,))[0]
    return points.withColumn("near_ground", F.col("z") <= float(low if low is not None else 0.0))


def kabsch(pairs: DataFrame, axes: str = "xyz") -> tuple[np.ndarray, np.ndarray, float, int]:
    """(R, t, rmse, n) that takes columns x, y, z best onto q_x, q_y, q_z, from one aggregate of moments."""
    m = pairs.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"p{c}") for c in axes), *(F.avg(f"q_{c}").alias(f"q{c}") for c in axes), *(F.covar_pop(a, f"q_{b}").alias(f"h{a}{b}") for a in axes for b in axes), *(F.var_pop(c).alias(f"vp{c}") for c in axes), *(F.var_pop(f"q_{c}").alias(f"vq{c}") for c in axes)).first()
    k = len(axes)
    if m["n"] < k:
        return np.eye(k), np.zeros(k), float("nan"), int(m["n"])
    h = np.array([[m[f"h{a}{b}"] for b in axes] for a in axes])
    u, s, vt = np.linalg.svd(h)
    d = np.diag([1.0] * (k - 1) + [np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    r = vt.T @ d @ u.T
    t = np.array([m[f"q{c}"] for c in axes]) - r @ np.array([m[f"p{c}"] for c in axes])
    left = sum(m[f"vp{c}"] + m[f"vq{c}"] for c in axes) - 2 * float((s * np.diag(d)).sum())
    return r, t, float(np.sqrt(max(0.0, left))), int(m["n"])


def icp(moving: DataFrame, fixed: DataFrame, gate: float = 1.5, iterations: int = 25, least: int = 100, axes: str = "xyz", tolerance: float = 1e-5) -> dict:
    """Rigid motion of ``moving`` onto ``fixed`` (both pid, x, y, z): nearest partners by cells, motion from moments.

    Works about a local origin. Returns R, t (about the origin), origin, rmse, n and whether enough pairs were found.
    """
    o = fixed.agg(*(F.avg(c) for c in axes)).first()
    origin = np.array([float(v or 0.0) for v in o])
    local = lambda df: df.select("pid", *((F.col(c) - float(v)).alias(c) for c, v in zip(axes, origin, strict=True)))
    m, f = cut(local(moving)), cut(local(fixed))
    k = len(axes)
    r, t, rmse, n = np.eye(k), np.zeros(k), float("nan"), 0
    for _ in range(iterations):
        now = m.select("pid", *(sum((F.lit(float(r[i, j])) * F.col(c) for j, c in enumerate(axes)), F.lit(float(t[i]))).alias(a) for i, a in enumerate(axes)))
        met = spatial.radius_join(now, f, gate, tuple(axes))
        best = met.groupBy("pid").agg(F.min(F.struct("d2", *(F.col(f"r_{c}").alias(f"q_{c}") for c in axes), *axes)).alias("b")).select("b.*")
        dr, dt, rmse, n = kabsch(best, axes)
        if n < least:
            return {"R": r, "t": t, "origin": origin, "rmse": rmse, "n": n, "ok": False}
        r, t = dr @ r, dr @ t + dt
        if np.abs(dr - np.eye(k)).max() < tolerance and np.abs(dt).max() < tolerance:
            break
    return {"R": r, "t": t, "origin": origin, "rmse": rmse, "n": n, "ok": True}


def move(points: DataFrame, motion: dict, axes: str = "xyz") -> DataFrame:
    """Points after a motion from ``icp``."""
    from ..functions.rotation import lit

    o, m, t = motion["origin"], lit(motion["R"]), motion["t"]
    for i, a in enumerate(axes):
        points = points.withColumn(f"_{a}", sum((m[i][j] * (F.col(c) - float(o[j])) for j, c in enumerate(axes)), F.lit(float(o[i] + t[i]))))
    return points.drop(*axes).withColumnsRenamed({f"_{a}": a for a in axes})


def gap_fill(donor: DataFrame, recipient: DataFrame, gate: float = 0.4, thin: float = 0.1, voxel: float = 0.3, eps: float = 0.5, least: int = 5) -> DataFrame:
    """Donor points without a recipient point within the gate, less those of sparse clusters."""
    from .cluster import representative_dbscan

    thinned = spatial.voxel_first(recipient.select("pid", "x", "y", "z"), thin).select("pid", "x", "y", "z")
    gap = cut(spatial.radius_join(donor, thinned, gate, ("x", "y", "z"), "left_anti"))
    return gap.join(representative_dbscan(gap, voxel, eps, least).where("cluster IS NOT NULL").select("pid"), "pid", "left_semi")
