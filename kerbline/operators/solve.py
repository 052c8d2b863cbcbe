"""Solvers: small dense linear algebra on bounded groups, with the sums over points made by Spark.

Planes, rigid motions and pose graphs end in a few numbers; what is large is reduced by built-in
aggregates first, and only moments or a documented sample reach the driver or a Python group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spatial


def spline_coefficients(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the not-a-knot cubic spline (at least 4 distinct, increasing t)."""
    n, h = len(t), np.diff(t)
    a, r = np.zeros((n, n)), np.zeros(n)
    slope = np.diff(y) / h
    for i in range(1, n - 1):
        a[i, i - 1], a[i, i], a[i, i + 1] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    return np.linalg.solve(a, r)


def spline_at(t: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Position, velocity and acceleration (columns) at times clamped to the ends."""
    at = np.clip(at, t[0], t[-1])
    i = np.clip(np.searchsorted(t, at, "right") - 1, 0, len(t) - 2)
    h = t[i + 1] - t[i]
    a, b = (t[i + 1] - at) / h, (at - t[i]) / h
    position = a * y[i] + b * y[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * h * h / 6
    velocity = (y[i + 1] - y[i]) / h + ((1 - 3 * a * a) * m[i] + (3 * b * b - 1) * m[i + 1]) * h / 6
    return np.stack([position, velocity, a * m[i] + b * m[i + 1]], 1)


def spline_track(track: DataFrame, by: str, time: str, axes: tuple[str, ...], window: int = 512) -> DataFrame:
    """by, t and, for each axis, position, velocity and acceleration midway between neighbouring rows.

    Splines are fitted to windows of ``window`` rows with 16 rows of overlap on both sides, so that a
    group is bounded however long the track is; the influence of a row fades within a few rows. Rows
    of equal time count once (the first); windows of fewer than 4 rows give none.
    """
    from pyspark.sql import Window

    rows = track.groupBy(by, time).agg(*(F.min(a).alias(a) for a in axes))
    rn = F.row_number().over(Window.partitionBy(by).orderBy(time)) - 1
    n = F.count("*").over(Window.partitionBy(by))
    rows = rows.withColumn("_rn", rn).withColumn("_n", n)
    part = F.floor(F.col("_rn") / window)
    rows = rows.withColumn("_w", F.explode(F.array_distinct(F.array(F.floor(F.greatest(F.lit(0), F.col("_rn") - 16) / window), part, F.floor((F.col("_rn") + 16) / window)))))
    out = f"{by} {track.schema[by].dataType.simpleString()}, t double, " + ", ".join(f"{a} double, v{a} double, a{a} double" for a in axes)

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_rn")
        empty = pd.DataFrame({c.split()[0]: [] for c in out.split(", ")})
        if len(g) < 4:
            return empty
        t0 = g[time].iloc[0]
        t = (g[time] - t0).to_numpy(float) / 1e6
        own = (g["_rn"] // window == key[1]).to_numpy()
        mid = ((t[:-1] + t[1:]) / 2)[own[:-1]]
        data = {by: [key[0]] * len(mid), "t": mid + t0 / 1e6}
        for a in axes:
            y = g[a].to_numpy(float)
            p = spline_at(t, y, spline_coefficients(t, y), mid)
            data |= {a: p[:, 0], f"v{a}": p[:, 1], f"a{a}": p[:, 2]}
        return pd.DataFrame(data)

    return rows.groupBy(by, "_w").applyInPandas(fit, out)


def fit_plane(p: np.ndarray) -> dict[str, float]:
    """Orthogonal plane fit with equal weights (the Gauss-Helmert solution): normal, offset, rmse and the
    standard deviation of the offset. Fewer than 3 points, or points on a line, give nan."""
    nan = dict.fromkeys(("a", "b", "c", "d", "rmse", "sd"), float("nan"))
    if len(p) < 3:
        return nan
    m = p.mean(0)
    w, v = np.linalg.eigh((p - m).T @ (p - m) / len(p))
    if w[1] < 1e-14:
        return nan
    n = v[:, 0] if v[2, 0] >= 0 else -v[:, 0]
    rest = float(max(0.0, w[0]) * len(p))
    sigma = (rest / max(1, len(p) - 3)) ** 0.5
    return {"a": n[0], "b": n[1], "c": n[2], "d": float(-n @ m), "rmse": (rest / len(p)) ** 0.5, "sd": sigma / len(p) ** 0.5}


def plane_patches(points: DataFrame, by: str, largest: int = 100_000) -> DataFrame:
    """by, n, a, b, c, d, rmse of each patch's plane, from moments only: patches may be of any size."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    g = points.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"), *(F.covar_pop(a, b).alias(a + b) for a, b in pairs))
    kind = points.schema[by].dataType.simpleString()

    def solve(batches):
        for f in batches:
            out = []
            for r in f.itertuples():
                s = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
                w, v = np.linalg.eigh(s)
                n = v[:, 0] if v[2, 0] >= 0 else -v[:, 0]
                ok = r.n >= 3 and w[1] > 1e-14
                out.append((getattr(r, by), r.n, *(map(float, n) if ok else [float("nan")] * 3), float(-(n @ [r.x, r.y, r.z])) if ok else float("nan"), float(max(0, w[0])) ** 0.5 if ok else float("nan")))
            yield pd.DataFrame(out, columns=[by, "n", "a", "b", "c", "d", "rmse"])

    return g.mapInPandas(solve, f"{by} {kind}, n long, a double, b double, c double, d double, rmse double")


def refine_point(start: np.ndarray, cameras: np.ndarray, rotations: np.ndarray, pixels: np.ndarray, k: tuple[float, float, float, float], delta: float = 80.0, sigma: float = 15.0, steps: int = 8) -> tuple[np.ndarray, float, float, int]:
    """Position that minimises Huber-weighted reprojection errors (Gauss-Newton): position, rms before, rms after, n.

    cameras (n, 3) and rotations (n, 3, 3) take x to R^T (x - c); pixels (n, 2); k = fx, fy, cx, cy.
    """
    fx, fy, cx, cy = k

    def errors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = np.einsum("nji,nj->ni", rotations, x - cameras)
        ok = q[:, 2] > 1e-6
        z = np.where(ok, q[:, 2], 1.0)
        e = np.stack([fx * q[:, 0] / z + cx, fy * q[:, 1] / z + cy], 1) - pixels
        j = np.zeros((len(q), 2, 3))
        j[:, 0, 0], j[:, 0, 2], j[:, 1, 1], j[:, 1, 2] = fx / z, -fx * q[:, 0] / z**2, fy / z, -fy * q[:, 1] / z**2
        return e, np.einsum("nab,ncb->nac", j, rotations), ok

    rms = lambda e, ok: float(np.sqrt((e[ok] ** 2).sum(1).mean())) if ok.any() else float("nan")
    x = start.astype(float)
    e, j, ok = errors(x)
    before = rms(e, ok)
    for _ in range(steps):
        if ok.sum() < 2:
            break
        size = np.linalg.norm(e, axis=1)
        w = np.where(size > delta, delta / np.maximum(size, 1e-12), 1.0) * ok / sigma**2
        a, b = np.einsum("n,nai,naj->ij", w, j, j), np.einsum("n,nai,na->i", w, j, e)
        step = np.linalg.lstsq(a, -b, rcond=None)[0]
        x = x + step
        e, j, ok = errors(x)
        if np.linalg.norm(step) < 1e-4:
            break
    return x, before, rms(e, ok), int(ok.sum())


def refine_objects(observations: DataFrame, k: tuple[float, float, float, float]) -> DataFrame:
    """object_id, x, y, z, rms_before, rms_after, n: each object's own problem; observations (object_id, sx, sy,
    sz, cam array, rot array of 9, u, v) of one object fit in a task."""

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x, b, a, n = refine_point(g[["sx", "sy", "sz"]].iloc[0].to_numpy(float), np.stack(g["cam"].to_numpy()), np.stack(g["rot"].to_numpy()).reshape(-1, 3, 3), g[["u", "v"]].to_numpy(float), k)
        return pd.DataFrame({"object_id": [key[0]], "x": [x[0]], "y": [x[1]], "z": [x[2]], "rms_before": [b], "rms_after": [a], "n": [n]})

    return observations.groupBy("object_id").applyInPandas(one, "object_id long, x double, y double, z double, rms_before double, rms_after double, n long")


def _pose(p: np.ndarray) -> np.ndarray:
    c, s = np.cos(p[2]), np.sin(p[2])
    return np.array([[c, -s, p[0]], [s, c, p[1]], [0, 0, 1]])


def _dense(n: int, ei: np.ndarray, ej: np.ndarray, ja: np.ndarray, jb: np.ndarray, w: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The step of a small graph by one dense solve; the least one where parts of it hang on nothing."""
    h = np.zeros((n, n, 3, 3))
    for p, jp in ((ei, ja), (ej, jb)):
        for q, jq in ((ei, ja), (ej, jb)):
            np.add.at(h, (p, q), np.einsum("nba,nbc,ncd->nad", jp, w, jq))
    h[0], h[:, 0], h[0, 0] = 0, 0, np.eye(3)
    full = h.transpose(0, 2, 1, 3).reshape(3 * n, 3 * n)
    return np.linalg.lstsq(full, g.reshape(-1), rcond=None)[0].reshape(n, 3)


def pose_graph(poses: np.ndarray, edges: list[tuple[int, int, np.ndarray, np.ndarray]], steps: int = 20, delta: float = 3.0) -> np.ndarray:
    """Plane poses (n, 3) that best agree with relative measurements (i, j, (dx, dy, dyaw), information 3x3):
    Gauss-Newton with Huber weights, the first pose fixed. Beyond 400 poses conjugate gradients, no dense matrix."""
    x = poses.astype(float).copy()
    n = len(x)
    ei, ej = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    z, info = np.stack([e[2] for e in edges]).astype(float), np.stack([e[3] for e in edges]).astype(float)
    wrap = lambda a: (a + np.pi) % (2 * np.pi) - np.pi
    for _ in range(steps):
        a, b = x[ei], x[ej]
        c, s = np.cos(a[:, 2]), np.sin(a[:, 2])
        d = b[:, :2] - a[:, :2]
        e = np.stack([c * d[:, 0] + s * d[:, 1] - z[:, 0], -s * d[:, 0] + c * d[:, 1] - z[:, 1], wrap(b[:, 2] - a[:, 2] - z[:, 2])], 1)
        zero, one = np.zeros_like(c), np.ones_like(c)
        ja = np.stack([np.stack([-c, -s, -s * d[:, 0] + c * d[:, 1]], 1), np.stack([s, -c, -c * d[:, 0] - s * d[:, 1]], 1), np.stack([zero, zero, -one], 1)], 1)
        jb = np.stack([np.stack([c, s, zero], 1), np.stack([-s, c, zero], 1), np.stack([zero, zero, one], 1)], 1)
        size = np.sqrt(np.maximum(np.einsum("na,nab,nb->n", e, info, e), 1e-18))
        w = info * np.where(size > delta, delta / size, 1.0)[:, None, None]

        def times(v: np.ndarray, ja=ja, jb=jb, w=w) -> np.ndarray:
            r = np.einsum("nab,nbc,nc->na", w, ja, v[ei]) + np.einsum("nab,nbc,nc->na", w, jb, v[ej])
            out = np.zeros_like(v)
            np.add.at(out, ei, np.einsum("nba,nb->na", ja, r))
            np.add.at(out, ej, np.einsum("nba,nb->na", jb, r))
            out[0] = v[0]
            return out

        g = np.zeros((n, 3))
        np.add.at(g, ei, -np.einsum("nba,nbc,nc->na", ja, w, e))
        np.add.at(g, ej, -np.einsum("nba,nbc,nc->na", jb, w, e))
        g[0] = 0
        step, r = (_dense(n, ei, ej, ja, jb, w, g) if n <= 400 else np.zeros_like(g)), g.copy()
        p, rr = r.copy(), float((r * r).sum())
        enough = max(1e-20, 1e-18 * rr)
        for _ in range(20 * n if n > 400 else 0):
            if rr < enough:
                break
            ap = times(p)
            alpha = rr / max(float((p * ap).sum()), 1e-300)
            step += alpha * p
            r -= alpha * ap
            new = float((r * r).sum())
            p, rr = r + new / rr * p, new
        x += step
        x[:, 2] = wrap(x[:, 2])
        if np.abs(step).max() < 1e-8:
            break
    return x


def simplify(line: np.ndarray, tolerance: float, run: int = 256) -> np.ndarray:
    """Douglas-Peucker without recursion: indices of the kept vertices. Of long stretches only those runs of vertices are
    looked at whose box reaches as far from the chord as the farthest vertex found, which gives the same vertex (ties to the
    first)."""
    keep, todo = np.zeros(len(line), bool), [(0, len(line) - 1)]
    keep[[0, -1]] = True
    starts = np.arange(0, len(line), run)
    low, high = np.minimum.reduceat(line, starts), np.maximum.reduceat(line, starts)
    middle, half = (low + high) / 2.0, (high - low) / 2.0
    inside = np.arange(run)

    def away(at: np.ndarray | slice, a: int, d: np.ndarray, size: float) -> np.ndarray:
        p = line[at] - line[a]
        return np.abs(p[:, 0] * d[1] - p[:, 1] * d[0]) / size if size > 0 else np.linalg.norm(p, axis=1)

    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = line[b] - line[a]
        size = np.linalg.norm(d)
        first, last = -(-(a + 1) // run), b // run
        if last - first < 16 or size == 0:
            at: np.ndarray | slice = slice(a + 1, b)
            far = away(at, a, d, size)
            i = int(far.argmax())
            far, i = far[i], a + 1 + i
        else:
            p, h = middle[first:last] - line[a], half[first:last]
            # Rounding is allowed for, so that no run is left out that ties.
            room = (np.abs(p) + h) * np.abs(d[::-1])
            reach = (np.abs(p[:, 0] * d[1] - p[:, 1] * d[0]) + h[:, 0] * abs(d[1]) + h[:, 1] * abs(d[0]) + 1e-12 * room.sum(1)) / size
            ends = np.concatenate([np.arange(a + 1, first * run), np.arange(last * run, b)])
            best = away((first + int(reach.argmax())) * run + inside, a, d, size).max()
            runs = first + np.flatnonzero(reach >= best)
            at = np.sort(np.concatenate([ends, (runs[:, None] * run + inside).ravel()]))
            far = away(at, a, d, size)
            i = int(far.argmax())
            far, i = far[i], int(at[i])
        if far > tolerance:
            keep[i] = True
            todo += [(a, i), (i, b)]
    return np.flatnonzero(keep)


def polylines(points: DataFrame, by: str = "cluster", tolerance: float = 0.10) -> DataFrame:
    """by, seq, x, y, z: each cluster's points in order of their principal axis, simplified. Points at one place are one
    with their number as its weight; a cluster's places fit in a task."""
    kind = points.schema[by].dataType.simpleString()

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pid")
        p, n = g[["x", "y", "z"]].to_numpy(float), g["n"].to_numpy(float)
        q = p[:, :2] - np.average(p[:, :2], 0, n)
        axis = np.linalg.eigh(q.T @ (q * n[:, None]))[1][:, -1]
        p = p[np.argsort(q @ axis, kind="stable")]
        p = p[simplify(p[:, :2], tolerance)]
        return pd.DataFrame({by: key[0], "seq": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    places = points.where(F.col(by).isNotNull()).groupBy(by, "x", "y", "z").agg(F.min("pid").alias("pid"), F.count("*").alias("n"))
    return places.groupBy(by).applyInPandas(one, f"{by} {kind}, seq long, x double, y double, z double")


def hand_eye(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """X of A X = X B from pairs of 4x4 motions (two at least, with different axes): rotation from the aligned
    rotation vectors, translation by least squares."""

    def vector(r: np.ndarray) -> np.ndarray:
        t = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
        v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
        return v * (0.5 if t < 1e-8 else t / (2 * np.sin(t)))

    u, _, vt = np.linalg.svd(sum(np.outer(vector(q[:3, :3]), vector(p[:3, :3])) for p, q in zip(a, b, strict=True)))
    r = vt.T @ np.diag([1, 1, np.linalg.det(vt.T @ u.T)]) @ u.T
    left = np.concatenate([p[:3, :3] - np.eye(3) for p in a])
    right = np.concatenate([r @ q[:3, 3] - p[:3, 3] for p, q in zip(a, b, strict=True)])
    x = np.eye(4)
    x[:3, :3], x[:3, 3] = r, np.linalg.lstsq(left, right, rcond=None)[0]
    return x


def cross_pass(observations: DataFrame, k: tuple[float, float, float, float], least: int = 2, trust: float = 100.0) -> DataFrame:
    """object_id, n1, n2, rms1, rms2, horizontal, spatial, trusted: each object solved from either pass (``pass`` is 1 or
    2) by itself, and how far apart the two places lie. Objects without ``least`` observations in both have no row;
    trusted are those whose two solutions both agree with their images."""
    split = observations.where("pass IN (1, 2)")
    enough = split.groupBy("object_id").agg(F.count_if(F.col("pass") == 1).alias("_a"), F.count_if(F.col("pass") == 2).alias("_b")).where((F.col("_a") >= least) & (F.col("_b") >= least))
    own = split.join(enough.select("object_id"), "object_id", "left_semi").withColumn("object_id", F.col("object_id") * 2 + F.col("pass") - 1)
    r = refine_objects(own, k).select(F.floor(F.col("object_id") / 2).alias("object_id"), F.pmod("object_id", F.lit(2)).alias("side"), "x", "y", "z", "rms_after", "n")
    one = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    g = r.groupBy("object_id").agg(*(one(c, s).alias(f"{c}{s + 1}") for c in ("x", "y", "z", "n", "rms_after") for s in (0, 1)))
    d = [F.col(f"{a}1") - F.col(f"{a}2") for a in "xyz"]
    flat = d[0] * d[0] + d[1] * d[1]
    ok = lambda s: F.coalesce(~F.isnan(f"rms_after{s}") & (F.col(f"rms_after{s}") < trust), F.lit(False))
    return g.select("object_id", "n1", "n2", F.col("rms_after1").alias("rms1"), F.col("rms_after2").alias("rms2"), F.sqrt(flat).alias("horizontal"), F.sqrt(flat + d[2] * d[2]).alias("spatial"), (ok(1) & ok(2)).alias("trusted"))


def solve_pose_graphs(nodes: DataFrame, edges: DataFrame, steps: int = 20, delta: float = 3.0) -> DataFrame:
    """graph, node, x, y, yaw: every graph's poses after ``pose_graph``; nodes (graph, node, x, y, yaw), edges (graph, a,
    b, dx, dy, dyaw, info: nine numbers row by row, null for the identity). The smallest node stays. Graphs are solved
    side by side, each in one task, sparse. Graphs without edges keep their poses; an edge to a node that is not there
    is left out."""

    def one(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("node")
        place = {v: i for i, v in enumerate(n["node"])}
        known = [(place[r.a], place[r.b], np.array([r.dx, r.dy, r.dyaw]), np.eye(3) if r.info is None else np.array(r.info, float).reshape(3, 3)) for r in e.itertuples() if r.a in place and r.b in place]
        x = n[["x", "y", "yaw"]].to_numpy(float)
        x = pose_graph(x, known, steps, delta) if known else x
        return pd.DataFrame({"graph": key[0], "node": n["node"], "x": x[:, 0], "y": x[:, 1], "yaw": x[:, 2]})

    sides = nodes.select("graph", "node", "x", "y", "yaw").groupBy("graph").cogroup(edges.select("graph", "a", "b", "dx", "dy", "dyaw", "info").groupBy("graph"))
    return sides.applyInPandas(one, f"graph {nodes.schema['graph'].dataType.simpleString()}, node long, x double, y double, yaw double")
