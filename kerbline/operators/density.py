"""DBSCAN by blocks: no pair of points leaves the task that meets it.

A block gets its own points and those within twice the radius of it, so that it knows for sure which points within the
radius of it are cores. It writes a row for each point with the smallest core of its cluster as far as the block sees it;
blocks that share a core are then joined. In a block, points lie in cubes that are so small that all their points are
neighbours: a cube with enough of them has only cores, which are counted no further and linked by one pair a cube.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut
from .graph import components

#: Points that a block may own before smaller ones are taken, and sides of blocks in radii. Fixed values.
CROWD, SIDES = 250_000, (16, 8, 4)
#: Pairs of points looked at together, and pairs of cubes of so many points that a few of them are tried first.
CHUNK, LARGE = 1 << 20, 512

#: What a row says: a core of the block's own; another block's core; own and no core; the same, near several clusters.
CORE, OTHER, PLAIN, SEVERAL = range(4)


class Bins:
    """Points (their numbers) by cube."""

    def __init__(self, key: np.ndarray, chosen: np.ndarray):
        self.points = np.flatnonzero(chosen)
        self.cells, self.start, self.count = np.unique(key[self.points], return_index=True, return_counts=True)

    def meet(self, other: Bins, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the cubes, here and in other, that lie a step apart."""
        at = np.searchsorted(other.cells, self.cells + step)
        here = np.flatnonzero(at < len(other.cells))
        here = here[other.cells[at[here]] == self.cells[here] + step]
        return here, at[here]


def _ranges(a: Bins, b: Bins, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of points (i, j) of cubes x of a and y of b, with the number k of the pair of cubes, CHUNK at most at once."""
    sizes = a.count[x] * b.count[y]
    for k in np.flatnonzero(sizes > CHUNK):
        i, j = a.points[a.start[x[k]] :][: a.count[x[k]]], b.points[b.start[y[k]] :][: b.count[y[k]]]
        for at in range(0, len(j), CHUNK):
            part = j[at : at + CHUNK]
            most = max(1, CHUNK // len(part))
            for lo in range(0, len(i), most):
                q = i[lo : lo + most]
                yield np.repeat(q, len(part)), np.tile(part, len(q)), np.full(len(q) * len(part), k)
    rest = np.flatnonzero(sizes <= CHUNK)
    ends = np.cumsum(sizes[rest])
    lo = 0
    while lo < len(rest):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
        k = rest[lo:hi]
        m = sizes[k]
        inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        k = np.repeat(k, m)
        u, v = np.divmod(inside, b.count[y[k]])
        yield a.points[a.start[x[k]] + u], b.points[b.start[y[k]] + v], k
        lo = hi


def _within(p: np.ndarray, i: np.ndarray, j: np.ndarray, eps: float) -> np.ndarray:
    """The same sum of squares as the joins'."""
    return reduce(lambda s, t: s + t, ((c[i] - c[j]) * (c[i] - c[j]) for c in p)) <= eps * eps


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a and b; every tree stays flat, with its smallest number as root."""
    while True:
        u, v = root[a], root[b]
        if not (apart := u != v).any():
            return
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _link(p: np.ndarray, bins: Bins, steps: list[int], eps: float) -> np.ndarray:
    """The root cube of each cube of cores."""
    root = np.arange(len(bins.cells))
    # Of large cubes sixteen points are tried first, as most pairs of cubes have many pairs within the radius.
    few = Bins.__new__(Bins)
    few.count = np.minimum(bins.count, 16)
    few.start = np.cumsum(few.count) - few.count
    cube = np.repeat(np.arange(len(bins.cells)), few.count)
    few.points = bins.points[bins.start[cube] + (np.arange(len(cube)) - few.start[cube]) * bins.count[cube] // few.count[cube]]
    for step in steps:
        if step < 0:
            continue
        x, y = bins.meet(bins, step)
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        large = bins.count[x] * bins.count[y] > LARGE
        for tried, chosen in ((few, large), (bins, ~large), (bins, large)):
            a, b = x[chosen], y[chosen]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            for i, j, k in _ranges(tried, tried, a, b):
                open_ = root[a[k]] != root[b[k]]
                i, j, k = i[open_], j[open_], k[open_]
                k = np.unique(k[_within(p, i, j, eps)])
                _unite(root, a[k], b[k])
    return root


def block(pid: np.ndarray, p: np.ndarray, n: np.ndarray, own: np.ndarray, near: np.ndarray, eps: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """pid, root, whether it has one, and kind of the rows that a block writes. p has a row for each axis; near are the
    points within the radius of the block, its own among them."""
    side = eps / math.sqrt(len(p)) * (1 - 1e-6)
    cubes = np.floor(p / side).astype(np.int64)
    most = int(1 + math.sqrt(len(p)) * (1 + 1e-5))
    cubes -= cubes.min(1, keepdims=True) - most
    wide = cubes.max(1) + most + 1
    flat = lambda c: reduce(lambda s, t: s * int(t[1]) + t[0], zip(c, wide, strict=True), 0)
    key = flat(cubes)
    order = np.argsort(key, kind="stable")
    key, pid, p, n, own, near = key[order], pid[order], p[:, order], n[order], own[order], near[order]
    gap = lambda o: sum(max(abs(c) - 1, 0) ** 2 for c in o) * side * side
    around = sorted((o for o in itertools.product(range(-most, most + 1), repeat=len(p)) if any(o) and gap(o) <= eps * eps), key=lambda o: sum(c * c for c in o))
    steps = [flat(o) for o in around]

    every = Bins(key, np.ones(len(key), bool))
    total = np.repeat(np.add.reduceat(n, every.start), every.count)
    core = total >= least
    for step in steps:
        todo = Bins(key, near & ~core)
        for i, j, _ in _ranges(todo, every, *todo.meet(every, step)):
            ok = _within(p, i, j, eps)
            np.add.at(total, i[ok], n[j[ok]])
        core = total >= least

    cores = Bins(key, core)
    root = np.empty(0, np.int64)
    if len(cores.points):
        tree = np.repeat(_link(p, cores, steps, eps), cores.count)
        # Only cores within the radius have a block that owns them and says so.
        sure = near[cores.points]
        smallest = np.full(len(cores.cells), np.iinfo(np.int64).max)
        np.minimum.at(smallest, tree[sure], pid[cores.points[sure]])
        root = smallest[tree]
    of = np.zeros(len(key), np.int64)
    of[cores.points] = root

    todo, known = Bins(key, own & ~core), Bins(key, core & near)
    found = [np.empty((0, 2), np.int64)]
    for step in [0, *steps]:
        for i, j, _ in _ranges(todo, known, *todo.meet(known, step)):
            ok = _within(p, i, j, eps)
            found.append(np.unique(np.stack([i[ok], of[j[ok]]], 1), axis=0) if ok.any() else found[0])
    found = np.unique(np.concatenate(found), axis=0)
    several = np.bincount(found[:, 0], minlength=len(key)) if len(found) else np.zeros(len(key), np.int64)
    alone = np.flatnonzero(own & ~core & (several == 0))
    mine, other = np.flatnonzero(own & core), np.flatnonzero(core & near & ~own)
    rows = np.concatenate([mine, other, found[:, 0], alone])
    roots = np.concatenate([of[mine], of[other], found[:, 1], np.zeros(len(alone), np.int64)])
    kind = np.concatenate([np.full(len(mine), CORE), np.full(len(other), OTHER), np.where(several[found[:, 0]] > 1, SEVERAL, PLAIN), np.full(len(alone), PLAIN)])
    return pid[rows], roots, np.arange(len(rows)) < len(rows) - len(alone), kind


def dbscan(points: DataFrame, eps: float, least: int, axes: tuple[str, ...]) -> DataFrame:
    """pid, core, cluster of points (pid, axes, n) with finite positions, n their weight."""
    from .spatial import cell

    names = [f"_b{i}" for i in range(len(axes))]
    for k in SIDES:
        side = eps * k
        most = points.groupBy(*(cell(a, side).alias(b) for a, b in zip(axes, names, strict=True))).count().agg(F.max("count")).first()[0]
        if (most or 0) <= CROWD:
            break
    # Margins of a millionth: a point too many does no harm, and one more is known for sure.
    reach, sure = 2 * eps * (1 + 1e-6), eps * (1 + 1e-7)
    p = points
    for a, b in zip(axes, names, strict=True):
        p = p.withColumn(b, F.explode(F.sequence(cell(F.col(a) - reach, side), cell(F.col(a) + reach, side))))
    p = p.select("pid", *(F.col(a).cast("double").alias(a) for a in axes), F.col("n").cast("long").alias("n"), *names)

    def one(t: pa.Table) -> pa.Table:
        col = lambda c: t.column(c).to_numpy()
        x = np.stack([col(a) for a in axes])
        at = np.array([t.column(b)[0].as_py() for b in names], np.float64)[:, None]
        own = (np.floor(x / side) == at).all(0)
        near = own | ((x >= at * side - sure) & (x <= (at + 1) * side + sure)).all(0)
        pid, root, has, kind = block(col("pid").astype(np.int64), x, col("n").astype(np.int64), own, near, eps, least)
        return pa.table({"pid": pid, "root": pa.array(root, mask=~has), "kind": kind.astype(np.int8)})

    seen = cut(p.groupBy(*names).applyInArrow(one, "pid long, root long, kind byte"))
    links = seen.where(F.col("kind") == OTHER).select("pid", F.col("root").alias("a")).join(seen.where(F.col("kind") == CORE).select("pid", F.col("root").alias("b")), "pid").where("a <> b").select("a", "b").distinct()
    whole = seen.join(cut(components(links)).select(F.col("node").alias("root"), F.col("root").alias("_r")), "root", "left")
    whole = whole.select("pid", "kind", F.coalesce("_r", "root").alias("cluster"))
    once = whole.where(F.col("kind").isin(CORE, PLAIN)).select("pid", (F.col("kind") == CORE).alias("core"), "cluster")
    return once.unionByName(whole.where(F.col("kind") == SEVERAL).groupBy("pid").agg(F.lit(False).alias("core"), F.min("cluster").alias("cluster")))
