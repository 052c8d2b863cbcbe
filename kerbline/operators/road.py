"""The road along a driven path: path coordinates, the zone between its painted edges, objects moved out of it.

A path is rows (way, seq, pid, x, y) with a unique long pid; ways of fewer than three vertices are left out, as
they have no inner vertex to measure from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial
from .temporal import along_cross, arc_length, tangents


def frames(path: DataFrame) -> DataFrame:
    """way, seq, pid, x, y, s, total and the frame (px, py, tx, ty, ps) of each vertex; both ends borrow their
    neighbour's frame."""
    w = Window.partitionBy("way").orderBy("seq")
    p = tangents(arc_length(path.select("way", "seq", "pid", "x", "y"), "way", ("seq",)), "way", ("seq",))
    own = F.struct(F.col("x").alias("px"), F.col("y").alias("py"), "tx", "ty", F.col("s").alias("ps"))
    every = Window.partitionBy("way")
    p = p.withColumn("_n", F.count("*").over(every)).where("_n >= 3").withColumn("total", F.max("s").over(every))
    at = F.row_number().over(w)
    frame = F.when(at == 1, F.lead(own).over(w)).when(at == F.col("_n"), F.lag(own).over(w)).otherwise(own)
    return p.withColumn("f", frame).select("way", "seq", "pid", "x", "y", "s", "total", "f.*")


def to_path(points: DataFrame, path: DataFrame, reach: float | None = None, size: float = 8.0) -> DataFrame:
    """pid, x, y, way, total, s, t: length along and offset across (left is positive) in the frame of the nearest vertex;
    with a reach, only points nearer than it."""
    f = frames(path)
    if reach is None:
        near = spatial.nearest(points, f, size).select("pid", "near")
    else:
        met = spatial.radius_join(points.select("pid", "x", "y"), f.select("pid", "x", "y"), reach, strict=True)
        near = met.groupBy("pid").agg(F.min(F.struct("d2", "r_pid")).alias("m")).select("pid", F.col("m.r_pid").alias("near"))
    frame = f.select(F.col("pid").alias("near"), "way", "total", "px", "py", "tx", "ty", "ps")
    j = along_cross(points.select("pid", "x", "y").join(near, "pid").join(frame, "near"))
    return j.select("pid", "x", "y", "way", "total", (F.col("ps") + F.col("along")).alias("s"), F.col("cross").alias("t"))


def _bin(s: Column, total: Column, size: float) -> Column:
    last = F.floor(total / size) + 1
    return F.greatest(F.lit(0), F.least(last, F.floor(s / size))).cast("long")


def zone(path: DataFrame, paint: DataFrame, size: float = 2.0, half: float = 4.5, reach: float = 8.0, least: int = 3, enough: int = 20, share: float = 0.02) -> DataFrame:
    """way, bin, left, right: for every ``size`` metres of each way the offsets of the outermost paint (pid, x, y) at
    both sides (``share`` and its complement as quantiles of ``least`` points or more).

    Bins without are interpolated between known ones, beyond them the nearest holds; a side with fewer than two known
    bins, or a way with fewer than ``enough`` points of paint, has the fixed half width."""
    f = to_path(paint, path, reach).withColumn("bin", _bin(F.col("s"), F.col("total"), size))
    t = F.col("t")
    low, high = F.when(t < 0, t), F.when(t > 0, t)
    g = f.groupBy("way", "bin").agg(F.count("*").alias("n"), F.when(F.count(low) >= least, F.percentile(low, F.lit(share))).alias("left"), F.when(F.count(high) >= least, F.percentile(high, F.lit(1 - share))).alias("right"))
    every = frames(path).groupBy("way").agg(F.max("total").alias("total")).select("way", F.explode(F.sequence(F.lit(0).cast("long"), _bin(F.col("total") + size, F.col("total"), size))).alias("bin"))
    j = every.join(g, ["way", "bin"], "left")
    whole = Window.partitionBy("way")
    order = whole.orderBy("bin")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    few = F.coalesce(F.sum("n").over(whole), F.lit(0)) < enough

    def filled(side: str, fixed: float) -> Column:
        known = F.when(F.col(side).isNotNull(), F.struct("bin", F.col(side).alias("v")))
        p, q = F.last(known, True).over(back), F.first(known, True).over(ahead)
        between = p["v"] + (q["v"] - p["v"]) * (F.col("bin") - p["bin"]) / F.greatest(q["bin"] - p["bin"], F.lit(1))
        value = F.when(p.isNull(), q["v"]).when(q.isNull(), p["v"]).otherwise(between)
        return F.when(few | (F.count(side).over(whole) < 2), F.lit(fixed)).otherwise(value).alias(side)

    return j.select("way", "bin", filled("left", -half), filled("right", half))


def push_out(objects: DataFrame, zones: DataFrame, path: DataFrame, margin: float = 0.5, size: float = 2.0) -> DataFrame:
    """pid, x, y, pushed, moved: objects inside the zone, widened by the margin, moved across to its nearer edge (the
    right one in the middle); all others as they are."""
    j = to_path(objects, path).withColumn("bin", _bin(F.col("s"), F.col("total"), size)).join(zones, ["way", "bin"])
    lo, hi = F.col("left") - margin, F.col("right") + margin
    inside = F.col("t").between(lo, hi)
    new = F.when(F.abs(F.col("t") - F.col("left")) < F.abs(F.col("t") - F.col("right")), lo).otherwise(hi)
    j = j.withColumn("pushed", inside).withColumn("new", new).withColumn("at", F.greatest(F.lit(0.0), F.least(F.col("total"), F.col("s")))).withColumn("_c", F.floor(F.col("at") / size))
    # The stretch that ends at a vertex carries its frame; stretches meet the objects by pieces of the way.
    w = Window.partitionBy("way").orderBy("seq")
    stretch = frames(path).withColumn("from", F.lag("s").over(w)).where("from < s").withColumn("_c", F.explode(F.sequence(F.floor(F.col("from") / size), F.floor(F.col("s") / size))))
    stretch = stretch.select(F.col("way").alias("_way"), "_c", "from", F.col("s").alias("to"), "px", "py", "tx", "ty", "ps")
    held = (F.col("at") <= F.col("to")) & ((F.col("at") > F.col("from")) | ((F.col("at") == 0) & (F.col("from") == 0)))
    m = j.join(stretch.withColumnRenamed("_c", "_d"), (F.col("way") == F.col("_way")) & (F.col("_c") == F.col("_d")) & held, "left")
    along = F.col("s") - F.col("ps")
    x = F.col("px") + F.col("tx") * along - F.col("ty") * F.col("new")
    y = F.col("py") + F.col("ty") * along + F.col("tx") * F.col("new")
    return m.select("pid", F.when(F.col("pushed"), x).otherwise(F.col("x")).alias("x"), F.when(F.col("pushed"), y).otherwise(F.col("y")).alias("y"), "pushed", F.when(F.col("pushed"), F.abs(F.col("new") - F.col("t"))).alias("moved"))
