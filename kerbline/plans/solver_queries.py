"""Solvers and pipelines, whose results have no SQL form (or one by properties only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generate, solve
from ..operators import registration as REG
from . import bridge as B
from .registry import query


@query()
def ransac_ground(spark: SparkSession, d: str) -> DataFrame:
    return REG.ground_height(B.points(spark, d).select("pid", "x", "y", "z"), 0.2).select("pid", "near_ground")


@query()
def icp_registration(spark: SparkSession, d: str) -> DataFrame:
    """A cloud moved by a known motion and found again: one row with the errors."""
    p = B.donor(spark, d).select("pid", "x", "y", "z")
    moved = p.select("pid", (F.col("x") + 0.23).alias("x"), (F.col("y") - 0.11).alias("y"), (F.col("z") + 0.05).alias("z"))
    m = REG.icp(moved, p, 1.0, 15)
    off = [float(v) for v in m["t"]]
    return spark.createDataFrame([(bool(m["ok"]), abs(off[0] + 0.23) < 0.02, abs(off[1] - 0.11) < 0.02, abs(off[2] + 0.05) < 0.02)], "ok boolean, x_found boolean, y_found boolean, z_found boolean")


@query()
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return REG.gap_fill(B.donor(spark, d).select("pid", "x", "y", "z"), B.recipient(spark, d).select("pid", "x", "y", "z"), 1.0, 0.1, 0.5, 2.0, 3).select("pid")


@query("""
WITH c AS (SELECT cls, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM v_points GROUP BY 1),
q AS (SELECT *, (xx + yy + zz) / 3 AS q, sqrt(((xx - (xx + yy + zz) / 3) ** 2 + (yy - (xx + yy + zz) / 3) ** 2 + (zz - (xx + yy + zz) / 3) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM c),
t AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / p ** 3 / 2 AS r FROM q),
e AS (SELECT *, q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3 + 2.0943951023931953) AS l FROM t),
v AS (SELECT *, xy * yz - xz * (yy - l) AS vx, xy * xz - (xx - l) * yz AS vy, (xx - l) * (yy - l) - xy * xy AS vz FROM e)
SELECT cls, n, round(abs(vx) / sqrt(vx * vx + vy * vy + vz * vz), 5) AS a, round(abs(vy) / sqrt(vx * vx + vy * vy + vz * vz), 5) AS b, round(abs(vz) / sqrt(vx * vx + vy * vy + vz * vz), 5) AS c, round(abs(vx * mx + vy * my + vz * mz) / sqrt(vx * vx + vy * vy + vz * vz), 4) AS d, round(sqrt(greatest(0, l)), 5) AS rmse FROM v
""")
def plane_patches(spark: SparkSession, d: str) -> DataFrame:
    """Plane of each class's points (without signs) and the distance to it."""
    p = solve.plane_patches(B.points(spark, d).select("cls", "x", "y", "z"), "cls")
    return p.select("cls", "n", *(F.round(F.abs(c), 5).alias(c) for c in "abc"), F.round(F.abs("d"), 4).alias("d"), F.round("rmse", 5).alias("rmse"))


@query()
def marking_polylines(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.cluster import dbscan

    p = B.points(spark, d).select("pid", "x", "y", "z")
    return solve.polylines(p.join(dbscan(p, 4.0, 4), "pid"), "cluster", 0.1)


@query("""
WITH t AS (SELECT c_custkey AS id, (c_custkey % 200)::DOUBLE AS x, (c_custkey % 100)::DOUBLE AS y, i / 7.0::DOUBLE AS i, j / 7.0::DOUBLE AS j, (i * 40 + j * 3 + (c_custkey // 10) % 2 * 7) % 256 AS level
  FROM customer, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j))
SELECT id AS object_id, count(*) AS n, sum(level)::BIGINT AS r, round(sum(x + (i - 0.5) * 0.6 * cos(0.3::DOUBLE)), 4) AS x, round(sum(y - (i - 0.5) * 0.6 * sin(0.3::DOUBLE)), 4) AS y, round(sum(3.0 + (0.5 - j) * 0.6), 4) AS z
FROM t WHERE level >= 10 GROUP BY 1
""")
def billboard_points(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the generated points' coordinates and levels for each object."""
    o = B.read(spark, d, "customer").select(F.col("c_custkey").alias("object_id"), (F.floor(F.col("c_custkey") / 10) % 2).alias("texture"), (F.col("c_custkey") % 200).cast("double").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"), F.lit(3.0).alias("z"), F.lit(0.6).alias("size"), F.lit(0.3).alias("heading"))
    k = spark.range(128).select((F.col("id") % 2).alias("texture"), F.floor(F.col("id") / 16).alias("i"), (F.floor(F.col("id") / 2) % 8).alias("j"))
    level = ((F.col("i") * 40 + F.col("j") * 3 + F.col("texture") * 7) % 256).alias("r")
    t = k.select("texture", (F.col("i") / 7.0).alias("i"), (F.col("j") / 7.0).alias("j"), level, level.alias("g"), level.alias("b"))
    total = lambda c: F.round(F.sum(c), 4).alias(c)
    return generate.billboards(o, t).groupBy("object_id").agg(F.count("*").alias("n"), F.sum("r").alias("r"), total("x"), total("y"), total("z"))
