"""Joins with dimensions, pose and camera expressions, status rules: more operators with exact oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera as CAM
from ..functions import classes as CLS
from ..functions import geo as G
from ..functions import rotation as R
from ..functions import rules
from ..operators import objects as O
from ..operators import spatial as S
from . import bridge as B
from .registry import query


@query("SELECT p.pid, s.serial, round(p.x - s.x, 6) AS dx FROM v_points p JOIN v_shots s ON s.image = p.pid")
def image_equi_join(spark: SparkSession, d: str) -> DataFrame:
    s = B.shots(spark, d).select(F.col("image").alias("pid"), "serial", F.col("x").alias("sx"))
    return B.points(spark, d).join(s, "pid").select("pid", "serial", F.round(F.col("x") - F.col("sx"), 6).alias("dx"))


@query("SELECT image, serial, CASE serial WHEN 0 THEN 700.0 WHEN 1 THEN 710.0 ELSE 650.0 END::DOUBLE AS fx, serial <= 1 AS known FROM v_shots")
def intrinsics_or_default(spark: SparkSession, d: str) -> DataFrame:
    k = spark.createDataFrame([(0, 700.0), (1, 710.0)], "serial long, fx double")
    return B.shots(spark, d).join(k, "serial", "left").select("image", "serial", F.coalesce("fx", F.lit(650.0)).alias("fx"), F.col("fx").isNotNull().alias("known"))


_ANGLES = "SELECT pid, radians(x) AS a, radians(y / 2) AS b, radians(z * 30) AS c FROM v_points"


def _angles(spark: SparkSession, d: str) -> DataFrame:
    return B.points(spark, d).select("pid", F.radians("x").alias("a"), F.radians(F.col("y") / 2).alias("b"), F.radians(F.col("z") * 30).alias("c"))


@query(f"""SELECT pid, round(cos(c) * cos(b), 9) AS r00, round(cos(c) * sin(b) * sin(a) - sin(c) * cos(a), 9) AS r01, round(cos(c) * sin(b) * cos(a) + sin(c) * sin(a), 9) AS r02,
round(sin(c) * cos(b), 9) AS r10, round(-sin(b), 9) AS r20, round(cos(b) * sin(a), 9) AS r21, round(cos(b) * cos(a), 9) AS r22 FROM ({_ANGLES})""")
def euler_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = R.euler_zyx(F.col("a"), F.col("b"), F.col("c"))
    return _angles(spark, d).select("pid", *(F.round(m[i][j], 9).alias(f"r{i}{j}") for i, j in ((0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (2, 1), (2, 2))))


@query(f"SELECT pid, round(cos(t / 2), 9) AS w, round(sin(t / 2), 9) AS z FROM (SELECT pid, c * 0.25::DOUBLE AS t FROM ({_ANGLES}) WHERE c BETWEEN 0.1 AND 3.0)")
def slerp_about_up(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the way from no rotation to one about the vertical."""
    a = _angles(spark, d).where(F.col("c").between(0.1, 3.0))
    end = [F.cos(F.col("c") / 2), F.lit(0.0), F.lit(0.0), F.sin(F.col("c") / 2)]
    q = R.slerp([F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)], end, F.lit(0.25))
    return a.select("pid", F.round(q[0], 9).alias("w"), F.round(q[3], 9).alias("z"))


@query("""WITH e AS (SELECT osm_id, radians(lat) AS p, radians(lon) AS l, 6378137.0::DOUBLE / sqrt(1 - 0.0066943799901413165 * sin(radians(lat)) ** 2) AS n FROM v_entities)
SELECT osm_id, round((n + 60.0) * cos(p) * cos(l), 3) AS x, round((n + 60.0) * cos(p) * sin(l), 3) AS y, round((n * (1 - 0.0066943799901413165) + 60.0) * sin(p), 3) AS z FROM e""")
def geocentric(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = G.to_geocentric(F.col("lon"), F.col("lat"), F.lit(60.0))
    return B.entities(spark, d).select("osm_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


@query("SELECT id, round(greatest(1.5, least(40.0, 800.0 * 0.6 / (x2 - x1))), 6) AS depth, round(-radians(image * 7) + atan2((x1 + x2) / 2.0::DOUBLE - 480.0, 800.0), 9) AS bearing FROM v_boxes")
def monocular_depth(spark: SparkSession, d: str) -> DataFrame:
    b = B.boxes(spark, d)
    depth = CAM.size_depth(800.0, F.lit(0.6), F.col("x2") - F.col("x1"), 1.5, 40.0)
    return b.select("id", F.round(depth, 6).alias("depth"), F.round(CAM.bearing((F.col("image") * 7).cast("double"), (F.col("x1") + F.col("x2")) / 2.0, 800.0, 480.0), 9).alias("bearing"))


@query("""SELECT id, CASE WHEN kind = 'light' THEN 'Traffic Light' WHEN id % 5 = 0 THEN 'STOP' WHEN score >= 0.5 THEN 'STOP (REVIEW)' ELSE 'Sign' END AS tag,
CASE WHEN id % 7 = 0 THEN CASE WHEN id % 3 = 0 THEN 'pink' WHEN id % 3 = 1 THEN 'amber' ELSE 'cyan' END
WHEN kind = 'sign' AND id % 11 = 0 THEN 'purple' WHEN id % 4 = 0 THEN 'orange' WHEN kind = 'sign' THEN 'red' ELSE 'yellow' END AS colour FROM v_boxes""")
def tag_text_and_colour(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("id") % 5 == 0, "DE:206")
    kind = F.when(F.col("id") % 7 == 0, "pole").otherwise(F.col("kind"))
    source = F.when(F.col("id") % 4 == 0, "camera_only_unverified").otherwise("lidar")
    status = F.get(F.array(*map(F.lit, ("probable_sign", "adjacent_to_detection", "unclassified_pole"))), (F.col("id") % 3).cast("int"))
    colour = rules.status_colour(kind, F.col("id") % 11 == 0, source, status)
    return B.boxes(spark, d).select("id", CLS.tag_text(code, F.lit("STOP"), F.col("score"), F.col("kind")).alias("tag"), colour.alias("colour"))


@query("SELECT id, depth <= 2.5 * assumed AND width <= 2.0 AS replaces FROM (SELECT id, 1.0 + (id % 97) / 2.0::DOUBLE AS depth, greatest(1.5, least(40.0, 800.0 * 0.6 / (x2 - x1))) AS assumed, (y2 - y1) / 25.0::DOUBLE AS width FROM v_boxes)")
def plausible_range(spark: SparkSession, d: str) -> DataFrame:
    """Whether a measured distance may replace the one assumed from the size: much nearer ones may, much farther ones not."""
    depth, width = 1.0 + (F.col("id") % 97) / F.lit(2.0), (F.col("y2") - F.col("y1")) / F.lit(25.0)
    assumed = CAM.size_depth(800.0, F.lit(0.6), F.col("x2") - F.col("x1"), 1.5, 40.0)
    return B.boxes(spark, d).select("id", rules.plausible_range(depth, assumed, width).alias("replaces"))


_DETECTIONS = "SELECT id, kind, score, image % 13 AS n, (x2 - x1) / 40.0::DOUBLE AS w, (id % 60) / 10.0::DOUBLE AS h, (id % 23)::DOUBLE AS away, id % 4 = 0 AS unverified FROM v_boxes"


@query(f"""SELECT id, CASE WHEN NOT unverified AND n < 3 THEN 'points' WHEN NOT unverified AND NOT (w BETWEEN 0.6 AND 1.8) THEN 'width' WHEN NOT unverified AND h < 1.0 THEN 'height'
WHEN NOT unverified AND away > 15.0 THEN 'distance' WHEN kind = 'sign' AND score < 0.4 THEN 'confidence' ELSE 'kept' END AS loose,
CASE WHEN NOT unverified AND n < 3 THEN 'points' WHEN NOT unverified AND n > 0 AND NOT (w BETWEEN 0.6 AND 1.8) THEN 'width' WHEN h < 1.0 THEN 'height'
WHEN away > 15.0 THEN 'distance' WHEN kind = 'sign' AND score < 0.4 THEN 'confidence' ELSE 'kept' END AS strict FROM ({_DETECTIONS})""")
def detection_filter(spark: SparkSession, d: str) -> DataFrame:
    """Why a localised detection is dropped, or 'kept', by both producers' exemptions of unverified camera-only ones."""
    b = B.boxes(spark, d).select("id", "kind", "score", (F.col("image") % 13).alias("n"), ((F.col("x2") - F.col("x1")) / F.lit(40.0)).alias("w"), ((F.col("id") % 60) / F.lit(10.0)).alias("h"), (F.col("id") % 23).cast("double").alias("away"), (F.col("id") % 4 == 0).alias("unverified"))
    why = lambda strict: rules.detection_filter(*(F.col(c) for c in ("kind", "score", "n", "w", "h", "away", "unverified")), (3, 0.6, 1.8, 1.0, 15.0, 0.4), strict)
    return b.select("id", why(False).alias("loose"), why(True).alias("strict"))


@query("""WITH m AS (SELECT p.pid, s.image, row_number() OVER (PARTITION BY p.pid ORDER BY (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), s.image) AS rn FROM v_points p, v_shots s)
SELECT pid, image FROM m WHERE rn = 1""")
def nearest_camera(spark: SparkSession, d: str) -> DataFrame:
    shots = B.shots(spark, d).select(F.col("image").alias("pid"), "x", "y")
    return S.nearest(B.points(spark, d), shots, 2.0).select("pid", F.col("near").alias("image"))


@query("""WITH l AS (SELECT s.pid, p.pid AS light, p.z FROM v_donor s JOIN v_recipient p ON (s.x - p.x) ** 2 + (s.y - p.y) ** 2 < 4.0 AND p.cls = 'error' WHERE s.cls = 'view')
SELECT pid, max(light) AS light, arg_max(z, light) AS z FROM l GROUP BY 1""")
def colocation(spark: SparkSession, d: str) -> DataFrame:
    """Signs that stand with lights take the height of the last light in reach."""
    p = B.points(spark, d).select("pid", "x", "y", "z", "cls")
    met = S.radius_join(p.where("cls = 'view'").select("pid", "x", "y"), p.where("cls = 'error'").drop("cls"), 2.0, strict=True)
    return met.groupBy("pid").agg(F.max("r_pid").alias("light"), F.max_by("r_z", "r_pid").alias("z"))


@query("""SELECT image, pid FROM (SELECT s.image, p.pid, 900.0 * (p.x - s.x) / (p.y - s.y) AS u FROM v_shots s JOIN v_points p ON (s.x - p.x) ** 2 + (s.y - p.y) ** 2 <= 100.0 AND p.y - s.y > 0.01)
WHERE abs(u) <= 150.0""")
def observation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Points near a shot, ahead of it, that would be seen within 150 pixels of its axis."""
    shots, p = B.shots(spark, d).select(F.col("image").alias("pid"), "x", "y"), B.points(spark, d).select("pid", "x", "y")
    # Places meet, within the cone's width at 10 m, and carry their rows: pairs that pass become rows without an exchange.
    spots = lambda df: S.places(df, ("x", "y"), F.collect_list("pid").alias("pids")).select("x", "y", "pids")
    met = S.box_join(spots(shots), spots(p), (-1.67, 0.0), (1.67, 10.0))
    side, ahead = F.col("r_x") - F.col("x"), F.col("r_y") - F.col("y")
    u = F.abs(900.0 * side / F.when(ahead > 0.01, ahead))
    seen = met.where((side * side + ahead * ahead <= 100.0) & (u <= 150.0)).select("pids", "r_pids")
    return seen.select(F.explode("pids").alias("image"), "r_pids").select("image", F.explode("r_pids").alias("pid"))


@query("""WITH o AS (SELECT image AS ord, x, y, z, least(1.2, greatest(0.3, z)) AS r, CASE WHEN image % 2 = 0 THEN 'red' ELSE 'amber' END AS colour FROM v_shots),
h AS (SELECT p.pid, arg_max(colour, ord) AS colour FROM v_points p JOIN o ON (p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) + (p.z - o.z) * (p.z - o.z) <= o.r * o.r GROUP BY 1)
SELECT pid, coalesce(colour, 'grey') AS colour FROM v_points LEFT JOIN h USING (pid)""")
def radius_tint(spark: SparkSession, d: str) -> DataFrame:
    o = B.shots(spark, d).select(F.col("image").alias("ord"), "x", "y", "z", F.least(F.lit(1.2), F.greatest(F.lit(0.3), F.col("z"))).alias("r"), F.when(F.col("image") % 2 == 0, "red").otherwise("amber").alias("colour"))
    return O.tint(B.points(spark, d), o, "grey")


@query("""WITH w AS (SELECT user_id AS way, x AS ax, y AS ay, lead(x) OVER t AS bx, lead(y) OVER t AS by_ FROM v_points WINDOW t AS (PARTITION BY user_id ORDER BY us, pid)),
s AS (SELECT p.pid, way, sqrt((p.x - ax - f * (bx - ax)) ** 2 + (p.y - ay - f * (by_ - ay)) ** 2) AS d FROM (SELECT p.pid, p.x, p.y, w.*, greatest(0.0, least(1.0, ((p.x - ax) * (bx - ax) + (p.y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) AS f FROM v_points p, w WHERE bx IS NOT NULL AND p.cls = 'error' AND (bx - ax) ** 2 + (by_ - ay) ** 2 > 0) p)
SELECT pid, way, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(d, 9), way) AS rn FROM s WHERE d <= 3.0) WHERE rn = 1""")
def way_corridor(spark: SparkSession, d: str) -> DataFrame:
    """Shots within 3 m of a way (the users' tracks) and the nearest one."""
    from ..operators.temporal import look_ahead

    t = look_ahead(B.points(spark, d).select("user_id", "us", "pid", "x", "y"), "user_id", ("us", "pid"), 1, ("pid", "x", "y")).where("ahead_pid <> pid")
    ways = t.select(F.col("user_id").alias("way"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("ahead_x").alias("bx"), F.col("ahead_y").alias("by")).where("ax <> bx OR ay <> by")
    return O.point_to_paths(B.points(spark, d).where("cls = 'error'"), ways, 3.0).select("pid", "way", F.round("distance", 6).alias("distance"))


@query("SELECT floor(x / 2.0)::BIGINT AS vx, floor(y / 2.0)::BIGINT AS vy, floor(z / 2.0)::BIGINT AS vz, round(avg(x), 6) AS x, round(avg(z), 6) AS z, count(*) AS n FROM v_points GROUP BY 1, 2, 3")
def voxel_mean(spark: SparkSession, d: str) -> DataFrame:
    return S.voxel_mean(B.points(spark, d), 2.0).select("vx", "vy", "vz", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"), "n")


@query("SELECT pid, NOT (x BETWEEN 50.0 AND 150.0 AND y BETWEEN 20.0 AND 80.0) AS outside, z < 0.3 OR z > 4.5 AS dropped FROM v_points")
def mask_algebra(spark: SparkSession, d: str) -> DataFrame:
    inside = F.col("x").between(50.0, 150.0) & F.col("y").between(20.0, 80.0)
    return B.points(spark, d).select("pid", (~inside).alias("outside"), ((F.col("z") < 0.3) | (F.col("z") > 4.5)).alias("dropped"))


@query("SELECT user_id, round(sqrt(avg(z * z)), 6) AS rmse, round(avg(CASE WHEN z < 1.0 THEN 1.0 ELSE 0.0 END), 6) AS inliers FROM v_points GROUP BY 1")
def residual_stats(spark: SparkSession, d: str) -> DataFrame:
    return B.points(spark, d).groupBy("user_id").agg(F.round(F.sqrt(F.avg(F.col("z") * F.col("z"))), 6).alias("rmse"), F.round(F.avg((F.col("z") < 1.0).cast("double")), 6).alias("inliers"))
