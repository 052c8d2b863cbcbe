"""Scans, filters, voxels and spatial joins on the bridge views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import spatial as S
from . import bridge as B
from .registry import query


@query("SELECT pid, x, y, z FROM v_points WHERE x BETWEEN 30.0 AND 140.0 AND y BETWEEN 0.0 AND 75.0")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.bbox(B.points(spark, d), (45.0, 15.0), (125.0, 60.0), 15.0).select("pid", "x", "y", "z")


@query("""
WITH p AS (SELECT *, floor(x / 2.0)::BIGINT AS cx, floor(y / 2.0)::BIGINT AS cy FROM v_points),
g AS (SELECT cx, cy, quantile_cont(z, 0.5) AS ground FROM p GROUP BY 1, 2)
SELECT pid, cx, cy, round(z - ground, 6) AS height, z - ground >= 0.3 AS above FROM p JOIN g USING (cx, cy)
""")
def height_above_cell_ground(spark: SparkSession, d: str) -> DataFrame:
    """Height of every point above its 2 m cell's median: one shuffle by cell."""
    p = B.points(spark, d).select("pid", "z", S.cell("x", 2).alias("cx"), S.cell("y", 2).alias("cy"))
    ground = p.groupBy("cx", "cy").agg(F.percentile("z", F.lit(0.5)).alias("ground"))
    h = F.col("z") - F.col("ground")
    return p.join(ground, ["cx", "cy"]).select("pid", "cx", "cy", F.round(h, 6).alias("height"), (h >= 0.3).alias("above"))


@query("SELECT pid, intensity FROM v_points WHERE intensity >= (SELECT quantile_cont(intensity, 0.93) FROM v_points)")
def intensity_p93_filter(spark: SparkSession, d: str) -> DataFrame:
    p = B.points(spark, d).select("pid", "intensity")
    (limit,) = S.quantiles(p, "intensity", (0.93,))
    return p.where(F.col("intensity") >= limit)


@query("SELECT pid, z FROM v_points WHERE z BETWEEN (SELECT quantile_cont(z, 0.05) - 1.0 FROM v_points) AND (SELECT quantile_cont(z, 0.05) + 3.0 FROM v_points)")
def z_band_p05(spark: SparkSession, d: str) -> DataFrame:
    p = B.points(spark, d).select("pid", "z")
    (low,) = S.quantiles(p, "z", (0.05,))
    return p.where(F.col("z").between(low - 1.0, low + 3.0))


@query("SELECT pid FROM v_points WHERE (x - 100.0) * (x - 100.0) + (y - 50.0) * (y - 50.0) <= 625.0")
def disc_filter(spark: SparkSession, d: str) -> DataFrame:
    inside = S.bbox(B.points(spark, d), (75.0, 25.0), (125.0, 75.0))
    return inside.where("(x - 100.0D) * (x - 100.0D) + (y - 50.0D) * (y - 50.0D) <= 625.0D").select("pid")


@query("SELECT pid FROM v_points WHERE abs(0.01 * x - 0.02 * y + z - 2.0) / sqrt(0.01 * 0.01 + 0.02 * 0.02 + 1.0) < 0.5")
def plane_distance_filter(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.geometry import plane_distance

    return B.points(spark, d).where(plane_distance(0.01, -0.02, 1.0, -2.0) < 0.5).select("pid")


@query("SELECT floor(x)::BIGINT AS vx, floor(y)::BIGINT AS vy, floor(z)::BIGINT AS vz, min(pid) AS pid FROM v_points GROUP BY 1, 2, 3")
def voxel_first(spark: SparkSession, d: str) -> DataFrame:
    return S.voxel_first(B.points(spark, d).select("pid", "x", "y", "z"), 1.0).select("vx", "vy", "vz", "pid")


@query("SELECT floor(x / 5.0)::BIGINT AS vx, floor(y / 5.0)::BIGINT AS vy, floor(z / 5.0)::BIGINT AS vz, count(*) AS n, max(intensity) AS top FROM v_bulk GROUP BY 1, 2, 3")
def voxel_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.voxels(B.bulk(spark, d), 5.0).groupBy("vx", "vy", "vz").agg(F.count("*").alias("n"), F.max("intensity").alias("top"))


@query("SELECT pid, ((floor(x / 0.5)::BIGINT & 2097151) << 42) | ((floor(y / 0.5)::BIGINT & 2097151) << 21) | (floor(z / 0.5)::BIGINT & 2097151) AS voxel FROM v_points")
def voxel_packed_keys(spark: SparkSession, d: str) -> DataFrame:
    return S.voxels(B.points(spark, d), 0.5).select("pid", S.packed_key().alias("voxel"))


@query("""SELECT pid FROM v_points WHERE EXISTS (SELECT 1 FROM v_recipient r
WHERE floor(r.x / 2.0) = floor(v_points.x / 2.0) AND floor(r.y / 2.0) = floor(v_points.y / 2.0) AND floor(r.z / 2.0) = floor(v_points.z / 2.0)) AND cls IN ('view', 'click')""")
def voxel_semi_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = S.voxels(B.donor(spark, d), 2.0), S.voxels(B.recipient(spark, d), 2.0)
    return a.join(b.select("vx", "vy", "vz").distinct(), ["vx", "vy", "vz"], "left_semi").select("pid")


@query("SELECT floor(x / 2.0)::BIGINT AS cx, floor(y / 2.0)::BIGINT AS cy, round(quantile_cont(z, 0.5), 6) AS ground, count(*) AS n FROM v_points GROUP BY 1, 2")
def grid_median_z(spark: SparkSession, d: str) -> DataFrame:
    return S.cell_median(B.points(spark, d), 2.0).withColumn("ground", F.round("ground", 6))


@query("""
WITH g AS (SELECT floor(x / 2.0)::BIGINT AS cx, floor(y / 2.0)::BIGINT AS cy, quantile_cont(z, 0.5) AS ground FROM v_recipient GROUP BY 1, 2),
o AS (SELECT i, j, row_number() OVER (ORDER BY greatest(abs(i), abs(j)), i, j) - 1 AS scan FROM (SELECT unnest(range(-4, 5)) AS i), (SELECT unnest(range(-4, 5)) AS j)),
m AS (SELECT s.image AS pid, scan, ground, row_number() OVER (PARTITION BY s.image ORDER BY scan) AS rn FROM v_shots s, o JOIN g ON cx = floor(s.x / 2.0)::BIGINT + i AND cy = floor(s.y / 2.0)::BIGINT + j)
SELECT s.image AS pid, round(coalesce(m.ground, (SELECT quantile_cont(z, 0.5) FROM v_recipient)), 6) AS ground, coalesce(m.scan, -1)::INTEGER AS scan
FROM v_shots s LEFT JOIN m ON m.pid = s.image AND rn = 1
""")
def ground_ring_search(spark: SparkSession, d: str) -> DataFrame:
    r = B.recipient(spark, d)
    (overall,) = S.quantiles(r, "z", (0.5,))
    shots = B.shots(spark, d).select(F.col("image").alias("pid"), "x", "y")
    return S.ring_search(shots, S.cell_median(r, 2.0), 2.0, 4, overall).select("pid", F.round("ground", 6).alias("ground"), F.coalesce("scan", F.lit(-1)).alias("scan"))


@query("SELECT s.image, count(p.pid) AS n FROM v_shots s LEFT JOIN v_points p ON (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) <= 25.0 GROUP BY 1")
def radius_join_count(spark: SparkSession, d: str) -> DataFrame:
    shots = B.shots(spark, d)
    met = S.radius_join(shots.select("image", "x", "y"), B.points(spark, d).select("pid", "x", "y"), 5.0).groupBy("image").count()
    return shots.join(met, "image", "left").select("image", F.coalesce("count", F.lit(0)).alias("n"))


@query("""SELECT a.pid AS a, b.pid AS b FROM v_points a JOIN v_points b ON a.pid < b.pid AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0 AND abs(a.us - b.us) > 30000000""")
def self_radius_pairs_timegap(spark: SparkSession, d: str) -> DataFrame:
    return S.self_pairs(B.points(spark, d), 2.0, extra=F.abs(F.col("us") - F.col("r_us")) > 30_000_000, keep=("us",))


@query("SELECT pid FROM v_donor d WHERE NOT EXISTS (SELECT 1 FROM v_recipient r WHERE (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) + (d.z - r.z) * (d.z - r.z) <= 1.0)")
def gap_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return S.radius_join(B.donor(spark, d).select("pid", "x", "y", "z"), B.recipient(spark, d).select("pid", "x", "y", "z"), 1.0, ("x", "y", "z"), "left_anti").select("pid")


@query("""SELECT pid, near, round(d2, 6) AS d2 FROM (SELECT d.pid, r.pid AS near, (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) AS d2,
row_number() OVER (PARTITION BY d.pid ORDER BY (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y), r.pid) AS rn FROM v_shots s JOIN v_points d ON d.pid = s.image, v_recipient r WHERE r.cls <> 'error') WHERE rn = 1""")
def nearest_k1(spark: SparkSession, d: str) -> DataFrame:
    p = B.points(spark, d)
    return S.nearest(p.where("cls = 'error'"), p.where("cls NOT IN ('view', 'click', 'error')"), 1.0).select("pid", "near", F.round("d2", 6).alias("d2"))


@query("SELECT id, image FROM v_boxes s WHERE kind = 'sign' AND NOT EXISTS (SELECT 1 FROM v_boxes l WHERE l.kind = 'light' AND l.image = s.image AND "
       "greatest(0, least(s.x2, l.x2) - greatest(s.x1, l.x1)) * greatest(0, least(s.y2, l.y2) - greatest(s.y1, l.y1)) / "
       "((s.x2 - s.x1) * (s.y2 - s.y1) + (l.x2 - l.x1) * (l.y2 - l.y1) - greatest(0, least(s.x2, l.x2) - greatest(s.x1, l.x1)) * greatest(0, least(s.y2, l.y2) - greatest(s.y1, l.y1)))::DOUBLE > 0.3)")
def iou_anti_join(spark: SparkSession, d: str) -> DataFrame:
    b = B.boxes(spark, d)
    return S.iou_anti_join(b.where("kind = 'sign'"), b.where("kind = 'light'"), 0.3).select("id", "image")


@query("""SELECT b.id, count(*) AS n FROM v_boxes b JOIN (SELECT user_id % 50 AS image, floor(x * 4) AS u, floor(y * 7) AS v FROM v_points) p ON p.image = b.image
WHERE u BETWEEN (x1 + x2) / 2.0::DOUBLE - (x2 - x1) / 2.0::DOUBLE * 0.7::DOUBLE AND (x1 + x2) / 2.0::DOUBLE + (x2 - x1) / 2.0::DOUBLE * 0.7::DOUBLE AND v BETWEEN (y1 + y2) / 2.0::DOUBLE - (y2 - y1) / 2.0::DOUBLE * 0.7::DOUBLE AND (y1 + y2) / 2.0::DOUBLE + (y2 - y1) / 2.0::DOUBLE * 0.7::DOUBLE GROUP BY 1""")
def box_containment(spark: SparkSession, d: str) -> DataFrame:
    pixels = B.points(spark, d).select((F.col("user_id") % 50).alias("image"), "pid", F.floor(F.col("x") * 4).alias("u"), F.floor(F.col("y") * 7).alias("v"))
    return S.box_containment(pixels, B.boxes(spark, d)).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT id FROM v_boxes WHERE x2 - x1 >= 40 AND y2 - y1 >= 30 AND (y1 + y2) / 2.0 <= 0.62 * 700 AND (x2 - x1) / (y2 - y1)::DOUBLE BETWEEN 0.3 AND 2.5 AND score >= 0.25")
def box_gates(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.rules import box_gates as gates

    return B.boxes(spark, d).where(gates(40, 30, 700, 0.62, 0.3, 2.5, 0.25)).select("id")


@query("SELECT cls, pid, y < 50.0 AS pass1, count(*) OVER (PARTITION BY cls) AS n FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY us, pid) AS rn FROM v_points) WHERE rn <= 3 QUALIFY true")
def top_k_by_class(spark: SparkSession, d: str) -> DataFrame:
    """The first three points of each class by time (a top-k report)."""
    p = B.points(spark, d).select("cls", "pid", "us", (F.col("y") < 50.0).alias("pass1"))
    top = p.withColumn("rn", F.row_number().over(Window.partitionBy("cls").orderBy("us", "pid"))).where("rn <= 3")
    return top.select("cls", "pid", "pass1", F.count("*").over(Window.partitionBy("cls")).alias("n"))


@query("SELECT cls, count(*) AS n, count(*) FILTER (WHERE z >= 0.5) AS road, count(*) FILTER (WHERE z < 0.5) AS dropped, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM v_points GROUP BY 1")
def filter_waterfall(spark: SparkSession, d: str) -> DataFrame:
    g = B.points(spark, d).groupBy("cls").agg(F.count("*").alias("n"), F.count_if(F.col("z") >= 0.5).alias("road"), F.count_if(F.col("z") < 0.5).alias("dropped"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(total, F.col("total") >= F.col("n")).select("cls", "n", "road", "dropped", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT pid, 'donor' AS origin, x, y, z FROM v_donor UNION ALL SELECT pid, 'recipient', x, y, z FROM v_recipient")
def union_provenance(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda df, name: df.select("pid", F.lit(name).alias("origin"), "x", "y", "z")
    return tag(B.donor(spark, d), "donor").unionByName(tag(B.recipient(spark, d), "recipient"), allowMissingColumns=True)


@query("SELECT greatest(min(x) FILTER (WHERE d), min(x) FILTER (WHERE NOT d)) AS x1, least(max(x) FILTER (WHERE d), max(x) FILTER (WHERE NOT d)) AS x2, greatest(min(y) FILTER (WHERE d), min(y) FILTER (WHERE NOT d)) AS y1, least(max(y) FILTER (WHERE d), max(y) FILTER (WHERE NOT d)) AS y2 FROM (SELECT *, cls IN ('view', 'click') AS d FROM v_points)")
def extent_intersection(spark: SparkSession, d: str) -> DataFrame:
    p = B.points(spark, d).withColumn("d", F.col("cls").isin("view", "click"))
    side = lambda f, c, s: f(F.when(F.col("d") if s else ~F.col("d"), F.col(c)))
    return p.agg(
        *(F.greatest(side(F.min, c, True), side(F.min, c, False)).alias(f"{c}1") for c in "xy"),
        *(F.least(side(F.max, c, True), side(F.max, c, False)).alias(f"{c}2") for c in "xy"),
    )


@query("SELECT min(x) - 20.0 AS x1, max(x) + 20.0 AS x2, min(y) - 20.0 AS y1, max(y) + 20.0 AS y2, count(*) AS n FROM v_points")
def header_extent(spark: SparkSession, d: str) -> DataFrame:
    p = B.points(spark, d)
    return p.agg((F.min("x") - 20.0).alias("x1"), (F.max("x") + 20.0).alias("x2"), (F.min("y") - 20.0).alias("y1"), (F.max("y") + 20.0).alias("y2"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE pid % 10 <> 3) AS m FROM v_points)
SELECT 'near' AS pair, n AS n_a, n AS n_b, true AS aligned FROM c UNION ALL SELECT 'far', n, n, false FROM c UNION ALL SELECT 'missing', n, m, n = m FROM c""")
def cloud_alignment(spark: SparkSession, d: str) -> DataFrame:
    """A cloud against itself moved a little, moved too far, and with rows missing."""
    p = B.points(spark, d).select("pid", "x", "y", "z")
    pairs = {"near": p.withColumn("x", F.col("x") + 0.01), "far": p.withColumn("y", F.when(F.col("pid") % 100 == 7, F.col("y") + 0.06).otherwise(F.col("y"))), "missing": p.where("pid % 10 <> 3")}
    each = [S.aligned(p, q).select(F.lit(name).alias("pair"), "*") for name, q in pairs.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query()
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampling operator: 500 points by a seeded hash."""
    return S.sample(B.points(spark, d).select("pid", "x", "y", "z"), 500, 42)


@query("SELECT pid, x, y FROM v_points ORDER BY pid LIMIT 100")
def first_n(spark: SparkSession, d: str) -> DataFrame:
    """The first-N operator."""
    return B.points(spark, d).select("pid", "x", "y").orderBy("pid").limit(100)
