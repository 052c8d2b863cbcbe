"""As-of joins, paths and time codes on the bridge views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timecodes as TC
from ..operators import temporal as T
from . import bridge as B
from .registry import query

_ASOF = """
WITH q AS (SELECT pid, us AS t, x, y FROM v_points WHERE cls <> 'error'), s AS (SELECT image, t, x, y FROM v_shots),
b AS (SELECT q.*, s.image AS bi, s.t AS bt, s.x AS bx, s.y AS by_ FROM q ASOF LEFT JOIN s ON q.t >= s.t),
a AS (SELECT q.pid, s.image AS ai, s.t AS at_, s.x AS ax, s.y AS ay FROM q ASOF LEFT JOIN s ON q.t <= s.t),
j AS (SELECT *, bt IS NULL OR (at_ IS NOT NULL AND at_ - t {op} t - bt) AS later FROM b JOIN a USING (pid))
"""


def _asof(spark: SparkSession, d: str, ties: str) -> DataFrame:
    q = B.points(spark, d).where("cls <> 'error'").select("pid", F.col("us").alias("t"), "x", "y")
    return T.asof(q, B.shots(spark, d).select("t", "image", "x", "y"), ties)


@query(_ASOF.format(op="<") + "SELECT pid, CASE WHEN later THEN ai ELSE bi END AS image, CASE WHEN later THEN at_ ELSE bt END - t AS dt FROM j")
def asof_nearest_earlier(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, "earlier").select("pid", "match.image", "dt")


@query(_ASOF.format(op="<=") + "SELECT pid, CASE WHEN later THEN ai ELSE bi END AS image, CASE WHEN later THEN at_ ELSE bt END - t AS dt FROM j")
def asof_nearest_later(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, "later").select("pid", "match.image", "dt")


@query(_ASOF.format(op="<=") + """SELECT pid, CASE WHEN later THEN ai ELSE bi END AS image FROM j WHERE abs(CASE WHEN later THEN at_ ELSE bt END - t) <= 600000000
AND (x - CASE WHEN later THEN ax ELSE bx END) * (x - CASE WHEN later THEN ax ELSE bx END) + (y - CASE WHEN later THEN ay ELSE by_ END) * (y - CASE WHEN later THEN ay ELSE by_ END) <= 900.0""")
def time_gate_join(spark: SparkSession, d: str) -> DataFrame:
    """As-of with gates on the time difference and on the plane distance."""
    j = _asof(spark, d, "later")
    dx, dy = F.col("x") - F.col("match.x"), F.col("y") - F.col("match.y")
    return j.where((F.abs("dt") <= 600_000_000) & (dx * dx + dy * dy <= 900.0)).select("pid", "match.image")


@query(_ASOF.format(op="<") + """SELECT pid, round(coalesce(bx, ax) + w * (coalesce(ax, bx) - coalesce(bx, ax)), 6) AS x_at, round(coalesce(by_, ay) + w * (coalesce(ay, by_) - coalesce(by_, ay)), 6) AS y_at
FROM (SELECT *, CASE WHEN coalesce(at_, bt) = coalesce(bt, at_) THEN 0.0 ELSE (t - bt) / (at_ - bt)::DOUBLE END AS w FROM j)""")
def asof_bracket_lerp(spark: SparkSession, d: str) -> DataFrame:
    q = B.points(spark, d).where("cls <> 'error'").select("pid", F.col("us").alias("t"))
    return T.interpolate(q, B.shots(spark, d).select("t", "x", "y"), ("x", "y")).select("pid", F.round("x_at", 6).alias("x_at"), F.round("y_at", 6).alias("y_at"))


def _track(spark: SparkSession, d: str) -> DataFrame:
    return B.points(spark, d).select("user_id", "us", "pid", "x", "y")


_ARC = "SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY us, pid) AS s FROM (SELECT user_id, us, pid, x, y, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM v_points WINDOW w AS (PARTITION BY user_id ORDER BY us, pid))"


@query(f"SELECT user_id, count(*) AS n, round(max(s), 3) AS length FROM ({_ARC}) GROUP BY 1")
def path_arclength(spark: SparkSession, d: str) -> DataFrame:
    p = T.arc_length(_track(spark, d), "user_id", ("us", "pid"))
    return p.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("s"), 3).alias("length"))


@query("""
WITH p AS (SELECT user_id, pid, x, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM v_points WINDOW w AS (PARTITION BY user_id ORDER BY us, pid)),
k AS (SELECT unnest(range(-3, 4)) AS k)
SELECT a.user_id, a.pid, round(CASE WHEN any_value(a.n) < 7 THEN any_value(a.x) ELSE sum(b.x) / 7 END, 6) AS smooth FROM p a, k JOIN p b ON b.user_id = a.user_id AND b.rn = least(greatest(a.rn + k, 1), a.n) GROUP BY 1, 2
""")
def path_moving_avg(spark: SparkSession, d: str) -> DataFrame:
    return T.moving_average(_track(spark, d), "user_id", ("us", "pid"), "x").select("user_id", "pid", F.round("smooth", 6).alias("smooth"))


@query(f"""
WITH p AS (SELECT user_id, s, x, y, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS rn FROM ({_ARC}) WINDOW w AS (PARTITION BY user_id ORDER BY s))
SELECT user_id, k::BIGINT AS k, round(x + (k * 50.0::DOUBLE - s) / (s2 - s) * (x2 - x), 4) AS x, round(y + (k * 50.0::DOUBLE - s) / (s2 - s) * (y2 - y), 4) AS y
FROM (SELECT *, unnest(range(CASE WHEN rn = 1 THEN 0 ELSE floor(s / 50.0)::BIGINT + 1 END, floor(s2 / 50.0)::BIGINT + 1)) AS k FROM p WHERE s2 > s)
""")
def path_resample(spark: SparkSession, d: str) -> DataFrame:
    p = T.arc_length(_track(spark, d), "user_id", ("us", "pid"))
    return T.resample(p, "user_id", 50.0).select("user_id", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("""
WITH p AS (SELECT user_id, us, pid, x, y, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v_points WINDOW w AS (PARTITION BY user_id ORDER BY us, pid))
SELECT pid, round(((nx - x) * dx + (ny - y) * dy) / sqrt(dx * dx + dy * dy), 4) AS along, round(((ny - y) * dx - (nx - x) * dy) / sqrt(dx * dx + dy * dy), 4) AS "cross" FROM p WHERE nx IS NOT NULL AND dx * dx + dy * dy > 0
""")
def along_cross_track(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of each path's next row in the frame of this one."""
    p = T.look_ahead(T.tangents(_track(spark, d), "user_id", ("us", "pid")), "user_id", ("us", "pid"), 1, ("pid", "x", "y"))
    p = p.where("ahead_pid <> pid AND tx IS NOT NULL").select("pid", F.col("x").alias("px"), F.col("y").alias("py"), "tx", "ty", F.col("ahead_x").alias("x"), F.col("ahead_y").alias("y"))
    return T.along_cross(p).select("pid", F.round("along", 4).alias("along"), F.round("cross", 4).alias("cross"))


@query("SELECT user_id, pid, coalesce(lead(pid, 6) OVER w, last(pid) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ahead_pid FROM v_points WINDOW w AS (PARTITION BY user_id ORDER BY us, pid)")
def look_ahead_pose(spark: SparkSession, d: str) -> DataFrame:
    return T.look_ahead(_track(spark, d), "user_id", ("us", "pid"), 6, ("pid",)).select("user_id", "pid", "ahead_pid")


@query("""
WITH r AS (SELECT *, x < 150.0 AS flag, row_number() OVER w - row_number() OVER (PARTITION BY user_id, x < 150.0 ORDER BY us, pid) AS g FROM v_points WINDOW w AS (PARTITION BY user_id ORDER BY us, pid)),
i AS (SELECT user_id, flag, g, count(*) AS n, min(us) AS first, max(us) AS last FROM r GROUP BY 1, 2, 3)
SELECT user_id, n, first FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS rn FROM i) WHERE rn = 1 AND flag AND n >= 5
""")
def islands_trailing_run(spark: SparkSession, d: str) -> DataFrame:
    p = B.points(spark, d).select("user_id", "us", "pid", "x")
    return T.trailing_run(p, "user_id", ("us", "pid"), F.col("x") < 150.0, 5).select("user_id", "n", "first")


@query("""
WITH RECURSIVE p AS (SELECT user_id, pid, x, y, row_number() OVER (PARTITION BY user_id ORDER BY us, pid) AS rn FROM v_points),
k AS (SELECT user_id, rn, pid, x, y, x AS lx, y AS ly, true AS kept FROM p WHERE rn = 1
  UNION ALL SELECT p.user_id, p.rn, p.pid, p.x, p.y, CASE WHEN sqrt((p.x - lx) ** 2 + (p.y - ly) ** 2) > 60.0 THEN p.x ELSE lx END, CASE WHEN sqrt((p.x - lx) ** 2 + (p.y - ly) ** 2) > 60.0 THEN p.y ELSE ly END, sqrt((p.x - lx) ** 2 + (p.y - ly) ** 2) > 60.0
  FROM k JOIN p ON p.user_id = k.user_id AND p.rn = k.rn + 1)
SELECT user_id, pid FROM k WHERE kept
""")
def path_thinning(spark: SparkSession, d: str) -> DataFrame:
    return T.thin(_track(spark, d), "user_id", "us", 60.0).select("user_id", "pid")


@query("SELECT pid, ((us + 18000000 - 315964800000000) // 604800000000)::BIGINT AS gps_week, ((us + 18000000 - 315964800000000) % 604800000000)::BIGINT AS sow_us FROM v_points")
def utc_to_gps_week(spark: SparkSession, d: str) -> DataFrame:
    return B.points(spark, d).select("pid", TC.gps_week(F.col("us")).alias("gps_week"), TC.gps_week_micros(F.col("us")).alias("sow_us"))


_NAME = "'Site_A{utc-' || strftime(ts, '%Y%m%d_%H-%M-%S') || '-' || lpad(((us // 1000) % 1000)::VARCHAR, 3, '0') || ';sn-' || user_id::VARCHAR || ';exp-0.2' || (pid % 10)::VARCHAR || ';c-' || (user_id % 4)::VARCHAR || ';pls-' || (pid % 9)::VARCHAR || '}.jpg'"


def _names(spark: SparkSession, d: str) -> DataFrame:
    p = B.points(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    name = F.concat(F.lit("Site_A{utc-"), F.date_format("ts", "yyyyMMdd_HH-mm-ss"), F.lit("-"), F.lpad((F.floor(F.col("us") / 1000) % 1000).cast("string"), 3, "0"), F.lit(";sn-"), F.col("user_id"), F.lit(";exp-0.2"), F.col("pid") % 10, F.lit(";c-"), F.col("user_id") % 4, F.lit(";pls-"), F.col("pid") % 9, F.lit("}.jpg"))
    return p.select("pid", "us", name.alias("image"))


@query(f"SELECT pid, (us // 1000 * 1000)::BIGINT AS utc_us, user_id::VARCHAR AS serial, ('0.2' || (pid % 10)::VARCHAR)::DOUBLE AS exposure, (user_id % 4)::INTEGER AS camera, (pid % 9)::INTEGER AS pls FROM (SELECT *, {_NAME} AS image FROM v_points)")
def filename_parse(spark: SparkSession, d: str) -> DataFrame:
    n = _names(spark, d)
    return n.select("pid", TC.filename_utc_micros("image").alias("utc_us"), TC.filename_part("image", "sn").alias("serial"), TC.filename_part("image", "exp").cast("double").alias("exposure"), TC.filename_part("image", "c").cast("int").alias("camera"), TC.filename_part("image", "pls").cast("int").alias("pls"))


@query("SELECT pid, CASE WHEN date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + date_part('second', ts) < 31100 THEN 'pass1' ELSE 'pass2' END AS pass FROM v_points")
def pass_split_dual(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("pid", TC.pass_of("image", 31100).alias("pass"))


@query("SELECT pid, 'part' || (pid % 61)::VARCHAR AS part FROM v_points")
def part_from_path(spark: SparkSession, d: str) -> DataFrame:
    p = B.points(spark, d)
    return p.select("pid", F.regexp_extract(F.concat(F.lit("/survey/part"), F.col("pid") % 61, F.lit("/cloud.laz")), r"part\d+", 0).alias("part"))


@query()
def trajectory_spline(spark: SparkSession, d: str) -> DataFrame:
    """Not-a-knot cubic splines of each user's track, evaluated midway between its rows."""
    from ..operators.solve import spline_track

    return spline_track(_track(spark, d).select("user_id", F.col("us").alias("t"), "x", "y"), "user_id", "t", ("x", "y"))
