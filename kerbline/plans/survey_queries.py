"""Compositions over cameras, roads and clusters on the bridge views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera as CAM
from ..functions import geo as G
from ..functions import rotation as R
from ..functions import rules
from ..functions import timecodes as TC
from ..operators import cluster as C
from ..operators import road
from ..operators import solve, spatial, views
from . import bridge as B
from .object_queries import _DB, _db
from .registry import query
from .temporal_queries import _NAME, _names

_CAM = """cam AS (SELECT i::BIGINT AS image, ((i * 37) % 200)::DOUBLE AS x, ((i * 53) % 100)::DOUBLE AS y, sin(i * 0.7::DOUBLE) AS sa, cos(i * 0.7::DOUBLE) AS ca FROM range(50) t(i))"""


def _seen_sql(f: float, cx: float, cy: float, w: int, h: int, border: int) -> str:
    return f"""{_CAM}, loc AS (SELECT image, pid, p.x, p.y, p.z / 20.0::DOUBLE AS z, (p.x - c.x) * sa - (p.y - c.y) * ca AS a, -(p.z / 20.0::DOUBLE - 5.0) AS b, (p.x - c.x) * ca + (p.y - c.y) * sa AS depth FROM cam c JOIN v_points p ON (p.x - c.x) ** 2 + (p.y - c.y) ** 2 <= 900.0),
seen AS MATERIALIZED (SELECT * FROM (SELECT image, pid, x, y, z, depth, {f}::DOUBLE * a / depth + {cx} AS u, {f}::DOUBLE * b / depth + {cy} AS v FROM loc WHERE depth > 1.0) WHERE u >= 0 AND u < {w - border} AND v >= 0 AND v < {h - border})"""


def _cameras(spark: SparkSession, f: float, cx: float, cy: float, w: int, h: int) -> DataFrame:
    """Fifty cameras five metres up that look along the ground."""
    i = F.col("image")
    c = spark.range(50).select(F.col("id").alias("image")).withColumn("x", ((i * 37) % 200).cast("double")).withColumn("y", ((i * 53) % 100).cast("double")).withColumn("z", F.lit(5.0))
    sa, ca, zero = F.sin(i * F.lit(0.7)), F.cos(i * F.lit(0.7)), F.lit(0.0)
    c = views.with_turn(c, [[sa, zero, ca], [-ca, zero, sa], [zero, F.lit(-1.0), zero]])
    return c.withColumns({"fx": F.lit(f), "fy": F.lit(f), "cx": F.lit(cx), "cy": F.lit(cy), "width": F.lit(w), "height": F.lit(h)})


def _low(spark: SparkSession, d: str) -> DataFrame:
    return B.points(spark, d).select("pid", "x", "y", (F.col("z") / F.lit(20.0)).alias("z"))


_TAP = lambda c: {"r": "(3 * X + 5 * Y + 7 * image) % 256", "g": "(X * Y + image) % 256", "b": "(X + 2 * Y) % 256"}[c]


def _mixed(c: str) -> str:
    at = lambda x, y: _TAP(c).replace("X", x).replace("Y", y)
    return f"CASE WHEN px IS NULL THEN 60 ELSE least(255, trunc(({at('px', 'py')}) * (1 - fu) * (1 - fv) + ({at('(px + 1)', 'py')}) * fu * (1 - fv) + ({at('px', '(py + 1)')}) * (1 - fu) * fv + ({at('(px + 1)', '(py + 1)')}) * fu * fv ))::INTEGER END * 257"


@query(f"""
WITH {_seen_sql(40.0, 48.0, 40.0, 96, 80, 1)},
sc AS (SELECT *, depth * (1.0 + 2.0 * ((u - 48.0) ** 2 + (v - 40.0) ** 2) / ((96 * 96 + 80 * 80) / 4.0)) AS score, floor(u)::BIGINT AS px, floor(v)::BIGINT AS py FROM seen),
zb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, px, py ORDER BY score, pid) AS rn FROM sc) WHERE rn = 1),
b AS (SELECT * EXCLUDE (rk), u - px AS fu, v - py AS fv FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score, image) AS rk FROM zb) WHERE rk = 1)
SELECT p.pid, coalesce(b.image, -1) AS image, {_mixed('r')} AS red, {_mixed('g')} AS green, {_mixed('b')} AS blue FROM v_points p LEFT JOIN b USING (pid)
""")
def colourise_cloud(spark: SparkSession, d: str) -> DataFrame:
    """The whole cloud with the colours of made-up images, each pixel a function of its place."""
    at = lambda f: F.lpad(F.hex((f % 256).cast("long")), 2, "0")
    image = F.col("image")

    def pixel(i):
        x, y = i % 96, F.floor(i / 96)
        return F.concat(at(3 * x + 5 * y + 7 * image), at(x * y + image), at(x + 2 * y))

    images = spark.range(50).select(F.col("id").alias("image"), F.lit(96).alias("width"), F.lit(80).alias("height")).withColumn("pixels", F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(96 * 80 - 1)), pixel), "")))
    return views.colourise(_low(spark, d), _cameras(spark, 40.0, 48.0, 40.0, 96, 80), images).withColumn("image", F.coalesce("image", F.lit(-1)))


@query(f"""
WITH RECURSIVE {_seen_sql(400.0, 480.0, 350.0, 960, 700, 0)},
bx AS (SELECT id, kind, image, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, (x1 + x2) / 2.0 AS mx, (y1 + y2) / 2.0 AS my FROM v_boxes),
g AS (SELECT id, mono, c.x + sa * (mx - 480.0) / 400.0 * mono + ca * mono AS gx, c.y - ca * (mx - 480.0) / 400.0 * mono + sa * mono AS gy, 5.0 - (my - 350.0) / 400.0 * mono AS gz
  FROM (SELECT *, CASE WHEN kind = 'sign' THEN least(greatest(400.0 * 0.6 / (x2 - x1), 2.0), 25.0) ELSE least(greatest(400.0 * 1.3 / (y2 - y1), 3.0), 30.0) END AS mono FROM bx) JOIN cam c USING (image)),
ins AS MATERIALIZED (SELECT id, pid, depth, x, y, z FROM bx JOIN seen s USING (image) WHERE u BETWEEN mx - (x2 - x1) / 2.0 * 1.4 AND mx + (x2 - x1) / 2.0 * 1.4 AND v BETWEEN my - (y2 - y1) / 2.0 * 1.4 AND my + (y2 - y1) / 2.0 * 1.4),
lim AS (SELECT id, quantile_cont(depth, 0.5) AS lim FROM ins GROUP BY 1 HAVING count(*) >= 3),
fr AS MATERIALIZED (SELECT ins.* FROM ins JOIN lim USING (id) WHERE depth <= lim),
ln AS MATERIALIZED (SELECT a.id, a.pid AS p, b.pid AS q FROM fr a JOIN fr b ON a.id = b.id AND a.pid <> b.pid AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 16.0),
rc AS (SELECT id, pid, pid AS root FROM fr UNION SELECT ln.id, ln.q, rc.root FROM rc JOIN ln ON ln.id = rc.id AND ln.p = rc.pid AND ln.q > rc.root),
gr AS (SELECT id, root, count(*) AS n, avg(depth) AS away, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS span, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM (SELECT id, pid, min(root) AS root FROM rc GROUP BY 1, 2) JOIN fr USING (id, pid) GROUP BY 1, 2 HAVING count(*) >= 3),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, root) AS rn FROM gr) WHERE rn = 1),
o AS (SELECT id, gx, gy, gz, x, y, z, coalesce(span <= 8.0 AND away <= mono * 2.5, false) AS matched FROM g LEFT JOIN be USING (id))
SELECT id, round(CASE WHEN matched THEN x ELSE gx END, 7) AS x, round(CASE WHEN matched THEN y ELSE gy END, 7) AS y, round(CASE WHEN matched THEN z ELSE gz END + 1e-11, 9) AS z, matched FROM o
""")
def lidar_localise(spark: SparkSession, d: str) -> DataFrame:
    """Every box of the fifty cameras; the cloud is sparse, so steps, span and quantile are wide. Means of 16 heights end
    half-way between two numbers of nine places; the small shift has both engines round them alike."""
    o = views.localise(B.boxes(spark, d), _cameras(spark, 400.0, 480.0, 350.0, 960, 700), _low(spark, d), shrink=1.4, share=0.5, step=4.0, span=8.0)
    return o.select("id", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"), F.round(F.col("z") + 1e-11, 9).alias("z"), "matched")


_PATH = """pv AS (SELECT i::BIGINT AS pid, 2.0::DOUBLE * i AS x, 50.0 + 10.0 * sin(i / 10.0::DOUBLE) AS y FROM range(101) t(i)),
arc AS (SELECT *, sum(st) OVER (ORDER BY pid) AS s FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS st, lead(x) OVER w - lag(x) OVER w AS dx, lead(y) OVER w - lag(y) OVER w AS dy FROM pv WINDOW w AS (ORDER BY pid))),
fr AS (SELECT pid, x AS px, y AS py, s AS ps, dx / sqrt(dx * dx + dy * dy) AS tx, dy / sqrt(dx * dx + dy * dy) AS ty, (SELECT max(s) FROM arc) AS total FROM arc WHERE pid BETWEEN 1 AND 99)"""


def _framed(source: str, name: str, limit: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT q.pid, q.x, q.y, ps + (q.x - px) * tx + (q.y - py) * ty AS s, (q.y - py) * tx - (q.x - px) * ty AS t, total
  FROM (SELECT * FROM (SELECT p.pid, p.x, p.y, pv.pid AS near, row_number() OVER (PARTITION BY p.pid ORDER BY (p.x - pv.x) ** 2 + (p.y - pv.y) ** 2, pv.pid) AS rn FROM {source} p JOIN pv ON {limit}) WHERE rn = 1) q JOIN fr ON fr.pid = least(greatest(near, 1), 99))"""


def _side(c: str) -> str:
    return f"CASE WHEN pb{c} IS NULL THEN nv{c} WHEN nb{c} IS NULL THEN pv{c} ELSE pv{c} + (nv{c} - pv{c}) * (bin - pb{c}) / greatest(nb{c} - pb{c}, 1) END AS {c}"


_ZONE = f"""{_PATH}, {_framed('v_donor', 'ed', '(p.x - pv.x) ** 2 + (p.y - pv.y) ** 2 < 64.0')},
zb AS (SELECT greatest(0, least(floor(total / 4.0) + 1, floor(s / 4.0)))::BIGINT AS bin, CASE WHEN count(*) FILTER (t < 0) >= 3 THEN quantile_cont(t, 0.02) FILTER (t < 0) END AS l, CASE WHEN count(*) FILTER (t > 0) >= 3 THEN quantile_cont(t, 0.98) FILTER (t > 0) END AS r FROM ed GROUP BY 1),
ev AS (SELECT e.bin, l, r FROM (SELECT unnest(range(0, (SELECT floor(max(total) / 4.0)::BIGINT + 2 FROM fr))) AS bin) e LEFT JOIN zb USING (bin)),
fi AS (SELECT bin, last_value(CASE WHEN l IS NOT NULL THEN bin END IGNORE NULLS) OVER b AS pbl, last_value(l IGNORE NULLS) OVER b AS pvl, first_value(CASE WHEN l IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS nbl, first_value(l IGNORE NULLS) OVER a AS nvl,
  last_value(CASE WHEN r IS NOT NULL THEN bin END IGNORE NULLS) OVER b AS pbr, last_value(r IGNORE NULLS) OVER b AS pvr, first_value(CASE WHEN r IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS nbr, first_value(r IGNORE NULLS) OVER a AS nvr
  FROM ev WINDOW b AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
zn AS MATERIALIZED (SELECT bin, CASE WHEN (SELECT count(*) FROM ed) < 20 OR (SELECT count(l) FROM zb) < 2 THEN -4.5 ELSE l END AS lo, CASE WHEN (SELECT count(*) FROM ed) < 20 OR (SELECT count(r) FROM zb) < 2 THEN 4.5 ELSE r END AS hi FROM (SELECT bin, {_side('l')}, {_side('r')} FROM fi))"""


def _path(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(101).select(F.lit(0).alias("way"), i.alias("seq"), i.alias("pid"), (i * F.lit(2.0)).alias("x"), (50.0 + 10.0 * F.sin(i / F.lit(10.0))).alias("y"))


def _zone(spark: SparkSession, d: str) -> DataFrame:
    return road.zone(_path(spark), B.donor(spark, d), size=4.0)


@query(f"WITH {_ZONE} SELECT bin, round(lo, 5) AS lo, round(hi, 5) AS hi FROM zn")
def road_zone(spark: SparkSession, d: str) -> DataFrame:
    return _zone(spark, d).select("bin", F.round("left", 5).alias("lo"), F.round("right", 5).alias("hi"))


@query(f"""
WITH {_ZONE}, {_framed('v_recipient', 'ob', 'true')},
j AS (SELECT ob.*, lo, hi, CASE WHEN abs(t - lo) < abs(t - hi) THEN lo - 0.5 ELSE hi + 0.5 END AS nt, t BETWEEN lo - 0.5 AND hi + 0.5 AS pushed, (SELECT count(*) FROM arc WHERE arc.s < ob.s) AS k FROM ob JOIN zn ON zn.bin = greatest(0, least(floor(total / 4.0) + 1, floor(s / 4.0))))
SELECT j.pid, round(CASE WHEN pushed THEN px + tx * (j.s - ps) - ty * nt ELSE j.x END, 4) AS x, round(CASE WHEN pushed THEN py + ty * (j.s - ps) + tx * nt ELSE j.y END, 4) AS y, pushed, round(CASE WHEN pushed THEN abs(nt - t) END, 4) AS moved FROM j JOIN fr ON fr.pid = least(greatest(k, 1), 99)
""")
def road_push_out(spark: SparkSession, d: str) -> DataFrame:
    o = road.push_out(B.recipient(spark, d), _zone(spark, d), _path(spark), size=4.0)
    return o.select("pid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "pushed", F.round("moved", 4).alias("moved"))


_RGB = "pid, intensity, (90 + (pid * 7) % 160)::DOUBLE AS r, (90 + (pid * 11) % 160)::DOUBLE AS g, (90 + (pid * 13) % 160)::DOUBLE AS b"


@query(f"""
WITH c AS (SELECT {_RGB} FROM v_points), q AS (SELECT quantile_cont((r + g + b) / 3.0, 0.5) AS bright, quantile_cont((r + g + b) / 3.0, 0.15) AS dark, quantile_cont(intensity, 0.3) AS strong FROM c)
SELECT pid, least(r, g, b) / (greatest(r, g, b) + 1e-6) > 0.8 AND (r + g + b) / 3.0 > bright AND intensity > strong AS white, g > r * 1.12 AND g > b * 1.12 AND (r + g + b) / 3.0 > dark AS green FROM c, q
""")
def paint_and_plants(spark: SparkSession, d: str) -> DataFrame:
    level = lambda k: (90 + (F.col("pid") * k) % 160).cast("double")
    c = B.points(spark, d).select("pid", "intensity", level(7).alias("r"), level(11).alias("g"), level(13).alias("b"))
    mean = c.select(((F.col("r") + F.col("g") + F.col("b")) / 3.0).alias("m"), "intensity")
    dark, bright = spatial.quantiles(mean, "m", (0.15, 0.5))
    (strong,) = spatial.quantiles(mean, "intensity", (0.3,))
    rgb = [F.col(k) for k in "rgb"]
    return c.select("pid", rules.white_paint(*rgb, F.col("intensity"), bright, strong).alias("white"), rules.green(*rgb, dark).alias("green"))


@query(_DB + """, t AS (SELECT cluster, min(z) AS lo, max(z) - min(z) AS h FROM db JOIN v_points USING (pid) WHERE cluster IS NOT NULL GROUP BY 1),
w AS (SELECT cluster, any_value(h) AS h, greatest(max(x) FILTER (up) - min(x) FILTER (up), max(y) FILTER (up) - min(y) FILTER (up)) AS head, greatest(max(x) FILTER (NOT up) - min(x) FILTER (NOT up), max(y) FILTER (NOT up) - min(y) FILTER (NOT up)) AS shaft, count(*) FILTER (up) AS a, count(*) FILTER (NOT up) AS b
  FROM (SELECT cluster, h, x, y, z > lo + h * 0.5 AS up FROM db JOIN v_points USING (pid) JOIN t USING (cluster)) GROUP BY 1)
SELECT cluster, round(head, 4) AS head_width, round(shaft, 4) AS shaft_width, coalesce(h > 0.1 AND a > 1 AND b > 1 AND head > shaft * 1.5 AND head > 0.2, false) AS probable_sign FROM w""")
def head_shaft_widths(spark: SparkSession, d: str) -> DataFrame:
    g = C.head_shaft(B.points(spark, d).join(_db(spark, d), "pid"), share=0.5, least=1, least_height=0.1)
    return g.select("cluster", F.round("head_width", 4).alias("head_width"), F.round("shaft_width", 4).alias("shaft_width"), "probable_sign")


@query(_DB + """, g AS (SELECT cluster, count(*) AS n, max(z) - min(z) AS h, greatest(max(x) - min(x), max(y) - min(y)) AS w, avg(x) AS x, avg(y) AS y FROM db JOIN v_points USING (pid) WHERE cluster IS NOT NULL GROUP BY 1),
s AS (SELECT *, n >= 4 AND h >= 0.05 AND w <= 3.0 AND h / greatest(w, 0.01) >= 0.1 AS shaped FROM g),
r AS (SELECT cluster, sqrt(min((s.x - p.x) ** 2 + (s.y - p.y) ** 2)) AS road FROM s JOIN v_points p ON abs(s.x - p.x) <= 2.0 AND abs(s.y - p.y) <= 2.0 WHERE shaped AND cls = 'error' AND (s.x - p.x) ** 2 + (s.y - p.y) ** 2 <= 4.0 GROUP BY 1)
SELECT cluster, n AS n_points, CASE WHEN shaped THEN 'pole' ELSE 'remove' END AS shape, round(road, 4) AS road_distance, shaped AND road IS NOT NULL AS keep, CASE WHEN NOT shaped THEN 'no shape' WHEN road IS NULL THEN 'pole, but over 2.0 m from the road' ELSE 'pole' END AS reason FROM s LEFT JOIN r USING (cluster)""")
def cluster_decisions(spark: SparkSession, d: str) -> DataFrame:
    wide = C.ShapeRules(4, 50_000_000, 0.05, 3.0, 0.1, 0.0, 0.0, 1e9, 1e9, None, -1e9)
    p = B.points(spark, d)
    o = C.decisions(p.select("pid", "x", "y", "z"), _db(spark, d), wide, 1e6, p.where("cls = 'error'"), 2.0)
    return o.withColumn("road_distance", F.round("road_distance", 4))


@query("""
SELECT pid, coalesce(abs(0.02::DOUBLE * x - 0.01::DOUBLE * y + z - 6.0) / sqrt(0.02::DOUBLE * 0.02 + 0.01::DOUBLE * 0.01 + 1.0) < 0.25 OR abs(z - l) < 0.3 OR z < 7.0 - 0.1, false) AS ground, z < 7.0 + 8.0 AS low_noise, z > 7.0 + 1.5 AND z < 7.0 + 15.0 AS band_noise
FROM v_points p LEFT JOIN (SELECT floor(x / 4.0) AS cx, floor(y / 4.0) AS cy, median(z) AS l FROM v_points GROUP BY 1, 2) g ON g.cx = floor(p.x / 4.0) AND g.cy = floor(p.y / 4.0)
""")
def ground_and_noise(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.geometry import plane_distance

    p = B.points(spark, d)
    local = spatial.cell_median(p, 4.0)
    j = p.withColumn("cx", spatial.cell("x", 4.0)).withColumn("cy", spatial.cell("y", 4.0)).join(local, ["cx", "cy"], "left")
    z = F.col("z")
    return j.select("pid", rules.ground_mask(plane_distance(0.02, -0.01, 1.0, -6.0), z, F.col("ground"), 7.0).alias("ground"), rules.noise_keep(z, 7.0, None, 8.0).alias("low_noise"), rules.noise_keep(z, 7.0, 1.5, 15.0).alias("band_noise"))


@query(f"""
SELECT pid, utc_us, ((utc_us + 18000000 - 315964800000000) // 604800000000)::BIGINT AS gps_week, ((utc_us + 18000000 - 315964800000000) % 604800000000)::BIGINT AS sow_us
FROM (SELECT pid, CASE WHEN pid % 3 <> 0 THEN us // 1000 * 1000 WHEN pid % 2 = 0 THEN us END AS utc_us, {_NAME} AS image FROM v_points) WHERE utc_us IS NOT NULL
""")
def time_sync_records(spark: SparkSession, d: str) -> DataFrame:
    """A third of the names hold no time; half the images hold Exif times."""
    n = _names(spark, d).select("pid", F.when(F.col("pid") % 3 == 0, F.regexp_replace("image", "utc-", "at-")).otherwise(F.col("image")).alias("image"), F.when(F.col("pid") % 2 == 0, F.col("us")).alias("exif_us"))
    return TC.sync_records(n).select("pid", "utc_us", "gps_week", "sow_us")


_TURNED = "cos(radians(pid % 360)) AS c, sin(radians(pid % 360)) AS s"


@query(f"""
WITH t AS (SELECT pid, x - 100.0 AS a, y - 50.0 AS b, z + 400.0 AS h, {_TURNED} FROM v_points)
SELECT pid, round(900.0 * (c * a + s * b) / h + 640.0, 4) AS u, round(900.0 * (c * b - s * a) / h + 512.0, 4) AS v, round(h, 6) AS depth FROM t
""")
def projection_matrix_points(spark: SparkSession, d: str) -> DataFrame:
    m = R.about("z", F.radians((F.col("pid") % 360).cast("double")))
    p = CAM.projection_matrix(m, [F.lit(100.0), F.lit(50.0), F.lit(-400.0)], 900.0, 900.0, 640.0, 512.0)
    u, v, depth = CAM.project_homogeneous(p, [F.col(c) for c in "xyz"])
    return B.points(spark, d).select("pid", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"), F.round(depth, 6).alias("depth"))


@query("SELECT pid, round((y - x) * 1000, 3) AS dx_mm, round((z - y) * 1000, 3) AS dy_mm, round((x - z) * 1000, 3) AS dz_mm, round(((pid % 80) - (pid % 50))::DOUBLE, 5) AS droll, round(((pid % 30) - (pid % 60))::DOUBLE, 5) AS dpitch, round(((pid % 90) - (pid % 70))::DOUBLE, 5) AS dyaw FROM v_points")
def pose_difference(spark: SparkSession, d: str) -> DataFrame:
    turn = lambda *k: R.euler_zyx(*(F.radians((F.col("pid") % n).cast("double")) for n in k))
    x, y, z = (F.col(c) for c in "xyz")
    out = R.pose_difference(turn(50, 60, 70), [x, y, z], turn(80, 30, 90), [y, z, x])
    names = [("dx_mm", 3), ("dy_mm", 3), ("dz_mm", 3), ("droll", 5), ("dpitch", 5), ("dyaw", 5)]
    return B.points(spark, d).select("pid", *((F.round(c, n) + 0.0).alias(k) for c, (k, n) in zip(out, names, strict=True)))


_F = "(1.0::DOUBLE / 298.257223563)"


@query(f"""
WITH RECURSIVE e AS (SELECT a.osm_id AS k, atan((1 - {_F}) * tan(radians(a.lat))) AS u1, atan((1 - {_F}) * tan(radians(b.lat))) AS u2, radians(b.lon - a.lon) AS l FROM v_entities a JOIN v_entities b ON b.osm_id = a.osm_id + 20),
it AS (SELECT k, 0 AS i, u1, u2, l, l AS lam FROM e UNION ALL
  SELECT k, i + 1, u1, u2, l, l + (1 - c) * {_F} * al * (sg + c * sn * (m + c * cs * (2 * m * m - 1))) FROM (SELECT *, {_F} / 16 * sq * (4 + {_F} * (4 - 3 * sq)) AS c, CASE WHEN sq > 1e-12 THEN cs - 2 * sin(u1) * sin(u2) / sq ELSE 0 END AS m FROM (SELECT *, 1 - al * al AS sq, atan2(sn, cs) AS sg FROM (SELECT *, CASE WHEN sn > 0 THEN cos(u1) * cos(u2) * sin(lam) / sn ELSE 0 END AS al FROM
    (SELECT *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS sn, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it WHERE i < 12)))))
, z AS (SELECT k, sn, cs, atan2(sn, cs) AS sg, 1 - al * al AS sq, sin(u1) * sin(u2) AS ss FROM (SELECT *, CASE WHEN sn > 0 THEN cos(u1) * cos(u2) * sin(lam) / sn ELSE 0 END AS al FROM (SELECT *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS sn, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it WHERE i = 12))),
y AS (SELECT *, CASE WHEN sq > 1e-12 THEN cs - 2 * ss / sq ELSE 0 END AS m, 6378137.0::DOUBLE * (1 - {_F}) AS b, sq * (1 / ((1 - {_F}) * (1 - {_F})) - 1) AS q FROM z),
x AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS p, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS r FROM y)
SELECT k, round(b * p * (sg - r * sn * (m + r / 4 * (cs * (2 * m * m - 1) - r / 6 * m * (4 * sn * sn - 3) * (4 * m * m - 3)))), 4) AS metres FROM x
""")
def geodesic_chain(spark: SparkSession, d: str) -> DataFrame:
    a = B.entities(spark, d)
    b = a.select((F.col("osm_id") - 20).alias("k"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return a.withColumnRenamed("osm_id", "k").join(b, "k").select("k", F.round(G.geodesic_inverse(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 4).alias("metres"))


@query()
def pose_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Each user's path as a graph of its first measurements in order, drifting nodes against exact steps."""
    from pyspark.sql import Window

    p = B.points(spark, d).select("user_id", "us", "pid", "x", "y")
    w = Window.partitionBy("user_id").orderBy("us", "pid")
    e = p.select(F.col("user_id").alias("graph"), F.col("pid").alias("a"), F.lead("pid").over(w).alias("b"), (F.lead("x").over(w) - F.col("x")).alias("dx"), (F.lead("y").over(w) - F.col("y")).alias("dy"), F.lit(0.0).alias("dyaw"), F.lit(None).cast("array<double>").alias("info")).where("b IS NOT NULL")
    n = p.select(F.col("user_id").alias("graph"), F.col("pid").alias("node"), (F.col("x") + F.col("pid") % 7 / 10.0).alias("x"), "y", F.lit(0.0).alias("yaw"))
    return solve.solve_pose_graphs(n, e)
