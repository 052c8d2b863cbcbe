"""What showed on larger tables: copies of rows, dense places and tables beyond a bound."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import cluster, density, objects, solve, spatial, validate, views
from kerbline.plans.all_queries import ORACLE_SQL, QUERIES
from test_queries import DATA

KEYS = {"events": "event_id", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey"}


@pytest.fixture(scope="module")
def thrice(tmp_path_factory):
    """The survey's tables, three times with shifted keys."""
    at = tmp_path_factory.mktemp("thrice")
    c = duckdb.connect()
    for t, k in KEYS.items():
        c.execute(f"COPY (SELECT * REPLACE (({k} + r * (SELECT max({k}) + 1 FROM '{DATA}/{t}.parquet'))::BIGINT AS {k}) FROM '{DATA}/{t}.parquet', range(3) q(r)) TO '{at}/{t}.parquet'")
    c.execute(f"COPY (SELECT * FROM '{DATA}/nation.parquet') TO '{at}/nation.parquet'")
    return str(at)


def matches(spark, d, name):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in (*KEYS, "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = QUERIES[name](spark, d), c.sql(ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.project(", ".join(names)).fetchall()))


def test_trust_flags_every(spark, thrice):
    p = spark.createDataFrame([(1, 1.001, 2.0), (2, 9.0, 9.0)], "pid long, e double, n double")
    f = spark.createDataFrame([(1.0, 2.0, 1, "untrusted"), (1.0, 2.0, 2, "trusted")], "e double, n double, ord long, status string")
    assert sorted((r.pid, r.status) for r in validate.trust_flags(p, f, every=True).collect()) == [(1, "trusted"), (1, "untrusted"), (2, "not_checked")]
    matches(spark, thrice, "rounded_key_trust")


def test_copies_to_cells_are_not_broadcast(spark):
    p = spark.range(50).selectExpr("id AS pid", "id / 10.0D AS x", "id / 7.0D AS y", "0.0D AS z")
    for df in (spatial.radius_join(p, p, 1.0), spatial.self_pairs(p, 1.0, ("x", "y", "z"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_dbscan_pairs_places_not_copies(spark, monkeypatch):
    """Three places of 400 copies each, one of them alone, and two rows in reach of a place."""
    at = [(0.0, 0.0), (0.5, 0.0), (9.0, 9.0)]
    rows_ = [(i, *at[i % 3]) for i in range(1200)] + [(1200, 1.4, 0.0), (1201, 5.0, 5.0), (1202, None, 0.0), (1203, float("nan"), 0.0)]
    df = spark.createDataFrame(rows_, "pid long, x double, y double").withColumn("z", F.lit(0.0))
    found, pairs = [], spatial.self_pairs
    monkeypatch.setattr(spatial, "self_pairs", lambda *a, **k: found.append(pairs(*a, **k)) or found[-1])
    got = {r.pid: (r.core, r.cluster) for r in cluster.dbscan(df, 1.0, 402).collect()}
    assert found[0].count() == 2
    want = {i: (True, 0) if i % 3 < 2 else (False, None) for i in range(1200)}
    assert got == {**want, 1200: (False, 0), 1201: (False, None), 1202: (False, None), 1203: (False, None)}
    assert {r.pid: r.component for r in cluster.radius_components(df, 1.0).where("pid > 1199").collect()} == {1200: 0, 1201: 1201, 1202: 1202, 1203: 1203}


def test_polylines_of_copies(spark):
    p = spark.createDataFrame([(i, i % 40 / 4.0, (i % 40) ** 2 % 7 / 3.0) for i in range(40)], "pid long, x double, y double").selectExpr("*", "0.0D AS z", "1 AS cluster")
    copies = p.unionByName(p.withColumn("pid", F.col("pid") + 1000))
    line = lambda df: [tuple(r) for r in solve.polylines(df).orderBy("seq").collect()]
    assert len(line(p)) > 10 and line(copies) == line(p)


@pytest.mark.parametrize("name", ["dbscan_labels", "cluster_extents", "cluster_shape_class", "marking_class", "head_shaft_widths", "cluster_decisions", "connected_components", "nearest_k1", "ray_march_peak", "observation_gate", "way_corridor", "nearest_camera"])
def test_copies_match_oracle(spark, thrice, name):
    matches(spark, thrice, name)


def test_ray_march_meets_copies_once(spark, monkeypatch):
    """Ninety copies of three points and of two rays: as many rows meet as without copies."""
    p = spark.range(270).selectExpr("id AS pid", "5.0D + id % 3 / 10.0D AS x", "0.1D AS y", "id % 3 + 0.0D AS z")
    r = spark.range(180).selectExpr("id AS pid", "0.0D AS x", "0.0D AS y", "1.0D - 2 * (id % 2) AS dx", "0.0D AS dy")
    met, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    got = {tuple(x) for x in objects.ray_march(r, p, 0.6, 2).collect()}
    assert got == {(i, 4.75, 270, 1.0) for i in range(0, 180, 2)}
    assert met[0].count() < 30


def test_box_join_copies_to_the_offsets_side_only(spark):
    p = spark.range(400).selectExpr("id AS pid", "id % 20 / 2.0D AS x", "floor(id / 20) / 2.0D AS y")
    met = spatial.box_join(p, p, (-0.6, 0.0), (0.6, 2.0))
    inside = met.where("abs(r_x - x) <= 0.6 AND r_y - y > 0 AND r_y - y <= 2")
    want = {(a, b) for a in range(400) for b in range(400) if abs(a % 20 - b % 20) <= 1 and 0 < b // 20 - a // 20 <= 4}
    assert {(r.pid, r.r_pid) for r in inside.select("pid", "r_pid").collect()} == want
    assert met.where("r_y < y - 2").count() == 0


def test_paths_of_all_slopes(spark):
    """Against every segment, with upright, level and short ones; equal segments of two ways go to the smaller."""
    r = random.Random(4)
    at = [(r.uniform(-20, 20), r.uniform(-20, 20)) for _ in range(120)]
    seg = [(i, *at[i], *at[i + 1]) for i in range(40)] + [(50 + i, x, y, x + a, y + b) for i, (x, y) in enumerate(at[40:60]) for a, b in ((0.0, 9.0), (9.0, 0.0), (1e-7, 30.0), (0.3, -0.2))]
    seg += [(w + 1000, *s) for w, *s in seg]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at[60:])] + [(i + 500, *p) for i, p in enumerate(at[60:])], "pid long, x double, y double")

    def away(p, s):
        a, b, c, e = s[1:]
        t = max(0.0, min(1.0, ((p[0] - a) * (c - a) + (p[1] - b) * (e - b)) / ((c - a) ** 2 + (e - b) ** 2)))
        return math.hypot(p[0] - a - t * (c - a), p[1] - b - t * (e - b))

    want = {}
    for i, p in enumerate(at[60:]):
        d, way = min((round(away(p, s), 9), s[0]) for s in seg)
        want.update({i: way, i + 500: way} if d <= 1.5 else {})
    got = objects.point_to_paths(points, spark.createDataFrame(seg, "way long, ax double, ay double, bx double, by double"), 1.5)
    assert {x.pid: x.way for x in got.collect()} == want and len(want) > 40


def test_paths_meet_copies_once(spark):
    """3,000 copies of a point and of a way: nine million pairs and more if each met each."""
    from kerbline.functions import geometry

    seen, distance = spark.sparkContext.accumulator(0), geometry.segment_distance
    count = F.udf(lambda d: seen.add(1) or d, "double").asNondeterministic()
    points = spark.range(3000).selectExpr("id AS pid", "5.0D AS x", "0.5D AS y")
    ways = spark.range(3000).selectExpr("id AS way", "0.0D AS ax", "0.0D AS ay", "9.0D AS bx", "0.0D AS by")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(geometry, "segment_distance", lambda *a: count(distance(*a)))
        got = objects.point_to_paths(points, ways, 1.0)
    assert {tuple(r)[1:] for r in got.collect()} == {(0, 0.5)} and seen.value < 100


def test_nearest_searches_places(spark, monkeypatch):
    """Copies on both sides: as many rows meet as places do, and each copy finds the smallest id."""
    left = spark.range(600).selectExpr("id AS pid", "id % 3 * 4.0D AS x", "0.0D AS y")
    right = spark.range(600).selectExpr("id AS pid", "id % 3 * 4.0D + 0.5D AS x", "0.0D AS y").where("pid % 3 < 2")
    met, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    got = {tuple(r) for r in spatial.nearest(left, right, 1.0).collect()}
    assert got == {(i, *((0, 0.25), (1, 0.25), (1, 12.25))[i % 3]) for i in range(600)} and met[0].count() == 2


def test_localise_beside_the_camera(spark):
    """Points level with the camera have no depth to divide by, wherever the planner puts the condition; copies weigh."""
    c = views.with_turn(spark.createDataFrame([(0, 0.0, 0.0, 5.0)], "image long, x double, y double, z double"), [[F.lit(v) for v in row] for row in ((0.0, 0.0, 1.0), (-1.0, 0.0, 0.0), (0.0, -1.0, 0.0))])
    c = c.withColumns({"fx": F.lit(100.0), "fy": F.lit(100.0), "cx": F.lit(50.0), "cy": F.lit(50.0), "width": F.lit(100), "height": F.lit(100)})
    rows_ = [(0.0, 2.0, 5.0), (0.0, -2.0, 5.0), (0.0, 0.0, 5.0), (10.0, 0.1, 5.0), (10.0, 0.1, 5.0), (10.0, 0.4, 5.0), (-9.0, 0.0, 5.0)]
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "pid long, x double, y double, z double")
    b = spark.createDataFrame([(1, 0, "sign", 40, 40, 60, 60)], "id long, image long, kind string, x1 long, y1 long, x2 long, y2 long")
    u = F.col("u")
    assert views.seen(c, p, border=0).where((u > 40) | (F.col("v") > 0)).count() == 3
    got = views.localise(b, c, p, share=1.0, shrink=1.0, ratio=9.0).first()
    assert got.matched and abs(got.y - 0.2) < 1e-12 and got.x == 10.0


def test_geodesic_in_batches(spark):
    """Whole batches instead of an interpreted fold a row; nulls and antipodes have no distance."""
    e = spark.createDataFrame([(0, 0.0, 0.0, 180.0, 0.1), (1, None, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0, 0.0), (3, 5.0, 5.0, 5.0, 5.0)], "k long, a double, b double, c double, d double")
    df = e.select("k", geo.geodesic_inverse(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m"))
    got = {r.k: r.m for r in df.collect()}
    assert got[0] is None and got[1] is None and got[3] == 0 and abs(got[2] - 111319.4908) < 1e-4
    assert "lambdafunction" not in df._jdf.queryExecution().executedPlan().toString()


def test_nearest_halves_its_cells_where_right_is_dense(spark):
    """4000 places on a square metre are not all met by each row; far rows still find theirs, and ties go to the smaller id."""
    import numpy as np

    from kerbline.operators import spatial

    g = np.random.default_rng(2)
    right = [*g.random((4000, 2)).tolist(), [50.0, 50.0], [50.0, 52.0]]
    left = [*g.random((300, 2)).tolist(), [50.0, 51.0], [-30.0, 8.0]]
    table = lambda rows: spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "pid long, x double, y double")
    assert spatial._halved(table(right), 2.0, ("x", "y")) <= 0.125
    assert spatial._halved(table(right[4000:]), 2.0, ("x", "y")) == 2.0
    for a, b in ((left, right), (right, left)):
        got = {r.pid: (r.near, r.d2) for r in spatial.nearest(table(a), table(b), 2.0).collect()}
        want = {i: min(((x - u) * (x - u) + (y - v) * (y - v), k) for k, (u, v) in enumerate(b)) for i, (x, y) in enumerate(a)}
        assert {i: (k, d) for i, (d, k) in want.items()} == got


@pytest.fixture(scope="module")
def apart(thrice, tmp_path_factory):
    """The same with shifted times, so that copies lie at places of their own."""
    at = tmp_path_factory.mktemp("apart")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in (*KEYS, "nation"):
        shift = "SELECT * REPLACE (ts + to_microseconds(event_id // 1000 * 7919) AS ts)" if t == "events" else "SELECT *"
        c.execute(f"COPY ({shift} FROM '{thrice}/{t}.parquet') TO '{at}/{t}.parquet'")
    return str(at)


def test_dense_clouds_write_no_pairs(spark, monkeypatch):
    """Clusters that reach over blocks, with borders between them and noise, against all pairs."""
    import numpy as np

    monkeypatch.setattr(spatial, "self_pairs", lambda *a, **k: pytest.fail("pairs"))
    monkeypatch.setattr(density, "SIDES", (4,))
    g = np.random.default_rng(7)
    p = np.concatenate([np.round(g.normal(0, [4, 0.5, 0.5], (6000, 3)), 2), np.round(g.random((400, 3)) * [60, 5, 5] - [30, 0, 0], 1), g.normal(0, 0.5, (200, 3)) + [32, 0, 0], g.normal(0, 0.5, (200, 3)) - [32, 0, 0]])
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= 1.0
    core = near.sum(1) >= 40
    link, label = near & core[None], np.where(core, np.arange(len(p)), len(p))
    while True:
        now = np.where(core, np.where(link, label[None], len(p)).min(1), len(p))
        if (now == label).all():
            break
        label = now
    label = np.where(core, label, np.where(link, label[None], len(p)).min(1))
    want = {i: (bool(c), int(k) if k < len(p) else None) for i, (c, k) in enumerate(zip(core, label, strict=True))}
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "pid long, x double, y double, z double")
    got = cluster.dbscan(df, 1.0, 40).collect()
    assert {r.pid: (r.core, r.cluster) for r in got} == want and len(got) == len(p)
    assert len({k for _, k in want.values()}) > 3 and any(k is not None and not c for c, k in want.values())


BLOCKS = ["dbscan_labels"]


@pytest.mark.parametrize("name", BLOCKS)
def test_blocks_match_oracle(spark, thrice, apart, name, monkeypatch):
    monkeypatch.setattr(cluster, "PAIRS", -1)
    monkeypatch.setattr(density, "SIDES", (4,))
    for at in (thrice, apart):
        matches(spark, at, name)


def test_simplify_looks_at_few_runs():
    """A zigzag with many equally far vertices: the same ones are kept, and not all are looked at for each."""
    import numpy as np

    seen = [0]

    class Line(np.ndarray):
        def __getitem__(self, at):
            got = super().__getitem__(at)
            seen[0] += len(got) if got.ndim == 2 else 0
            return got

    g = np.random.default_rng(3)
    line = np.stack([np.arange(60_000) / 100.0, g.integers(0, 101, 60_000)], 1)
    kept = solve.simplify(line.view(Line), 60.0)
    ends = [0, len(line) - 1]
    while True:
        cuts = []
        for a, b in zip(ends, ends[1:], strict=False):
            d, p = line[b] - line[a], line[a + 1 : b] - line[a]
            away = np.abs(p[:, 0] * d[1] - p[:, 1] * d[0]) / np.linalg.norm(d)
            if len(away) and away.max() > 60.0:
                cuts.append(a + 1 + int(away.argmax()))
        if not cuts:
            break
        ends = sorted(ends + cuts)
    assert kept.tolist() == ends and len(ends) > 100 and seen[0] < 60 * len(line)


def test_localise_writes_no_contents_of_boxes(spark, monkeypatch):
    """Two hundred boxes around the same points: their contents are grouped where they are met, in parts too, all alike."""
    c = views.with_turn(spark.createDataFrame([(0, 0.0, 0.0, 5.0)], "image long, x double, y double, z double"), [[F.lit(v) for v in row] for row in ((0.0, 0.0, 1.0), (-1.0, 0.0, 0.0), (0.0, -1.0, 0.0))])
    c = c.withColumns({"fx": F.lit(100.0), "fy": F.lit(100.0), "cx": F.lit(50.0), "cy": F.lit(50.0), "width": F.lit(100), "height": F.lit(100)})
    p = spark.range(60).selectExpr("id AS pid", "10.0D + id % 2 * 5 AS x", "id % 10 / 20.0D AS y", "5.0D + id div 10 / 20.0D AS z")
    b = spark.range(200).selectExpr("id", "0L AS image", "'sign' AS kind", "20 + id % 8 AS x1", "20L AS y1", "80L AS x2", "80L AS y2")
    written, cut = [], views.cut
    monkeypatch.setattr(views, "cut", lambda df: written.append(cut(df)) or written[-1])
    monkeypatch.setattr(views, "PART", 50)
    got = views.localise(b, c, p, share=0.5, shrink=1.0, ratio=99.0).collect()
    # Half the points lie at depth 10, which is the quantile; 30 of them with y 0, 0.1 .. 0.4.
    assert {(r.matched, round(r.x, 9), round(r.y, 9), round(r.z, 9)) for r in got} == {(True, 10.0, 0.2, 5.125)} and len(got) == 200
    assert all(df.count() <= 60 for df in written)


def test_gate_exchanges_places_only(spark, thrice, apart):
    """Pairs that pass are rows at once: only the two sides are dealt, by place and by cell."""
    plan = QUERIES["observation_gate"](spark, thrice)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") <= 4 and plan.count("Join") == 1
    matches(spark, apart, "observation_gate")
