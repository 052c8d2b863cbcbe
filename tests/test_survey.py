"""Cameras, roads, passes, quantiles and the nearest rows beyond the first cells, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import cluster, road, solve, spatial, views


def test_nearest_goes_down_to_far_groups(spark):
    rng = np.random.default_rng(1)
    left = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-500, 500, (120, 2)))]
    right = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.normal((900, 900), 2, (150, 2)), rng.normal((-700, 40), 30, (80, 2)), [(3.0, 4.0), (3.0, 4.0)]]))]
    got = {r.pid: (r.near, r.d2) for r in spatial.nearest(spark.createDataFrame(left, "pid long, x double, y double"), spark.createDataFrame(right, "pid long, x double, y double"), 2.0).collect()}
    for pid, x, y in left:
        d, near = min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in right)
        assert got[pid][0] == near and got[pid][1] == pytest.approx(d)
    assert spatial.nearest(spark.createDataFrame(left, "pid long, x double, y double"), spark.createDataFrame([], "pid long, x double, y double"), 2.0).count() == 0
    one = spatial.nearest(spark.createDataFrame([(1, 0.0, 0.0)], "pid long, x double, y double"), spark.createDataFrame([(7, 900.0, -900.0)], "pid long, x double, y double"), 2.0)
    assert [(r.pid, r.near) for r in one.collect()] == [(1, 7)]


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], list(np.random.default_rng(2).exponential(1e6, 3000)), [5.0] * 900 + [1e300, -1e300] + list(range(800))])
def test_quantiles_cut_bins_again(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    shares = (0.0, 0.02, 0.5, 0.777, 1.0)
    assert spatial.quantiles(df, "v", shares, bins=16, few=20) == pytest.approx(list(np.quantile(np.array(values, float), shares)))


def test_quantiles_of_nothing(spark):
    with pytest.raises(ValueError):
        spatial.quantiles(spark.createDataFrame([], "v double"), "v", (0.5,))


def test_geodesic(spark):
    r = spark.range(1).select(geo.geodesic_inverse(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("equator"), geo.geodesic_inverse(F.lit(144.42486789), F.lit(-37.95103342), F.lit(143.92649553), F.lit(-37.65282114), geo.ELLIPSOIDS["GRS80"]).alias("line"), geo.geodesic_inverse(F.lit(7.0), F.lit(50.0), F.lit(7.0), F.lit(50.0)).alias("same")).first()
    assert r.equator == pytest.approx(6378137.0 * np.pi / 180, abs=1e-4)
    assert r.line == pytest.approx(54972.271, abs=2e-3)
    assert r.same == 0


def camera(spark, n=1):
    c = spark.createDataFrame([(i, 0.0, 0.0, 0.0, 100.0, 100.0, 50.0, 40.0, 100, 80) for i in range(n)], "image long, x double, y double, z double, fx double, fy double, cx double, cy double, width int, height int")
    zero, one = F.lit(0.0), F.lit(1.0)
    return views.with_turn(c, [[one, zero, zero], [zero, zero, one], [zero, -one, zero]])


def test_localise_takes_the_compact_group_and_falls_back(spark):
    sign = [(i, 0.02 * i, 8.0 + 0.01 * i, 0.0) for i in range(6)]
    wall = [(100 + i, -0.5 + 0.2 * i, 25.0, 0.0) for i in range(6)]
    p = spark.createDataFrame(sign + wall, "pid long, x double, y double, z double")
    boxes = spark.createDataFrame([(1, 0, "sign", 45.0, 35.0, 55.0, 45.0), (2, 0, "sign", 5.0, 5.0, 11.0, 11.0), (3, 9, "sign", 5.0, 5.0, 11.0, 11.0)], "id long, image long, kind string, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r for r in views.localise(boxes, camera(spark), p, share=0.4).collect()}
    assert set(got) == {1, 2}
    assert got[1].matched and got[1].y == pytest.approx(8.02, abs=0.03)
    assert not got[2].matched and got[2].y == pytest.approx(10.0) and got[2].x == pytest.approx(-4.2)
    # Only the wall is seen, far beyond what the box's size tells: the background is not taken.
    alone = views.localise(boxes.withColumn("x1", F.lit(40.0)).withColumn("x2", F.lit(60.0)).where("id = 1"), camera(spark), p.where("pid >= 100"), share=1.0, span=9.0).first()
    assert not alone.matched and alone.y == pytest.approx(3.0)
    assert views.localise(boxes.limit(0), camera(spark), p).count() == 0


def test_colourise_occlusion_and_default(spark):
    p = spark.createDataFrame([(1, 0.0, 5.0, 0.0), (2, 0.0, 9.0, 0.0), (3, 0.0, -5.0, 0.0)], "pid long, x double, y double, z double")
    images = spark.createDataFrame([(0, 100, 80, bytearray([10, 20, 30] * 8000)), (1, 100, 80, bytearray([40, 50, 60] * 8000))], "image long, width int, height int, pixels binary")
    got = {r.pid: r for r in views.colourise(p, camera(spark, 2), images).collect()}
    assert (got[1].image, got[1].red, got[1].blue) == (0, 2570, 7710)
    assert all(got[k].image is None and got[k].green == 60 * 257 for k in (2, 3))
    masked = {r.pid: r.image for r in views.colourise(p, camera(spark, 2), images, clear=F.col("image") == 1).collect()}
    assert masked == {1: 1, 2: None, 3: None}


def test_zone_falls_back_without_paint(spark):
    path = spark.createDataFrame([(0, i, i, float(i), 0.0) for i in range(11)], "way long, seq long, pid long, x double, y double")
    paint = spark.createDataFrame([(i, 0.1 * i, 3.0 if i % 2 else -2.0) for i in range(60)], "pid long, x double, y double")
    z = road.zone(path, paint).collect()
    assert len(z) == 7 and all(r.left == pytest.approx(-2.0) and r.right == pytest.approx(3.0) for r in z)
    assert all((r.left, r.right) == (-4.5, 4.5) for r in road.zone(path, paint.limit(5)).collect())
    o = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, -1.0), (3, 5.0, 9.0), (4, 0.0, 0.0)], "pid long, x double, y double")
    got = {r.pid: r for r in road.push_out(o, road.zone(path, paint), path).collect()}
    assert (got[1].x, got[1].y, got[1].pushed, got[1].moved) == (pytest.approx(5.0), pytest.approx(3.5), True, pytest.approx(2.5))
    assert got[2].y == pytest.approx(-2.5) and not got[3].pushed and got[3].y == 9.0 and len(got) == 4


def test_cross_pass_agrees_only_where_both_converge(spark):
    k = (800.0, 800.0, 640.0, 512.0)
    rows = []
    for obj, off in ((1, 0.0), (2, 900.0)):
        for side in (1, 2):
            for j in range(3):
                cam = np.array([4.0 * j + side, 0.0, 0.0])
                q = np.array([5.0, 20.0, 2.0]) - cam  # The camera looks along y, its y axis is down.
                u, v = 800 * q[0] / q[1] + 640, -800 * q[2] / q[1] + 512
                rows.append((obj, side, 6.0, 18.0, 1.0, [float(c) for c in cam], [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0], float(u + (off if side == 2 and j == 1 else 0.0)), float(v)))
    rows.append((3, 1, 0.0, 9.0, 0.0, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0], 640.0, 512.0))
    o = spark.createDataFrame(rows, "object_id long, pass int, sx double, sy double, sz double, cam array<double>, rot array<double>, u double, v double")
    got = {r.object_id: r for r in solve.cross_pass(o, k).collect()}
    assert set(got) == {1, 2}
    assert got[1].trusted and got[1].spatial < 0.05 and (got[1].n1, got[1].n2) == (3, 3)
    assert not got[2].trusted


def test_pose_graphs_close_their_loop(spark):
    edge = lambda g, a, b, x: (g, a, b, x, 0.0, 0.0, None)
    n = spark.createDataFrame([("p", i, i * 1.1, 0.0, 0.0) for i in range(5)] + [("lone", 9, 4.0, 5.0, 0.5)], "graph string, node long, x double, y double, yaw double")
    e = spark.createDataFrame([edge("p", i, i + 1, 1.1) for i in range(4)] + [edge("p", 0, 4, 4.0), edge("p", 0, 77, 1.0)], "graph string, a long, b long, dx double, dy double, dyaw double, info array<double>")
    got = {(r.graph, r.node): r for r in solve.solve_pose_graphs(n, e).collect()}
    assert got["lone", 9].x == 4.0 and got["p", 0].x == 0.0
    assert [got["p", i].x for i in range(5)] == pytest.approx([i * 1.02 + 0.0 for i in range(5)], abs=0.01)


def test_head_wider_than_shaft(spark):
    pole = [(1, 0.05 * (i % 2), 0.0, 0.1 * i) for i in range(20)] + [(1, 0.4 * (i % 2), 0.0, 1.9 + 0.02 * i) for i in range(8)]
    plain = [(2, 0.05 * (i % 2), 0.0, 0.1 * i) for i in range(28)]
    flat = [(3, float(i), 0.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(pole + plain + flat, "cluster long, x double, y double, z double")
    got = {r.cluster: r for r in cluster.head_shaft(df).collect()}
    assert got[1].probable_sign and got[1].head_width == pytest.approx(0.4) and not got[2].probable_sign
    assert not got[3].probable_sign and got[3].head_width is None
