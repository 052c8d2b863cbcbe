"""Views that let general tables stand for survey tables, in Spark and (for oracles) in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_D = "CAST(100.0 AS DOUBLE)"
_POINTS = f"event_id AS pid, (us % 20011) / {_D} AS x, ((CAST(round(value * 100) AS BIGINT) * 7919) % 10007) / {_D} AS y, value / {_D} AS z, value AS intensity, event_type AS cls, user_id, ts, us"
_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
_BOXES = f"o_orderkey AS id, o_custkey % 50 AS image, CASE WHEN o_orderkey % 3 = 0 THEN 'light' ELSE 'sign' END AS kind, (o_orderkey * 37) % 900 AS x1, (o_orderkey * 91) % 700 AS y1, (o_orderkey * 37) % 900 + 20 + o_orderkey % 60 AS x2, (o_orderkey * 91) % 700 + 20 + o_orderkey % 40 AS y2, (o_orderkey % 100) / {_D} AS score"
_E = "CAST(100000.0 AS DOUBLE)"
_LON, _LAT = "CAST(7.0 AS DOUBLE)", "CAST(50.7 AS DOUBLE)"
_ENTITIES = f"c_custkey AS osm_id, CASE WHEN c_custkey % 3 = 0 THEN 'way' ELSE 'node' END AS osm_type, {_LON} + ((c_custkey * c_custkey * 31 + 7 * c_custkey) % 1999) / {_E} AS lon, {_LAT} + ((c_custkey * c_custkey * 17 + c_custkey) % 1997) / {_E} AS lat"
_POLES = f"s_suppkey AS pole_id, n_name AS pair, {_LON} + ((s_suppkey * s_suppkey * 113 + 5 * s_suppkey) % 1999) / {_E} AS lon, {_LAT} + ((s_suppkey * s_suppkey * 71 + 3 * s_suppkey) % 1997) / {_E} AS lat, s_suppkey % 7 + 1 AS n_observations, s_suppkey % 2 = 0 AS dual_pass"
_BULK = "l_partkey / CAST(10.0 AS DOUBLE) AS x, CAST(l_suppkey AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS z, CAST(l_extendedprice AS DOUBLE) AS intensity"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("*", f"{_US} AS us").selectExpr(*_split(_POINTS))


def donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("cls IN ('view', 'click')")


def recipient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("cls NOT IN ('view', 'click')")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("cls = 'error'").selectExpr("pid AS image", "user_id % 4 AS serial", "us AS t", "x", "y", "z")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*_split(_BOXES))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(*_split(_ENTITIES))


def poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(*_split(_POLES))


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*_split(_BULK))


def _split(columns: str) -> list[str]:
    """Splits a select list at its outer commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


def with_views(sql: str) -> str:
    """The oracle's text after the views that it names."""
    views = {
        "v_points": f"SELECT {_POINTS} FROM (SELECT *, epoch_us(ts) AS us FROM events)",
        "v_donor": "SELECT * FROM v_points WHERE cls IN ('view', 'click')",
        "v_recipient": "SELECT * FROM v_points WHERE cls NOT IN ('view', 'click')",
        "v_shots": "SELECT pid AS image, user_id % 4 AS serial, us AS t, x, y, z FROM v_points WHERE cls = 'error'",
        "v_boxes": f"SELECT {_BOXES} FROM orders",
        "v_entities": f"SELECT {_ENTITIES} FROM customer",
        "v_poles": f"SELECT {_POLES} FROM supplier JOIN nation ON n_nationkey = s_nationkey",
        "v_bulk": f"SELECT {_BULK} FROM lineitem",
    }
    need = [v for v in views if v in sql]
    if any(v in ("v_donor", "v_recipient", "v_shots") for v in need) and "v_points" not in need:
        need.insert(0, "v_points")
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    rest = body[len("WITH RECURSIVE") :] if recursive else body[4:] if body.upper().startswith("WITH") else None
    head = ", ".join(f"{v} AS MATERIALIZED ({views[v]})" for v in need)
    if not need:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}" + (f", {rest.strip()}" if rest is not None else f" {body}")
