"""Survey side files: camera shots, calibration, trajectories, detections, maps.

Small JSON and XML files are read by Spark's own readers; every reader gives a typed table. A missing
optional file gives an empty table where the docstring says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHOT = "struct<Image string, SerialNr string, Time double, Xyz array<double>, Hrp array<double>>"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def camera_shots(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, margin: float = 20.0) -> DataFrame:
    """image, serial, time, x, y, z, h, r, p from a JSON list, or an object with one under Profiler_0."""
    text = spark.read.text(path, wholetext=True)
    inside = F.coalesce(F.get_json_object("value", "$.Profiler_0"), F.col("value"))
    s = text.select(F.explode(F.from_json(inside, f"array<{SHOT}>")).alias("s"))
    out = s.select(F.col("s.Image").alias("image"), F.col("s.SerialNr").alias("serial"), F.col("s.Time").alias("time"), *(F.get("s.Xyz", F.lit(i)).alias(c) for i, c in enumerate("xyz")), *(F.get("s.Hrp", F.lit(i)).alias(c) for i, c in enumerate("hrp")))
    if box is not None:
        x1, y1, x2, y2 = box
        out = out.where(F.col("x").between(x1 - margin, x2 + margin) & F.col("y").between(y1 - margin, y2 + margin))
    return out


def calibration(spark: SparkSession, path: str, tag: str = "Camera") -> DataFrame:
    """serial, name, image_w, image_h, fx, fy, cx, cy, k1..k4 from calibration XML; values may be children or attributes."""
    raw = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").load(path)
    flat = {name.split(".")[-1].lstrip("_").lower(): F.col(name) for name in _leaves(raw.schema)}

    def get(*names: str, kind: str = "double") -> Column:
        return next((flat[n].cast(kind) for n in names if n in flat), F.lit(None).cast(kind))

    return raw.select(
        get("serialno", "serial", "serialnr", kind="string").alias("serial"),
        get("name", "cameraname", kind="string").alias("name"),
        get("width", "image_w", "imagewidth", kind="int").alias("image_w"),
        get("height", "image_h", "imageheight", kind="int").alias("image_h"),
        *(get(c).alias(c) for c in ("fx", "fy", "cx", "cy", "k1", "k2", "k3", "k4")),
    )


def _leaves(schema, prefix: str = "") -> list[str]:
    from pyspark.sql.types import StructType

    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out += _leaves(f.dataType, f"{name}.") if isinstance(f.dataType, StructType) else [name]
    return out


def write_calibration(table: DataFrame, path: str) -> None:
    table.write.format("xml").option("rootTag", "Calibration").option("rowTag", "Camera").mode("overwrite").save(path)


def pinhole_table(spark: SparkSession, path: str) -> DataFrame:
    """serial, camera_name, fx, fy, cx, cy from {serial: {...}}."""
    t = spark.read.text(path, wholetext=True)
    kind = "map<string,struct<camera_name string, fx double, fy double, cx double, cy double>>"
    return t.select(F.explode(F.from_json("value", kind)).alias("serial", "k")).select("serial", "k.*")


def pose_corrections(spark: SparkSession, path: str, serials: DataFrame) -> DataFrame:
    """Corrections of each serial; identity where the file has none."""
    t = spark.read.text(path, wholetext=True)
    kind = "map<string,struct<dR array<array<double>>, dt array<double>>>"
    c = t.select(F.explode(F.from_json("value", kind)).alias("serial", "c")).select("serial", F.col("c.dR").alias("dr"), F.col("c.dt").alias("dt"))
    one = F.array(*(F.array(*(F.lit(float(i == j)) for j in range(3))) for i in range(3)))
    return serials.join(c, "serial", "left").withColumn("dr", F.coalesce("dr", one)).withColumn("dt", F.coalesce("dt", F.array(*[F.lit(0.0)] * 3)))


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """time, e, n, h, roll, pitch, heading from white-space separated lines; comments and short or bad rows are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    names = ("time", "e", "n", "h", "roll", "pitch", "heading")
    rows = spark.read.text(path).where(~F.trim("value").startswith("#")).where(F.size(p) >= 7)
    return rows.select(*(F.get(p, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(names))).dropna()


def detections(spark: SparkSession, *paths: str) -> DataFrame:
    """Detections of one or more JSON-lines files."""
    schema = "image string, kind string, bbox_px array<double>, sam3_score double, label string, clf_conf double, stvo_code string"
    d = spark.read.schema(schema).json(list(paths))
    return d.select("*", *(F.get("bbox_px", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2")))).drop("bbox_px")


def geojson(spark: SparkSession, path: str, properties: str = "map<string,string>") -> DataFrame:
    """kind, coordinates (list of positions) and properties of each feature; no file: no rows."""
    schema = f"kind string, coordinates array<array<double>>, properties {properties}"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    t = spark.read.text(path, wholetext=True)
    f = t.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), f"array<struct<geometry struct<type string, coordinates string>, properties {properties}>>")).alias("f"))
    c = F.col("f.geometry.coordinates")
    many = F.when(F.col("f.geometry.type") == "Point", F.array(F.from_json(c, "array<double>"))).otherwise(F.from_json(c, "array<array<double>>"))
    return f.select(F.col("f.geometry.type").alias("kind"), many.alias("coordinates"), F.col("f.properties").alias("properties"))


def feature(kind: str, coordinates: Column, properties: Column) -> Column:
    """One GeoJSON feature as text."""
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"' + kind + '","coordinates":'), F.to_json(coordinates), F.lit('},"properties":'), F.to_json(properties), F.lit("}"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Line-delimited features (one ``feature`` column), a file for each partition: nothing is gathered."""
    features.select("feature").write.mode("overwrite").text(path)


def osm_signals(spark: SparkSession, path: str) -> DataFrame:
    """osm_type, osm_id, lon, lat of traffic signals in cached map JSON; a way stands at the mean of its geometry."""
    element = "struct<type string, id long, lat double, lon double, tags map<string,string>, geometry array<struct<lat double, lon double>>>"
    t = spark.read.text(path, wholetext=True)
    e = t.select(F.explode(F.from_json(F.get_json_object("value", "$.elements"), f"array<{element}>")).alias("e")).select("e.*")
    signal = (F.col("tags")["highway"] == "traffic_signals") | (F.col("tags")["crossing"] == "traffic_signals")
    mean = lambda c: F.aggregate(F.col("geometry"), F.lit(0.0), lambda a, g: a + g[c]) / F.size("geometry")
    return e.where(F.coalesce(signal, F.lit(False))).select(F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), F.coalesce("lon", mean("lon")).alias("lon"), F.coalesce("lat", mean("lat")).alias("lat")).where("lon IS NOT NULL")


def osm_tables(lines: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ways of a map: lines (line_id, marking_type, points array of lon/lat/z structs), objects
    (object_id, kind, code, lon, lat, z). Ids are negative and descending in order of the input ids."""
    from pyspark.sql import Window

    v = lines.select("line_id", F.posexplode("points").alias("pos", "p")).select(F.lit(0).alias("part"), "line_id", "pos", "p.lon", "p.lat", "p.z", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("code"))
    o = objects.select(F.lit(1).alias("part"), F.col("object_id").alias("line_id"), F.lit(0).alias("pos"), "lon", "lat", "z", "kind", "code")
    w = Window.orderBy("part", "line_id", "pos")  # the map of one tile
    nodes = v.unionByName(o).withColumn("id", -F.row_number().over(w))
    refs = nodes.where("part = 0").groupBy("line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("nodes"))
    ways = lines.select("line_id", "marking_type").join(refs, "line_id").withColumn("id", -1_000_000_000 - F.row_number().over(Window.orderBy("line_id")))
    return nodes, ways


def write_osm_xml(nodes: DataFrame, ways: DataFrame, path: str) -> None:
    """OSM XML of one tile's map, in one file under ``path``: coordinates with 8 decimals, nodes before ways."""
    tag = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f'<tag k="{k}" v="'), v, F.lit('"/>')))
    n = nodes.select(F.lit(1).alias("o"), F.col("id"), F.concat(F.format_string('<node id="%d" lat="%.8f" lon="%.8f">', "id", "lat", "lon"), F.format_string('<tag k="ele" v="%.3f"/>', "z"), F.coalesce(tag("hd:type", F.col("kind")), F.lit("")), F.coalesce(tag("hd:code", F.col("code")), F.lit("")), F.lit("</node>")).alias("value"))
    sub = F.when(F.col("marking_type") == "stop_line", "stop_line").otherwise("line_thin")
    w = ways.select(F.lit(2).alias("o"), F.col("id"), F.concat(F.format_string('<way id="%d">', "id"), F.array_join(F.transform("nodes", lambda x: F.format_string('<nd ref="%d"/>', x)), ""), tag("type", sub), tag("subtype", F.when(F.col("marking_type") == "dashed", "dashed").otherwise("solid")), F.lit("</way>")).alias("value"))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, 0, '<osm version="0.6" generator="kerbline">'), (3, 0, "</osm>")], "o int, id long, value string")
    n.unionByName(w).unionByName(ends.withColumn("id", F.col("id").cast("long"))).orderBy("o", F.desc("id")).select("value").coalesce(1).write.mode("overwrite").text(path)


def write_ply(points: DataFrame, path: str) -> None:
    """ASCII PLY as a folder: header first, then rows in order of pid."""
    n = points.count()
    header = ["ply", "format ascii 1.0", f"element vertex {n}", *(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), "end_header"]
    spark = points.sparkSession
    h = spark.createDataFrame([(-1, i, t) for i, t in enumerate(header)], "o long, pid long, value string")
    rows = points.select(F.lit(0).cast("long").alias("o"), "pid", F.format_string("%.3f %.3f %.3f %d %d %d", "x", "y", "z", "r", "g", "b").alias("value"))
    h.unionByName(rows).orderBy("o", "pid").select("value").write.mode("overwrite").text(path)


def images(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Wanted images (column image) with their bytes; null where the file is missing."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("image"), "content")
    return wanted.join(files, "image", "left")
