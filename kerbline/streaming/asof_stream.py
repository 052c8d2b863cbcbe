"""Extension: a stream of points matched to a static pose table, and windowed counts of late data.

The pose table is bucketed by time, so each micro-batch joins on the bucket; the nearest pose of the
bucket or its neighbours is chosen, ties to the earlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_poses(stream: DataFrame, poses: DataFrame, bucket: int) -> DataFrame:
    """Stream rows (pid, t, ...) with pose candidates of their time's bucket and its neighbours: pid, pose_id, dt.

    Within each micro-batch the nearest pose of each row remains (foreachBatch or append on the aggregate is
    not needed: an array of the candidates is reduced per row by a lateral fold).
    """
    b = lambda c: F.floor(F.col(c) / bucket).cast("long")
    spread = poses.select(F.col("t").alias("pose_t"), "pose_id", F.explode(F.array(*(b("t") + k for k in (-1, 0, 1)))).alias("bucket"))
    packed = spread.groupBy("bucket").agg(F.collect_list(F.struct("pose_t", "pose_id")).alias("near"))
    best = F.array_min(F.transform("near", lambda p: F.struct(F.abs(p["pose_t"] - F.col("t")).alias("away"), p["pose_t"].alias("pose_t"), p["pose_id"].alias("pose_id"))))
    return stream.withColumn("bucket", b("t")).join(packed, "bucket", "left").withColumn("_b", best).select(*stream.columns, F.col("_b.pose_id").alias("pose_id"), (F.col("_b.pose_t") - F.col("t")).alias("dt"))


def windowed_counts(stream: DataFrame, time: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, size)).agg(F.count("*").alias("n"))
