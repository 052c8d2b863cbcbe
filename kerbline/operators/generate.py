"""Table-valued generators: billboards, poles and sprites as coloured points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def billboards(objects: DataFrame, textures: DataFrame, dark: int = 10) -> DataFrame:
    """object_id, x, y, z, r, g, b: each object's texture (texture, i, j, r, g, b with i, j from 0 to 1) as a plate
    of size ``size`` standing at (x, y, z) and facing ``heading`` (radians); near-black texels are left out."""
    t = textures.where(F.greatest("r", "g", "b") >= dark)
    o = objects.select("object_id", "texture", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), "size", "heading")
    j = o.join(t, "texture")
    side = (F.col("i") - 0.5) * F.col("size")
    return j.select("object_id", (F.col("ox") + side * F.cos("heading")).alias("x"), (F.col("oy") - side * F.sin("heading")).alias("y"), (F.col("oz") + (0.5 - F.col("j")) * F.col("size")).alias("z"), "r", "g", "b")


def stems(objects: DataFrame, steps: int = 60, ring: int = 5, radius: float = 0.04, grey: int = 128) -> DataFrame:
    """The pole below each object, from ``ground_z`` to z: ``steps`` layers of a centre and a ring of points."""
    k = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    s = objects.select("object_id", "x", "y", "z", "ground_z", k.alias("k")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(ring - 1))))
    off = F.when(F.col("a") == 0, 0.0).otherwise(radius)
    turn = F.col("a") * F.lit(2 * 3.141592653589793 / max(1, ring - 1))
    z = F.col("ground_z") + (F.col("z") - F.col("ground_z")) * F.col("k") / (steps - 1)
    return s.select("object_id", (F.col("x") + off * F.cos(turn)).alias("x"), (F.col("y") + off * F.sin(turn)).alias("y"), z.alias("z"), *(F.lit(grey).alias(c) for c in "rgb"))


def sprites(objects: DataFrame, textures: DataFrame) -> DataFrame:
    return billboards(objects, textures).unionByName(stems(objects))
