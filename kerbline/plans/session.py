"""Lineage cuts for iterative operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Computes df now; its lineage ends at files in the folder that spark.checkpoint.dir names (unset: one of this machine, for local runs alone)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not own and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(own or f"/tmp/kerbline-checkpoints-{os.getuid()}")
    return df.checkpoint(eager=True)
