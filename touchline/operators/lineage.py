"""Cutting a plan's lineage at a table in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df``, computed and kept in ``spark.checkpoint.dir``, so that a lost executor costs no earlier work. A local session
    without that setting (a test) gets a temporary folder; a cluster must name one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="touchline-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
