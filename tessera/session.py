"""Session settings the library is written for."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName("tessera").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def importable(df: DataFrame) -> DataFrame:
    """df, with Python workers told where this package lies, wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[1])
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return df
