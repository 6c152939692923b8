"""Parquet tables of an input folder."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


BYTES, LEAST = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    if spark.conf.get(BYTES) == "67108864b":
        spark.conf.set(BYTES, LEAST)  # what a worker holds at once; models and texts take many times their files
    return spark.read.parquet(f"{folder}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import this package from where the driver has it. Workers
    elsewhere get it with --py-files or an installed package, as usual."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
