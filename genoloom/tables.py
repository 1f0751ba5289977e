"""Cuts of lineage that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that the session names in ``spark.checkpoint.dir``; in a folder of
    our own only where it names none, as in tests."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="genoloom-"))
    return df.checkpoint(eager=True)
