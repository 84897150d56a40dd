"""The folder that driver and executors share, for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session that has none, as in tests, gets a folder of its own.

    A checkpoint's files go when nothing refers to it any more, unless the session says otherwise.
    """
    sc = spark.sparkContext
    conf = sc._jsc.sc().conf()
    if not conf.contains(_CLEAN):
        conf.set(_CLEAN, "true")
    have = sc._jsc.sc().getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir") or (have.get() if have.isDefined() else None)
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="skyloom-")
    if not have.isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
