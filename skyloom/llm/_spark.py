"""Session helpers of the operators: shared scratch space and sizing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut as materialize
from ..sources.scratch import fresh_path as scratch_path

__all__ = ["connected_components", "drop_path", "materialize", "partitions", "scratch_path", "summed_table", "table_rows"]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def summed_table(parts: DataFrame, block: int) -> np.ndarray:
    """The sum of per-task tables that arrive as rows ``block int, sums binary`` of float64.

    The tables have one fixed size; rows of a block are summed as they stream
    in, so a task holds one copy of its blocks, and the driver gets one table.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x)
                sums[k] = sums[k] + x if k in sums else x
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "sums": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    rows = parts.repartition(min(block, partitions(parts.sparkSession)), "block").mapInArrow(add, "block int, sums binary").collect()
    return np.concatenate([np.frombuffer(bytes(x)) for _, x in sorted(rows)]) if rows else np.empty(0)


def table_rows(table: np.ndarray, blocks: int) -> pa.RecordBatch:
    """One task's table as rows for :func:`summed_table`."""
    cut = np.array_split(table.astype(np.float64), blocks)
    return pa.RecordBatch.from_pydict({"block": pa.array(range(blocks), pa.int32()), "sums": pa.array([x.tobytes() for x in cut], pa.binary())})


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) for rows ``a, b``: alternating large and small stars.

    Each star is a partial aggregate and a join; lineage is cut by a checkpoint
    in the shared folder every round, and the number of rounds is logarithmic.
    """
    a, b = F.col("a"), F.col("b")
    now = materialize(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = mark
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).filter(a != b).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        now = materialize(large.join(small, "a").select(b.alias("a"), F.col("m").alias("b")).filter(a != b).unionByName(small.select("a", F.col("m").alias("b"))).distinct())
