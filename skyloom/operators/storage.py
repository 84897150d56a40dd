"""Cache lineage and budgets: who reaches an entry, what to evict, what a copy costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def owners(entries: DataFrame, uses: DataFrame, entry: str, owner: str, at: str | None = None) -> DataFrame:
    """Every entry with the number of its owners, its only owner (null if shared) and, with ``at``, the time ``used`` last."""
    # the least and the greatest owner are equal if there is one; the count is of distinct ones
    n = uses.groupBy(entry).agg(F.count_distinct(owner).alias("owners"), F.when(F.min(owner) == F.max(owner), F.min(owner)).alias("sole_owner"), *([F.max(at).alias("used")] if at else []))
    return entries.join(n, entry, "left").withColumn("owners", F.coalesce("owners", F.lit(0).cast("long")))


#: Entries that a task sorts.
BUCKET_ROWS = 1 << 20


def evict(entries: DataFrame, order: Sequence[Column], size: str, excess: Column, keep: Sequence[str], rows: int) -> DataFrame:
    """The entries to evict (their ``keep``), in order, until ``excess`` bytes are free (the one that crosses is included).

    ``rows`` is the number of entries, of which the number of buckets follows.

    The running sum is taken in two steps: entries are ranged into buckets by
    the order, whose few totals are accumulated, and then within each bucket, so
    no task orders all entries.
    """
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    # cut, as the bucket is a property of this one execution
    few = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    ranged = cut(entries.select(*dict.fromkeys([*keep, size]), excess.alias("_excess"), rank.alias("_rank")).repartitionByRange(few, "_rank").withColumn("_bucket", F.spark_partition_id()))
    total = ranged.groupBy("_bucket").agg(F.sum(size).alias("_sum"))
    w = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select("_bucket", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))  # one row per bucket
    inner = Window.partitionBy("_bucket").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    x = ranged.withColumn("_inner", F.coalesce(F.sum(size).over(inner), F.lit(0))).join(before, "_bucket")
    freed = F.col("_base") + F.col("_inner")
    return x.withColumn("freed_before", freed).filter(freed < F.col("_excess")).select(*keep, "freed_before")
