"""Ordered-event operators: gap sessions, nights, streaks, stalls, rates, running values.

All are window expressions over one partitioning (the key), so several of them on
the same key share a shuffle and a sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def ordered(keys: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def number_gaps(df: DataFrame, keys: Sequence[str], at: str, tie: str, gap: int, name: str = "session_no") -> DataFrame:
    """Number each key's runs of rows whose neighbours are at most ``gap`` apart.

    ``at`` is a long (null: unparsable).  A row starts a run if it is the first,
    if more than ``gap`` passed (an equal gap does not cut), or if either
    neighbour's time is null.  Nulls come last.
    """
    w = ordered(keys, [F.col(at).asc_nulls_last(), tie])
    before = F.lag(at).over(w)
    new = F.when(F.row_number().over(w) == 1, 1).when(F.col(at).isNull() | before.isNull(), 1).otherwise((F.col(at) - before > gap).cast("int"))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def session_summary(df: DataFrame, keys: Sequence[str], at: str, failed: Column, exposure: Column) -> DataFrame:
    """Frames, failed and usable ones, bounds, and integration (null when nothing is usable)."""
    n, bad = F.count(F.lit(1)), F.count_if(failed)
    usable = F.greatest(F.lit(0).cast("long"), n - bad)
    return df.groupBy(*keys).agg(
        n.alias("frame_count"), bad.alias("failed_count"), usable.alias("usable"), F.min(at).alias("started_at"), F.max(at).alias("ended_at"),
        F.nullif(F.round(F.coalesce(F.sum(F.when(~failed, exposure)), F.lit(0.0)), 6), F.lit(0.0)).alias("integration"),
    )


def night(at_us: Column, longitude: Column | float = 0.0) -> Column:
    """The date of the noon-to-noon night, by the solar time of the longitude."""
    shift = (F.lit(longitude) if isinstance(longitude, float) else longitude) / 15 * 3600e6
    days = F.floor((at_us + shift - 12 * 3600e6) / F.lit(86_400e6)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], bad: Column, reset: Column) -> DataFrame:
    """``streak``: bad rows in a row up to here; a reset row starts over."""
    w = ordered(keys, order)
    run = df.withColumn("_island", F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    w = ordered([*keys, "_island"], order)
    return run.withColumn("streak", F.sum((bad & ~reset).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_island")


def stalled(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, value: Column, limit: int) -> DataFrame:
    """``stalled``: the value has not changed for more than ``limit``."""
    w = ordered(keys, order)
    changed = F.when(F.lag(value).over(w).isNull() | ~value.eqNullSafe(F.lag(value).over(w)), F.col(at))
    run = df.withColumn("_c", changed)
    since = F.last("_c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn("stalled", F.col(at) - since > limit).drop("_c")


def rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, value: str) -> DataFrame:
    """``rate``: change per unit of ``at`` since the previous row, never negative; null for the first."""
    w = ordered(keys, order)
    dt = F.col(at) - F.lag(at).over(w)
    return df.withColumn("rate", F.when(dt > 0, F.greatest(F.lit(0.0), (F.col(value) - F.lag(value).over(w)) / dt)))


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.max(value).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def spread_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """``n`` evenly spread rows of each key (all, if fewer): those ranked ``int(i * count / n)``."""
    w = ordered(keys, order)
    ranked = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    first = F.ceil(F.col("_i") * n / F.col("_n")).cast("long")  # the smallest i whose int(i * count / n) can reach the rank
    keep = (F.col("_n") <= n) | ((first < n) & (F.floor(first * F.col("_n") / n) == F.col("_i")))
    return ranked.filter(keep).drop("_i", "_n")


def collapse_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], superseded: Column) -> DataFrame:
    """Drop rows that are superseded by a following row of the key."""
    return df.withColumn("_next", F.lead(F.lit(1)).over(ordered(keys, order))).filter(~(superseded & F.col("_next").isNotNull())).drop("_next")


def stable_ids(overlaps: DataFrame) -> DataFrame:
    """``cluster, old``: one-to-one, greatest overlap first, for rows ``cluster, old, overlap``.

    The greedy choice in the total order (overlap, smaller old, smaller cluster)
    is found in rounds: a pair that is the best of both its sides is taken, and
    what it touches leaves.  Each round is two aggregates and two anti-joins,
    and takes at least the best pair of every connected group.
    """
    left = cut(overlaps.filter("overlap > 0").groupBy("cluster", "old").agg(F.max("overlap").alias("overlap")))
    taken = None
    while not left.isEmpty():
        rank = F.struct("overlap", -F.col("old"), -F.col("cluster"))
        by_cluster = left.groupBy("cluster").agg(F.max_by("old", rank).alias("old"))
        by_old = left.groupBy("old").agg(F.max_by("cluster", rank).alias("cluster"))
        both = cut(by_cluster.join(by_old, ["cluster", "old"]))
        taken = both if taken is None else taken.unionByName(both)
        left = cut(left.join(both.select("cluster"), "cluster", "left_anti").join(both.select("old"), "old", "left_anti"))
    return overlaps.select("cluster", "old").limit(0) if taken is None else taken.select("cluster", "old")
