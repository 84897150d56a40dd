"""Changes of tables as rewrites: upserts, conditional upserts, cascades, merges.

Each returns the new table.  A writer replaces the old files or, where a table
format offers MERGE, expresses the same join there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; the others stay."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_unless(old: DataFrame, new: DataFrame, keys: Sequence[str], locked: str) -> DataFrame:
    """As :func:`upsert`, but rows of ``old`` whose ``locked`` flag is set stay as they are."""
    held = old.filter(F.coalesce(F.col(locked), F.lit(False)))
    return upsert(old, new.join(held.select(*keys), list(keys), "left_anti"), keys)


def refresh_keeping(old: DataFrame, new: DataFrame, keys: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Refresh rows by key, keeping the user's values of the ``kept`` columns where they are set."""
    o = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in kept))
    joined = new.join(o, list(keys), "left")
    return joined.select(*(F.coalesce(f"_old_{c}", c).alias(c) if c in kept else F.col(c) for c in new.columns))


def cascade(parents: DataFrame, links: DataFrame, gone: DataFrame, parent: str) -> tuple[DataFrame, DataFrame]:
    """Parents and links without the ``gone`` parents."""
    ids = gone.select(parent).distinct()
    return parents.join(ids, parent, "left_anti"), links.join(ids, parent, "left_anti")


def orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents that no child names."""
    return parents.join(children.select(key).distinct(), key, "left_anti")


def elect(df: DataFrame, group: str, rank: Sequence[Column], member: str) -> DataFrame:
    """Each group's member with the greatest rank, and every member with its keeper."""
    best = df.groupBy(group).agg(F.max_by(member, F.struct(*rank)).alias("keeper"))
    return df.join(best, group)


def upsert_changed(old: DataFrame, new: DataFrame, keys: Sequence[str], same: Sequence[str]) -> DataFrame:
    """As :func:`upsert`, but a row whose ``same`` columns (nulls equal) did not change stays as it is."""
    o = old.select(*(F.col(c).alias(f"_k_{c}") for c in keys), *(F.col(c).alias(f"_o_{c}") for c in same))
    cond = [F.col(c) == F.col(f"_k_{c}") for c in keys] + [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in same]
    both = cond[0]
    for c in cond[1:]:
        both = both & c
    return upsert(old, new.join(o, both, "left_anti"), keys)


def reassign(sessions: DataFrame, targets: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions moved to targets by name: those that exist are reused, others made, and targets left empty go.

    ``sessions`` has ``session, target``; ``targets`` ``target, name``; ``moves``
    ``session, name``.  New targets are numbered after the greatest, by name.
    """
    had = sessions.select("target").distinct()
    lacking = moves.select("name").distinct().join(targets, "name", "left_anti")
    top = targets.agg(F.coalesce(F.max("target"), F.lit(0)).alias("top"))  # one row
    w = Window.orderBy("name")  # names that a request makes
    made = lacking.crossJoin(F.broadcast(top)).select((F.col("top") + F.row_number().over(w)).alias("target"), "name")
    every = targets.select("target", "name").unionByName(made)
    to = moves.join(every, "name").select("session", F.col("target").alias("_to"))
    moved = sessions.join(to, "session", "left").select("session", F.coalesce("_to", "target").alias("target"))
    empty = had.join(moved.select("target").distinct(), "target", "left_anti")
    return moved, every.join(empty, "target", "left_anti")


def merge_keys(rows: DataFrame, keepers: DataFrame, key: str, member: str) -> DataFrame:
    """Rows whose key is ``<member>|<rest>`` under their keeper's name, those that collide dropped.

    ``keepers`` has ``member`` and ``keeper``.  Of rows that come to one key the
    keeper's own stays, else that of the smallest member.
    """
    k = keepers.select(F.col(member).alias("_m"), F.col("keeper").alias("_k"))
    moved = rows.join(k, F.col(member) == F.col("_m"), "left").withColumn("_to", F.coalesce("_k", member))
    moved = moved.withColumn("_new", F.concat_ws("|", F.col("_to").cast("string"), F.substring(key, F.instr(F.col(key), "|") + 1, F.length(key))))
    best = F.min_by(F.struct(*rows.columns, "_to"), F.struct(F.col(member) != F.col("_to"), F.col(member)))
    kept = moved.groupBy("_new").agg(best.alias("_r"))
    return kept.select(*(F.col("_new").alias(c) if c == key else F.col("_r._to").alias(c) if c == member else F.col(f"_r.{c}").alias(c) for c in rows.columns))
