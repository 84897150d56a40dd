"""Nearest-reference matching: equality on settings, then the best of what is within tolerance.

Matches are equi-joins on the settings followed by one ``max_by``/``min_by``
aggregate per session: no sort of the candidates, and partial aggregation keeps
the shuffle at one row per session and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def infinity() -> Column:
    return F.lit(float("inf"))


def temperature_bin(value: Column, width: float) -> Column:
    """The centre of the bin; bins truncate towards zero, so the two around zero are one."""
    return ((value / width).cast("int") + 0.5) * width


def wildcard_equal(left: Column, right: Column) -> Column:
    """Equal, or either side unknown."""
    return (left == right) | left.isNull() | right.isNull()


def best(sessions: DataFrame, masters: DataFrame, session_key: str, on: Column, rank: Sequence[Column], payload: Sequence[str], how: str = "left") -> DataFrame:
    """For each session the master with the smallest ``rank`` among those that ``on`` admits, as struct ``best``."""
    pairs = sessions.join(masters, on, "inner")
    found = pairs.groupBy(session_key).agg(F.min_by(F.struct(*payload), F.struct(*rank)).alias("best"))
    return sessions.join(found, session_key, how)


def deepest(masters: DataFrame, settings: Sequence[str], depth: str, master_id: str) -> DataFrame:
    """One master for each combination of settings: the deepest, then the smallest id."""
    row = F.struct(*masters.columns)
    best = masters.groupBy(*settings).agg(F.min_by(row, F.struct(-F.col(depth), F.col(master_id))).alias("m"))
    return best.select("m.*")


def nearest_by_temperature(sessions: DataFrame, masters: DataFrame, session_key: str, on: Column, session_t: str, master_t: str, depth: str, master_id: str, settings: Sequence[str], tolerance: float = 5.0, bin_width: float = 2.0, fallback: bool = False) -> DataFrame:
    """Nearest bin of temperature difference, then the deepest stack, then the smallest id, as struct ``best``.

    ``settings`` name the masters' columns that ``on`` compares: masters alike in
    them and in temperature are reduced to the deepest before the join.  Within
    the tolerance the join is also keyed by temperature cells as wide as it, so a
    session meets near masters only.  With ``fallback`` the nearest outside is
    taken where nothing is inside; an unknown temperature is infinitely far.
    """
    st, mt = F.col(session_t), F.col(master_t)
    masters = deepest(masters, [*settings, master_t], depth, master_id)
    delta = F.coalesce(F.abs(st - mt), infinity())
    outside = ~(delta <= tolerance)
    step = F.when(delta < infinity(), F.floor(delta / bin_width).cast("double")).otherwise(infinity())
    left = sessions
    if not fallback:
        cell = lambda t: F.floor(t / tolerance).cast("long")
        left = sessions.withColumn("_cell", cell(st))
        masters = masters.withColumn("_m_cell", F.explode(F.sequence(cell(mt) - 1, cell(mt) + 1)))
        on = on & (F.col("_cell") == F.col("_m_cell")) & ~outside
    rank = [outside.alias("out"), step.alias("step"), (-F.col(depth)).alias("depth"), F.col(master_id).alias("id")]
    payload = F.struct(F.col(master_id).alias("id"), delta.alias("delta"), outside.alias("fallback"))
    found = left.join(masters, on).groupBy(session_key).agg(F.min_by(payload, F.struct(*rank)).alias("best"))
    return sessions.join(found, session_key, "left")
