"""Radius joins and nearest neighbours on the sphere.

Both sides are keyed by grid cells a tolerance wide: declination bands, cut in
right ascension by the band's width there.  One side is copied to the cells that
its circle can touch, so the join is an equi-join of cells followed by the exact
distance; no nested loop whatever the sizes.  Bands touching a pole are one cell.

``first_within`` looks for a few neighbours only, in cells as fine as the right
side is dense: level ``l`` has cells for circles of ``tolerance / 2**l``.  A left
row starts at the deepest level whose cell about it holds enough right rows.  If
its circle there holds too few, it looks again two levels up: any two points of a
cell are nearer than 3.6 of its own radii, so that circle, four times as wide,
has the cell's rows.

No side is broadcast: Spark's estimates of a size leave out what ``explode``
adds, so a side that is copied to cells and levels would pass for a small one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sphere import separation
from ..sources.scratch import cut

#: Levels below the tolerance that are tried where the right side is dense enough.
DEEPEST = 16


def _band(dec: Column, tol: Column) -> Column:
    return F.floor((dec + 90.0) / tol).cast("long")


def _cells_in(band: Column, tol: Column) -> Column:
    """How many cells a band has: each is at least ``tol`` wide along the band's narrow edge."""
    low, high = band * tol - 90.0, (band + 1) * tol - 90.0
    edge = F.least(F.cos(F.radians(F.greatest(F.lit(-90.0), low))), F.cos(F.radians(F.least(F.lit(90.0), high))))
    return F.greatest(F.lit(1).cast("long"), F.floor(F.greatest(edge, F.lit(0.0)) * (F.lit(360.0) / tol) / 1.6).cast("long"))


def _cell(ra: Column, n: Column) -> Column:
    return F.least(n - 1, F.floor(F.pmod(ra, F.lit(360.0)) / 360.0 * n).cast("long"))


def shuffled(x: DataFrame) -> DataFrame:
    """``x`` as a side of a join that is sorted and merged, whatever its estimated size."""
    return x.hint("merge")


def _in_cells(x: DataFrame, pos: tuple[str, str], tol: Column) -> DataFrame:
    return x.withColumn("_b", _band(F.col(pos[1]), tol)).withColumn("_c", _cell(F.col(pos[0]), _cells_in(F.col("_b"), tol)))


def _copied(x: DataFrame, pos: tuple[str, str], tol: Column) -> DataFrame:
    """A copy for each cell that the circle about a row can touch."""
    ra, dec = F.col(pos[0]), F.col(pos[1])
    y = x.withColumn("_b", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: _band(dec, tol) + d))).filter((F.col("_b") >= 0) & (F.col("_b") <= F.floor(F.lit(180.0) / tol)))
    y = y.withColumn("_n", _cells_in(F.col("_b"), tol))
    return y.withColumn("_c", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.pmod(_cell(ra, F.col("_n")) + d, F.col("_n")))))).drop("_n")


def _pairs(x: DataFrame, y: DataFrame, cells: Sequence[str], left_pos: tuple[str, str], right_pos: tuple[str, str], tol: Column) -> DataFrame:
    """Pairs of common cells within ``tol``, with their ``separation``; chords, which need no trigonometry, rule most out."""

    def vector(ra: Column, dec: Column) -> Column:
        a, d = F.radians(ra), F.radians(dec)
        return F.struct((F.cos(d) * F.cos(a)).alias("x"), (F.cos(d) * F.sin(a)).alias("y"), F.sin(d).alias("z"))

    u, v = F.col("_u"), F.col("_v")
    far = lambda c: (u[c] - v[c]) * (u[c] - v[c])
    near = far("x") + far("y") + far("z") <= F.col("_far")
    x = x.withColumn("_u", vector(*map(F.col, left_pos))).withColumn("_far", F.pow(F.radians(tol) + 1e-12, F.lit(2.0)))
    pairs = x.join(shuffled(y.withColumn("_v", vector(*map(F.col, right_pos)))), cells).filter(near)
    return pairs.withColumn("separation", separation(*map(F.col, (*left_pos, *right_pos)))).filter(F.col("separation") <= tol).drop("_u", "_v", "_far")


def radius_join(left: DataFrame, right: DataFrame, left_pos: tuple[str, str], right_pos: tuple[str, str], tolerance: float) -> DataFrame:
    """Pairs within ``tolerance`` degrees with their ``separation``; ``right`` (the smaller side) is copied to neighbouring cells."""
    tol = F.lit(float(tolerance))
    return _pairs(_in_cells(left, left_pos, tol), _copied(right, right_pos, tol), ["_b", "_c"], left_pos, right_pos, tol).drop("_b", "_c")


def first_within(left: DataFrame, right: DataFrame, left_key: str, left_pos: tuple[str, str], right_pos: tuple[str, str], tolerance: float, k: int, order: Sequence[Column | str], slack: float = 0.0) -> DataFrame:
    """The first ``k`` pairs of each ``left_key`` by ``order`` within ``tolerance`` degrees, with ``separation`` and their place ``r``.

    ``order`` must put a pair before every other that is more than ``slack``
    degrees farther.  Rows of equal keys share their ``k`` places.
    """
    own, cell = [left_key, *left_pos], ["_l", "_b", "_c"]
    tol = F.lit(float(tolerance)) / F.pow(F.lit(2.0), F.col("_l"))
    at_levels = lambda x, levels: x.withColumn("_l", F.explode(F.array(*map(F.lit, levels))))
    left, few = left.select(*own), k + 3
    fine = [n for n in range(1, DEEPEST + 1) if slack <= 0.25 * tolerance / 2**n]
    if fine:
        counts = _in_cells(at_levels(right.select(*right_pos), fine), right_pos, tol).groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
        dense = cut(counts.filter(F.col("_n") >= few).drop("_n"))
        fine = sorted(r[0] for r in dense.select("_l").distinct().collect())
    x = left.withColumn("_l", F.lit(0))
    if fine:
        found = _in_cells(at_levels(left, fine), left_pos, tol).join(shuffled(dense), cell, "left_semi").groupBy(*own).agg(F.max("_l").alias("_l"))
        x = left.join(shuffled(found), own, "left").withColumn("_l", F.coalesce("_l", F.lit(0)))

    def firsts(x: DataFrame, levels: Sequence[int]) -> DataFrame:
        """Within the circles of the rows' levels; a row's pairs stay in the task of its cell."""
        pairs = _pairs(_in_cells(x, left_pos, tol), _copied(at_levels(right, levels), right_pos, tol), cell, left_pos, right_pos, tol)
        return pairs.withColumn("r", F.row_number().over(Window.partitionBy(*cell, *own).orderBy(*order))).filter(F.col("r") <= k)

    out = firsts(x, [0, *fine])
    if fine:
        w = Window.partitionBy(*cell, *own)
        enough = (F.col("_l") == 0) | ((F.count(F.lit(1)).over(w) == k) & (F.max("separation").over(w) <= tol - slack))
        out = cut(out.withColumn("_done", enough).drop("_b", "_c")).filter("_done").drop("_done")
        rest = x.filter("_l > 0").join(shuffled(out.filter("r = 1").select(*own)), own, "left_anti").withColumn("_l", F.greatest(F.col("_l") - 2, F.lit(0)))
        out = out.drop("_l").unionByName(firsts(rest, sorted({max(0, n - 2) for n in fine})).drop(*cell))
    else:
        out = out.drop(*cell)
    return out.withColumn("r", F.row_number().over(Window.partitionBy(left_key).orderBy(*order))).filter(F.col("r") <= k)


def nearest(left: DataFrame, right: DataFrame, left_key: str, left_pos: tuple[str, str], right_pos: tuple[str, str], right_id: str, tolerance: float) -> DataFrame:
    """Every left row with its nearest right row within the tolerance (ties: the smaller id), or nulls."""
    best = first_within(left, right, left_key, left_pos, right_pos, tolerance, 1, ["separation", right_id])
    return left.join(shuffled(best.select(left_key, F.col(right_id).alias("nearest"), "separation")), left_key, "left")
