"""Image kernels: images as rows with a pixel array, or as a table of pixels.

Per-image statistics stay inside one row with higher-order functions, so they
never shuffle pixels; reducers across images group pixel rows, which combine
before the shuffle; kernels with no column form are Arrow-batched numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_pixels(images: DataFrame, key: str, px: str, width: int) -> DataFrame:
    """``key, y, x, v`` of every pixel."""
    rows = images.select(key, F.posexplode(px).alias("_i", "_v"))
    return rows.select(key, F.expr(f"cast(_i div {width} as int)").alias("y"), F.expr(f"cast(_i % {width} as int)").alias("x"), F.col("_v").cast("double").alias("v"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A column that a lambda reads may be inlined into it by the optimizer and
    then be computed for every element; a lambda's argument is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def quantile(a: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""

    def between(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(q)
        lo = F.floor(at).cast("int")
        x, y = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(s) - 1))
        return x + (y - x) * (at - lo)

    return let(F.array_sort(a), between)


def std_of(a: Column) -> Column:
    """Population standard deviation."""
    return let(a, lambda b: let(mean_of(b), lambda m: F.sqrt(mean_of(F.transform(b, lambda v: (v - m) * (v - m))))))


def mad_of(a: Column) -> Column:
    return let(a, lambda b: let(quantile(b, 0.5), lambda m: quantile(F.transform(b, lambda v: F.abs(v - m)), 0.5)))


def near_median(a: Column, sigma: float) -> Column:
    """The values within ``sigma`` standard deviations of the median (all, if there is no spread)."""
    limits = lambda b: F.struct(quantile(b, 0.5).alias("m"), std_of(b).alias("s"))
    return let(a, lambda b: let(limits(b), lambda x: F.filter(b, lambda v: (x["s"] <= 0) | (F.abs(v - x["m"]) <= sigma * x["s"]))))


def stack(pixels: DataFrame, keys: list[str], method: str = "mean") -> DataFrame:
    """Reduce a sequence's pixel rows by place: mean, median, min, max or sum."""
    how = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum}[method]
    return pixels.groupBy(*keys, "y", "x").agg(how("v").alias("v"))


def stack_sigma_clip(pixels: DataFrame, keys: list[str], sigma: float = 3.0, rounds: int = 2) -> DataFrame:
    """Mean without outliers; a place's values are one array, as long as the sequence has frames."""
    a = pixels.groupBy(*keys, "y", "x").agg(F.array_sort(F.collect_list("v")).alias("a"))
    for _ in range(rounds):
        a = a.withColumn("a", near_median(F.col("a"), sigma))
    return a.select(*keys, "y", "x", mean_of(F.col("a")).alias("v"))


def laplacian(px: Column, height: int, width: int) -> Column:
    """The 3x3 cross Laplacian of the inner pixels."""
    inner = F.array(*(F.lit(y * width + x) for y in range(1, height - 1) for x in range(1, width - 1)))
    at = lambda i: F.get(px, i)
    return F.transform(inner, lambda i: (at(i - 1) + at(i + 1) + at(i - width) + at(i + width) - 4 * at(i)).cast("double"))


def neighbour_differences(px: Column, height: int, width: int) -> Column:
    inner = F.array(*(F.lit(y * width + x) for y in range(height) for x in range(width - 1)))
    return F.transform(inner, lambda i: (F.get(px, i + 1) - F.get(px, i)).cast("double"))


def blocks(px: Column, height: int, width: int, size: int, of) -> Column:
    """``of`` over each size x size block, row by row."""
    parts = [F.array(*(F.get(px, F.lit(y * width + x)).cast("double") for y in range(by, by + size) for x in range(bx, bx + size))) for by in range(0, height - size + 1, size) for bx in range(0, width - size + 1, size)]
    return F.array(*(of(p) for p in parts))


def box_max(a: np.ndarray, r: int) -> np.ndarray:
    """The largest value within r in both directions."""
    out = np.pad(a, r, constant_values=-np.inf)
    out = np.lib.stride_tricks.sliding_window_view(out, 2 * r + 1, axis=0).max(-1)
    return np.lib.stride_tricks.sliding_window_view(out, 2 * r + 1, axis=1).max(-1)


def box_mean(a: np.ndarray, k: int) -> np.ndarray:
    """The mean of each k x k box that lies inside, by two-dimensional running sums."""
    s = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def local_maxima(images: DataFrame, key: str, px: str, width: int, radius: int, sigma: float) -> DataFrame:
    """``key, y, x, v`` of pixels that are the largest within ``radius`` and ``sigma`` deviations over the median."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ys, xs, vs = [], [], [], []
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not p:
                    continue
                a = np.asarray(p, np.float64).reshape(-1, width)
                hit = (a == box_max(a, radius)) & (a > np.median(a) + sigma * a.std())
                for y, x in zip(*np.nonzero(hit), strict=True):
                    keys.append(k)
                    ys.append(int(y))
                    xs.append(int(x))
                    vs.append(float(a[y, x]))
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "y": pa.array(ys, pa.int32()), "x": pa.array(xs, pa.int32()), "v": pa.array(vs, pa.float64())})

    return images.select(F.col(key).cast("long"), F.col(px).cast("array<double>")).mapInArrow(run, "key long, y int, x int, v double")


def best_shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The whole-pixel shift of b that lines it up with a, by the peak of the cross-correlation."""
    f = np.fft.fft2(a - a.mean()) * np.conj(np.fft.fft2(b - b.mean()))
    y, x = np.unravel_index(np.argmax(np.fft.ifft2(f).real.round(9)), a.shape)
    return int(y if y <= a.shape[0] // 2 else y - a.shape[0]), int(x if x <= a.shape[1] // 2 else x - a.shape[1])


def align_pairs(pairs: DataFrame, key: str, a: str, b: str, width: int) -> DataFrame:
    """``key, dy, dx`` for two images per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *best_shift(np.asarray(p).reshape(-1, width), np.asarray(q).reshape(-1, width))) for k, p, q in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if p and q]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate((("key", pa.int64()), ("dy", pa.int32()), ("dx", pa.int32())))})

    return pairs.select(F.col(key).cast("long"), F.col(a).cast("array<double>"), F.col(b).cast("array<double>")).mapInArrow(run, "key long, dy int, dx int")


def screen(a: Column, b: Column) -> Column:
    return 1 - (1 - a) * (1 - b)


def recombine(starless: Column, stars: Column, mode: str = "screen", amount: float = 1.0) -> Column:
    """Stars over a starless image; an amount under 1 shrinks them."""
    s = F.pow(stars, F.lit(1 / amount)) if amount != 1 else stars
    return {"add": F.least(F.lit(1.0), starless + s), "screen": screen(starless, s), "max": F.greatest(starless, s)}[mode]


def scnr(r: Column, g: Column, b: Column, amount: float = 1.0) -> Column:
    """Average-neutral green reduction."""
    return g + amount * (F.least(g, (r + b) / 2) - g)


def normalize_to(x: Column, med_x: Column, mad_x: Column, med_to: Column, mad_to: Column) -> Column:
    """Match a channel's median and spread to another's."""
    return x * mad_to / mad_x - mad_to / mad_x * med_x + med_to
