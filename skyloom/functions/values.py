"""Maps, arrays, photometry and other values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_maps(base: Column, patch: Column) -> Column:
    """The patch's values win; keys that the patch maps to null go."""
    return F.map_filter(over(base, patch), lambda k, v: v.isNotNull())


def over(base: Column, layer: Column) -> Column:
    """The layer's values win key by key."""
    return F.map_zip_with(base, layer, lambda k, a, b: F.when(F.array_contains(F.map_keys(layer), k), b).otherwise(a))


def layered(*layers: Column) -> Column:
    """Later layers win key by key."""
    out = layers[0]
    for layer in layers[1:]:
        out = over(out, layer)
    return out


def tail(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - (n - 1)), n)


def noise_drop(total: Column, more: Column) -> Column:
    """How much of the noise more exposure removes."""
    return 1 - F.sqrt(total / (total + more))


def advice(total_s: Column) -> Column:
    """Options of 1, 2, 4 and 8 more hours."""
    return F.transform(F.array(*(F.lit(float(h)) for h in (1, 2, 4, 8))), lambda h: F.struct(h.alias("hours"), noise_drop(total_s, h * 3600).alias("noise_drop")))


def mtf(x: Column, m: Column) -> Column:
    """Midtones transfer: 0, m and 1 go to 0, 1/2 and 1."""
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise((m - 1) * x / ((2 * m - 1) * x - m))


def midtones_for(x: Column, y: Column) -> Column:
    """The midtones balance that takes x to y."""
    return x * (y - 1) / (2 * x * y - y - x)
