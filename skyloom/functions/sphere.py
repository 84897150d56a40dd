"""Spherical geometry and low-precision astronomy as column expressions (degrees)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance, stable at all angles."""
    d = F.radians(ra2 - ra1)
    a, b = F.radians(dec1), F.radians(dec2)
    y = F.hypot(F.cos(b) * F.sin(d), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return F.degrees(F.atan2(y, F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)))


def cosine_separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Distance by the law of cosines, clamped."""
    a, b = F.radians(dec1), F.radians(dec2)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(ra1 - ra2))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def mean_ra(ra: Column) -> Column:
    """Aggregate: the circular mean in [0, 360)."""
    angle = F.degrees(F.atan2(F.avg(F.sin(F.radians(ra))), F.avg(F.cos(F.radians(ra)))))
    return F.pmod(angle, F.lit(360.0))


def fov_diagonal(focal_mm: Column, pixel_x: Column, pixel_y: Column, width: Column, height: Column) -> Column:
    """Field diagonal from optics; null if a value is missing or not positive (pixels are square if one size is)."""
    y = F.coalesce(F.when(pixel_y > 0, pixel_y), pixel_x)
    ok = (focal_mm > 0) & (pixel_x > 0) & (width > 0) & (height > 0)
    half = lambda pixel, n: 2 * F.degrees(F.atan(n * pixel / 1000 / 2 / focal_mm))
    return F.when(ok, F.hypot(half(pixel_x, width), half(y, height)))


def auto_tolerance(envelope: Column) -> Column:
    return F.when(envelope.isNull(), 1.0).otherwise(F.least(F.lit(3.0), F.greatest(F.lit(0.3), envelope)))


def suggest_tolerance(envelope: Column) -> Column:
    return F.when(envelope.isNull(), 2.0).otherwise(F.least(F.lit(5.0), F.greatest(F.lit(0.5), 1.5 * envelope)))


def sexagesimal(text: Column, per_unit: float) -> Column:
    """``a:b:c`` in degrees (``per_unit`` 15 for hours); a minus holds even for -00; malformed: null."""
    parts = F.split(F.trim(text), ":")
    num = [F.get(parts, F.lit(i)).try_cast("double") for i in range(3)]
    value = (F.abs(num[0]) + num[1] / 60 + num[2] / 3600) * per_unit
    return F.when(F.size(parts) == 3, F.when(F.startswith(F.trim(text), F.lit("-")), -value).otherwise(value))


def cell_key(alt: Column, az: Column, size: int = 5) -> Column:
    low = lambda x: (F.floor(x / size) * size).cast("long")
    return F.concat(low(alt).cast("string"), F.lit("/"), F.pmod(low(F.pmod(az, F.lit(360.0))), F.lit(360)).cast("string"))


def sidereal(at_us: Column, longitude: Column) -> Column:
    """Local sidereal angle from UT microseconds since 1970."""
    days = at_us / F.lit(86_400e6) - F.lit(10_957.5)  # since J2000.0
    return F.pmod(F.lit(280.46061837) + F.lit(360.98564736629) * days + longitude, F.lit(360.0))


def altitude(ra: Column, dec: Column, lat: Column, lst: Column) -> Column:
    h = F.radians(lst - ra)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(F.radians(lat)) * F.sin(F.radians(dec)) + F.cos(F.radians(lat)) * F.cos(F.radians(dec)) * F.cos(h)))))


def azimuth(ra: Column, dec: Column, lat: Column, lst: Column) -> Column:
    """From north through east, in [0, 360)."""
    h, d, p = F.radians(lst - ra), F.radians(dec), F.radians(lat)
    return F.pmod(F.degrees(F.atan2(-F.cos(d) * F.sin(h), F.sin(d) * F.cos(p) - F.cos(d) * F.sin(p) * F.cos(h))), F.lit(360.0))


def interleave(x: Column, y: Column, bits: int) -> Column:
    """Morton code: the bits of x in even places, those of y in odd ones."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(1).cast("long"), 2 * i)).bitwiseOR(F.shiftleft(F.shiftright(y, i).bitwiseAND(1).cast("long"), 2 * i + 1))
    return out


def healpix(ra: Column, dec: Column, order: int) -> Column:
    """The nested HEALPix index of a position at ``2**order`` pixels a side: equal areas, so also a fair join bucket."""
    n = 1 << order
    z, quarter = F.sin(F.radians(dec)), F.pmod(ra, F.lit(360.0)) / 90.0
    whole = lambda c: F.floor(c).cast("long")
    # the equatorial belt: ascending and descending edge lines
    up, down = n * (0.5 + quarter) - n * z * 0.75, n * (0.5 + quarter) + n * z * 0.75
    p, m = whole(up), whole(down)
    fp, fm = whole(p / n), whole(m / n)
    belt = F.when(fp == fm, fp % 4 + 4).when(fp < fm, fp).otherwise(fm + 8)
    bx, by = F.pmod(m, F.lit(n)), n - 1 - F.pmod(p, F.lit(n))
    # the polar caps
    cap = F.least(F.lit(3).cast("long"), whole(quarter))
    rest, size = quarter - cap, n * F.sqrt(3 * (1 - F.abs(z)))
    jp, jm = F.least(F.lit(n - 1).cast("long"), whole(rest * size)), F.least(F.lit(n - 1).cast("long"), whole((1 - rest) * size))
    north = z >= 0
    polar = F.abs(z) > 2 / 3
    face = F.when(polar, F.when(north, cap).otherwise(cap + 8)).otherwise(belt)
    x = F.when(polar, F.when(north, n - jm - 1).otherwise(jp)).otherwise(bx)
    y = F.when(polar, F.when(north, n - jp - 1).otherwise(jm)).otherwise(by)
    return face * n * n + interleave(x, y, max(1, order))


def tangent_plane(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """Standard coordinates (degrees, east and north) about a centre; null on the far side."""
    d, a, b = F.radians(ra - ra0), F.radians(dec), F.radians(dec0)
    cos_c = F.sin(b) * F.sin(a) + F.cos(b) * F.cos(a) * F.cos(d)
    x, y = F.cos(a) * F.sin(d) / cos_c, (F.cos(b) * F.sin(a) - F.sin(b) * F.cos(a) * F.cos(d)) / cos_c
    return F.when(cos_c > 0, F.degrees(x)), F.when(cos_c > 0, F.degrees(y))


def from_tangent_plane(x: Column, y: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """The position of standard coordinates."""
    x, y, b = F.radians(x), F.radians(y), F.radians(dec0)
    low = F.cos(b) - y * F.sin(b)
    ra = F.pmod(ra0 + F.degrees(F.atan2(x, low)), F.lit(360.0))
    return ra, F.degrees(F.atan2(F.sin(b) + y * F.cos(b), F.hypot(x, low)))


def sun(at_us: Column) -> tuple[Column, Column]:
    """The sun's right ascension and declination, good to about a hundredth of a degree."""
    days = at_us / F.lit(86_400e6) - F.lit(10_957.5)
    anomaly = F.radians(F.pmod(F.lit(357.529) + F.lit(0.98560028) * days, F.lit(360.0)))
    longitude = F.radians(F.pmod(F.lit(280.459) + F.lit(0.98564736) * days + 1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly), F.lit(360.0)))
    tilt = F.radians(F.lit(23.439) - F.lit(0.00000036) * days)
    return F.pmod(F.degrees(F.atan2(F.cos(tilt) * F.sin(longitude), F.cos(longitude))), F.lit(360.0)), F.degrees(F.asin(F.sin(tilt) * F.sin(longitude)))


def sun_altitude(at_us: Column, lat: Column, lon: Column) -> Column:
    ra, dec = sun(at_us)
    return altitude(ra, dec, lat, sidereal(at_us, lon))


def tile_path(order: int, pixel: Column) -> Column:
    """Where a sky survey keeps the tile of a HEALPix pixel."""
    return F.format_string(f"Norder{order}/Dir%d/Npix%d.jpg", (F.floor(pixel / 10_000) * 10_000).cast("long"), pixel.cast("long"))


def wrapped(angle: Column) -> Column:
    """An angle in [0, 360), a full turn but for rounding being none."""
    a = F.pmod(angle, F.lit(360.0))
    return F.when(F.abs(a - 360) < 1e-9, 0.0).otherwise(a)


def canvas_box(height: Column, cx: Column, cy: Column, width: Column, box_height: Column, turn: Column) -> Column:
    """A box as it is drawn (lines downwards, degrees clockwise) on the canvas (lines upwards, radians anticlockwise)."""
    return F.struct(cx.alias("cx"), (height - cy).alias("cr"), width.alias("width"), box_height.alias("height"), (-F.radians(turn)).alias("theta"))


def display_box(height: Column, box: Column) -> Column:
    """A canvas box as it is drawn."""
    return F.struct(box["cx"].alias("cx"), (height - box["cr"]).alias("cy"), box["width"].alias("width"), box["height"].alias("height"), wrapped(F.degrees(-box["theta"])).alias("angle"))


def canvas_of_sky(ra: Column, dec: Column, ra0: Column, dec0: Column, degrees_per_pixel: Column, turn: Column, cx: Column, cr: Column) -> tuple[Column, Column]:
    """Where a position lies on a canvas: the tangent plane about its centre, turned and scaled (east to the left at turn 0)."""
    x, y = tangent_plane(ra, dec, ra0, dec0)
    t = F.radians(turn)
    return cx + (-x * F.cos(t) + y * F.sin(t)) / degrees_per_pixel, cr + (x * F.sin(t) + y * F.cos(t)) / degrees_per_pixel
