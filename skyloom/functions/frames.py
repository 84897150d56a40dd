"""Classification of frames by their headers and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import literal_map

# How capture programs and instruments name themselves, in the order that counts.
SCOPES = (("TELESCOP", "dwarfiii", "dwarf3"), ("ORIGIN", "dwarflab", "dwarf3"), ("CREATOR", "zwo seestar", "seestar"), ("INSTRUME", "seestar", "seestar"), ("CREATOR", "zwo asiair", "asiair"), ("SWCREATE", "n.i.n.a.", "nina"))
#: Image types by what headers call them.
TYPES = {
    "light": "LIGHT", "light frame": "LIGHT", "lights": "LIGHT", "dark": "DARK", "dark frame": "DARK", "darks": "DARK",
    "flat": "FLAT", "flat frame": "FLAT", "flats": "FLAT", "bias": "BIAS", "bias frame": "BIAS", "biases": "BIAS", "offset": "BIAS",
}
#: By-products next to the frames.
BY_PRODUCTS, PICTURES = ("stacked-", "img_"), (".png", ".tif", ".tiff", ".jpg", ".jpeg")


def _card(header: Column, key: str) -> Column:
    return F.lower(F.trim(F.coalesce(header[key], F.lit(""))))


def scope_of(header: Column) -> Column:
    """The first rule whose card begins as it says; null without any."""
    return F.coalesce(*(F.when(F.startswith(_card(header, key), F.lit(start)), F.lit(scope)) for key, start, scope in SCOPES))


def image_type(header: Column, path: Column, scope: Column) -> Column:
    """By the type card, whose unknown values are no frame; without a card, for the scope that writes none, by the folders."""
    said, folders = _card(header, "IMAGETYP"), F.split(F.lower(path), "/")
    place = F.when(F.array_contains(folders, "cali_frame"), F.lit(None)).when(F.array_contains(folders, "dwarf_dark"), "DARK").otherwise("LIGHT")
    return F.when(said != "", F.try_element_at(literal_map(TYPES), said)).when(scope == "dwarf3", place)


def is_derived(header: Column) -> Column:
    """A stack of two or more, or a file of the stacking program; a count that is no number says nothing."""
    return F.coalesce(header["STACKCNT"].try_cast("int") >= 2, F.lit(False)) | F.startswith(_card(header, "PROGRAM"), F.lit("siril"))


def classified(header: Column, path: Column) -> Column:
    """``scope, image_type, quality`` of a frame; null for whatever is none."""
    name = F.substring_index(path, "/", -1)
    skip = F.lit(False)
    for end in PICTURES:
        skip = skip | F.endswith(F.lower(name), F.lit(end))
    for start in BY_PRODUCTS:
        skip = skip | F.startswith(name, F.lit(start))
    scope = scope_of(header)
    kind = image_type(header, path, scope)
    found = F.struct(scope.alias("scope"), kind.alias("image_type"), F.when(F.startswith(name, F.lit("failed_")), "failed").otherwise("ok").alias("quality"))
    return F.when(~skip & ~is_derived(header) & scope.isNotNull() & kind.isNotNull(), found)


def capture_settings(kind: Column, own_filter: Column, exposure: Column, gain: Column, duo: tuple[str, ...], default_exposure: float, default_gain: int) -> Column:
    """What a target asks for, else by its type; an exposure of zero asks for nothing, a gain of zero does."""
    asked = F.when(own_filter != "", own_filter)
    return F.struct(
        F.coalesce(asked, F.when(kind.isin(*duo), "duo").otherwise("astro")).alias("filter"), F.coalesce(F.when(exposure != 0, exposure), F.lit(default_exposure)).alias("exposure"),
        F.coalesce(gain, F.lit(default_gain)).alias("gain"),
    )
