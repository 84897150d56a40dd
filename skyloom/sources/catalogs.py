"""Small lookup files and their tables: separated catalogs, JSON lists, YAML documents, weather responses, migrations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sphere, text
from . import fits


def read_catalog(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], sep: str = ";") -> DataFrame:
    """Separated files as one table of strings, in the order given; files that are missing are empty.

    ``columns`` are all columns of the files, in their order.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    out = spark.createDataFrame([], schema + ", source_no int")
    for i, p in enumerate(paths):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            out = out.unionByName(spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).schema(schema).csv(p).withColumn("source_no", F.lit(i)))
    return out


def catalog_entries(raw: DataFrame, name: str, ra: str, dec: str, magnitude: str, common: str) -> DataFrame:
    """``canonical, ra, dec, magnitude, common_name``; malformed positions and numbers are null."""
    return raw.select(
        text.canonical_id(F.col(name)).alias("canonical"), sphere.sexagesimal(F.col(ra), 15.0).alias("ra"), sphere.sexagesimal(F.col(dec), 1.0).alias("dec"),
        F.col(magnitude).try_cast("double").alias("magnitude"), F.nullif(F.trim(F.element_at(F.split(F.col(common), ","), 1)), F.lit("")).alias("common_name"), "source_no",
    )


def alias_table(entries: DataFrame) -> DataFrame:
    """``alias, canonical``: the first entry of an alias wins.

    Columns ``m``, ``ngc``, ``ic`` and ``identifiers`` of the entries, if there, are
    cross-identifications: numbers of those catalogs, and a list of other names.
    """
    have = set(entries.columns)
    keys = [text.alias_keys(F.col("canonical")), *(text.numbered_aliases(c, F.col(c)) for c in ("m", "ngc", "ic") if c in have), *([text.foreign_aliases(F.col("identifiers"))] if "identifiers" in have else [])]
    every = entries.select(F.explode(F.array_distinct(F.concat(*keys))).alias("alias"), "canonical", "source_no")
    return every.groupBy("alias").agg(F.min(F.struct("source_no", "canonical")).alias("m")).select("alias", "m.canonical")


def ranked_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of names as ``rank, name``."""
    return ranked(spark.read.text(path, wholetext=True), "value")


def ranked(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """``rank, name`` of the JSON lists in a column."""
    return rows.select(*keep, F.posexplode(F.from_json(column, "array<string>")).alias("rank", "name"))


def name_table(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of names as ``key, name``."""
    return named(spark.read.text(path, wholetext=True), "value")


def named(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """``key, name`` of the JSON objects in a column."""
    return rows.select(*keep, F.explode(F.from_json(column, "map<string,string>")).alias("key", "name"))


def read_yaml(path: str | Path) -> list[dict[str, Any]]:
    """The documents of a YAML file or of all files of a folder, by name; small control files on the driver."""
    p = Path(path)
    files = sorted([*p.glob("*.yaml"), *p.glob("*.yml")]) if p.is_dir() else [p]
    return [d for f in files for d in yaml.safe_load_all(f.read_text()) if d]


def hourly(response: Column) -> Column:
    """A weather response's parallel arrays as an array of hours."""
    h = F.from_json(response, "hourly struct<time array<string>, cloud_cover array<double>, rain array<double>, snowfall array<double>>")["hourly"]
    return F.arrays_zip(h["time"].alias("time"), h["cloud_cover"].alias("cloud_cover"), h["rain"].alias("rain"), h["snowfall"].alias("snowfall"))


def factory_masters(listing: DataFrame, root: str) -> DataFrame:
    """Masters three folders below ``root`` with what their paths and names say: camera, kind, settings."""
    below = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
    m = listing.filter(F.size(below) == 3).withColumn("m", fits.master_fields(F.get(below, F.lit(2))))
    return m.select("path", F.get(below, F.lit(0)).alias("camera"), F.coalesce(F.nullif("m.kind", F.lit("")), F.get(below, F.lit(1))).alias("kind"), "m.exposure", "m.gain", "m.binning", "m.temp", "m.stack")


def sequence_size(frames: DataFrame) -> DataFrame:
    """Per sequence: bytes, frames, and the pixel depth of the first frame that tells it.

    ``path`` is any value that orders a sequence's frames; where it ties, which
    frame is the first is left open.
    """
    depth = F.col("header")["BITPIX"].try_cast("int")
    return frames.groupBy("seq").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("frames"), F.min_by(depth, F.when(depth.isNotNull(), F.col("path"))).alias("depth"))


def migrate(tables: dict[str, DataFrame], version: int, steps: Sequence[Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]) -> tuple[dict[str, DataFrame], int]:
    """Apply the numbered steps after ``version`` in order; steps go forward only."""
    if version > len(steps):
        raise ValueError(f"tables are at version {version}, newer than {len(steps)}")
    for step in steps[version:]:
        tables = step(dict(tables))
    return tables, len(steps)
