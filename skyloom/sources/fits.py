"""FITS files: headers, pixels, completeness, listings, and a writer.

A header is 80-byte cards in 2880-byte blocks.  Headers are read in Arrow batches
over rows of files, or from the first blocks of each listed file alone; listings
prune the content column, so they touch file metadata only.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import png

BLOCK, CARD = 2880, 80
_DTYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
_KEY = re.compile(r"^[A-Z0-9_-]{1,8}$")


def parse_header(data: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """Cards of the header at ``at`` as text, and where its data begins; strings stripped, absent keys absent."""
    out: dict[str, str] = {}
    while at + BLOCK <= len(data):
        block = data[at : at + BLOCK]
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return out, at
            if card[8:10] != "= " or not _KEY.match(key):
                continue
            value = card[10:]
            if value.lstrip().startswith("'"):
                body = re.match(r"\s*'((?:[^']|'')*)'", value)
                text = body[1].replace("''", "'").strip() if body else value.strip(" '")
            else:
                text = value.split("/", 1)[0].strip()
            out[key] = text
    raise ValueError("no END card")


def data_size(header: dict[str, str]) -> int:
    n = int(header.get("NAXIS", 0))
    size = abs(int(header.get("BITPIX", 8))) // 8 if n else 0
    for i in range(1, n + 1):
        size *= int(header.get(f"NAXIS{i}", 0))
    return size


def complete(data_length: int, header: dict[str, str], begin: int) -> bool:
    """Whether a file holds its whole, padded data; fewer than two axes always do."""
    if data_length == 0:
        return False
    if int(header.get("NAXIS", 0)) < 2:
        return True
    return data_length >= begin + -(-data_size(header) // BLOCK) * BLOCK


def units(data: bytes) -> Iterator[tuple[dict[str, str], np.ndarray | None]]:
    """Every header-data unit of a file."""
    at = 0
    while at + BLOCK <= len(data):
        try:
            header, begin = parse_header(data, at)
        except ValueError:
            return
        size = data_size(header)
        array = None
        if size and begin + size <= len(data):
            shape = [int(header[f"NAXIS{i}"]) for i in range(int(header["NAXIS"]), 0, -1)]
            kind = np.dtype(_DTYPES[int(header["BITPIX"])])
            array = np.frombuffer(data, kind, int(np.prod(shape)), begin).reshape(shape).astype(np.float64)
            array = array * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0))
        yield header, array
        at = begin + -(-size // BLOCK) * BLOCK


def write_fits(array: np.ndarray, header: dict[str, object] | None = None) -> bytes:
    """One image as FITS bytes (float32, or unsigned 16 bit by offset)."""
    cards = [("SIMPLE", True)]
    if array.dtype == np.uint16:
        body, bits, extra = (array.astype(np.int32) - 32768).astype(">i2"), 16, [("BZERO", 32768), ("BSCALE", 1)]
    else:
        body, bits, extra = array.astype(">f4"), -32, []
    cards += [("BITPIX", bits), ("NAXIS", array.ndim), *((f"NAXIS{i + 1}", n) for i, n in enumerate(array.shape[::-1])), *extra, *((header or {}).items())]

    def card(key: str, value: object) -> str:
        if isinstance(value, bool):
            text = f"{'T' if value else 'F':>20}"
        elif isinstance(value, str):
            text = "'" + value.replace("'", "''").ljust(8) + "'"
        else:
            text = f"{value:>20}"
        return f"{key:<8}= {text}".ljust(CARD)[:CARD]

    head = "".join(card(k, v) for k, v in cards) + "END".ljust(CARD)
    head = head.ljust(-(-len(head) // BLOCK) * BLOCK)
    data = body.tobytes()
    return head.encode("ascii", "replace") + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """FITS files under a folder: ``path, length, modified`` (seconds); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", F.unix_timestamp("modificationTime").alias("modified")).filter(F.lower("path").rlike(r"\.fits?$"))


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new, or whose size or time differs, or that have no hash yet."""
    k = known.select("path", F.col("length").alias("_l"), F.col("modified").alias("_m"), F.col("hash").alias("_h"))
    same = F.col("_l").eqNullSafe(F.col("length")) & F.col("_m").eqNullSafe(F.col("modified")) & F.col("_h").isNotNull()
    return found.join(k, "path", "left").filter(~F.coalesce(same, F.lit(False))).select(*found.columns)


def header_rows(files: DataFrame) -> DataFrame:
    """``path, length, header (map), complete, sha256`` of rows ``path, length, content``; an unreadable file has a null header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, ok = _headers(batch.column("content").to_pylist(), batch.column("length").to_pylist())
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "length": batch.column("length"), "header": heads, "complete": ok, "sha256": batch.column("sha256")})

    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256")).mapInArrow(run, f"{_HEADER}, sha256 string")


_HEADER = "path string, length long, header map<string,string>, complete boolean"


def _headers(contents: list[bytes | None], lengths: list[int]) -> tuple[pa.Array, pa.Array]:
    heads, ok = [], []
    for data, length in zip(contents, lengths, strict=True):
        try:
            header, begin = parse_header(data or b"")
            heads.append(list(header.items()))
            ok.append(complete(length, header, begin))
        except ValueError:
            heads.append(None)
            ok.append(False)
    return pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(ok, pa.bool_())


def read_headers(spark: SparkSession, root: str, hashed: bool = True) -> DataFrame:
    """:func:`header_rows` of the files under a folder.

    Without ``hashed`` only the blocks of each header are read, and nothing is hashed.
    """
    if hashed:
        return header_rows(binary_files(spark, root))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, ok = _headers([head_of(p) for p in batch.column("path").to_pylist()], batch.column("length").to_pylist())
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "length": batch.column("length"), "header": heads, "complete": ok})

    return listing(spark, root).select("path", "length").mapInArrow(run, _HEADER)


def head_of(path: str, most: int = 400) -> bytes:
    """The blocks of a file up to its END card, at most ``most``."""
    fs, place = filesystem(path)
    out = b""
    with fs.open_input_stream(place) as f:
        while len(out) < most * BLOCK:
            block = f.read(BLOCK)
            out += block
            if len(block) < BLOCK or any(block[i : i + 8] == b"END     " for i in range(0, BLOCK, CARD)):
                break
    return out


def filesystem(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pa_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.lower("path").rlike(r"\.fits?$")).select("path", "length", "content")


def frame_listing(files: DataFrame, prefix: str = "", suffix: str = "", artifacts: tuple[str, ...] = ("failed_", "stacked")) -> DataFrame:
    """Rows of a listing whose file name has the prefix and suffix and is none of the instrument's by-products."""
    name = F.lower(F.substring_index("path", "/", -1))
    keep = name.startswith(prefix.lower()) & F.regexp_replace(name, r"\.fits?$", "").endswith(suffix.lower())
    for a in artifacts:
        keep = keep & ~name.startswith(a)
    return files.filter(keep)


def image_rows(files: DataFrame) -> DataFrame:
    """One row per image unit of rows ``path, content``: ``path, idx, height, width, channels, px`` in [0, 1].

    FITS values go from their least to their greatest (a constant image is 0),
    PNG values by their depth.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data = data or b""
                if data[:4] == b"\x89PNG":
                    rows = [png.decode(data)]
                else:
                    rows = [_scaled(a) for _, a in units(data) if a is not None and a.ndim >= 2]
                out = []
                for i, a in enumerate(rows):
                    planes = a if a.ndim == 3 else a[None]
                    out.append((path, i, planes.shape[1], planes.shape[2], planes.shape[0], planes.astype(np.float32).ravel()))
                if out:
                    kinds = (("path", pa.string()), ("idx", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("px", pa.list_(pa.float32())))
                    yield pa.RecordBatch.from_pydict({c: pa.array([r[z] for r in out], kind) for z, (c, kind) in enumerate(kinds)})

    return files.select("path", "content").mapInArrow(run, "path string, idx int, height int, width int, channels int, px array<float>")


def _scaled(a: np.ndarray) -> np.ndarray:
    lo, hi = float(np.nanmin(a)), float(np.nanmax(a))
    return (a - lo) / (hi - lo) if hi > lo else np.zeros_like(a)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """:func:`image_rows` of the files under a folder."""
    return image_rows(binary_files(spark, root))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows ``name, content`` as files of a shared folder, each whole or not at all; ``path, length`` of what is there.

    Tasks write; a file that is there with the same length stays (incremental copy).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root)
        for batch in batches:
            paths, sizes = [], []
            for name, data in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                place = f"{root.rstrip('/')}/{name}"
                if fs.get_file_info(place).size != len(data):
                    part = f"{place}.{uuid.uuid4().hex}.part"
                    with fs.open_output_stream(part) as f:
                        f.write(data)
                    fs.move(part, place)
                paths.append(place)
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "length": pa.array(sizes, pa.int64())})

    return rows.select("name", "content").mapInArrow(run, "path string, length long")


def master_fields(name: Column) -> Column:
    """Exposure, gain, binning, temperature and stack depth from a master's file name; absent ones null."""
    get = lambda pattern, kind: F.regexp_extract(name, pattern, 1).try_cast(kind)
    return F.struct(
        F.regexp_extract(name, r"^([a-z]+)_", 1).alias("kind"), get(r"exp_(\d+\.\d+)", "double").alias("exposure"), get(r"gain_(\d+)", "int").alias("gain"),
        get(r"bin_(\d+)", "int").alias("binning"), get(r"_(-?\d+)C(?:_|\.)", "int").alias("temp"), get(r"stack_(\d+)", "int").alias("stack"), get(r"ir_(\d+)", "int").alias("ir"),
    )


def enrich(header: Column, name: Column) -> Column:
    """A header whose missing exposure, gain and temperature come from the file's name."""
    m = master_fields(name)
    add = F.map_filter(F.create_map(F.lit("EXPTIME"), m["exposure"].cast("string"), F.lit("GAIN"), m["gain"].cast("string"), F.lit("DET-TEMP"), m["temp"].cast("string")), lambda k, v: v.isNotNull())
    return F.map_zip_with(add, header, lambda k, a, b: F.coalesce(b, a))


def encode_images(images: DataFrame, header: dict[str, str] | None = None, kind: str = "fits") -> DataFrame:
    """``img, content``: each image row (``img, c, h, w, px``) as the bytes of a FITS or 16-bit PNG file, for a binary sink.

    ``header`` names FITS cards and the columns that they take their values from.
    """
    cards = header or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for r in batch.to_pylist():
                a = np.asarray(r["px"], np.float32).reshape(r["c"], r["h"], r["w"])[0 if r["c"] == 1 else slice(None)]
                data.append(png.encode(a) if kind == "png" else write_fits(a, {k: r[c] for k, c in cards.items() if r[c] is not None}))
            yield pa.RecordBatch.from_pydict({"img": pa.array([str(x) for x in batch.column("img").to_pylist()], pa.string()), "content": pa.array(data, pa.binary())})

    return images.select(*dict.fromkeys(["img", "c", "h", "w", "px", *cards.values()])).mapInArrow(run, "img string, content binary")
