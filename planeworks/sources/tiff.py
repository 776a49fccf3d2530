"""Single-plane unsigned 16-bit TIFF files as tiles, and back.

Files are read by Spark's binaryFile source, so they may lie wherever Spark reads; a file is decoded by one task, after
its header has passed all guards. In a batch a bad file gives a row with a status and reason, not a failure.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeworks.sources.codecs import CodecError, lzw_decode, lzw_encode, packbits_decode, packbits_encode

#: Limits of a plane, tag numbers, types' sizes.
MAX_PIXELS, MAX_BYTES = 268_435_456, 512 << 20
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}
TILE_SCHEMA = "plane_id string, height int, width int, y0 int, x0 int, h int, w int, data binary"


RAW, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773


class BadTiff(ValueError):
    pass


def _inflate(raw: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(raw, size)


_READERS = {RAW: lambda raw, size: raw, LZW: lzw_decode, DEFLATE: _inflate, DEFLATE_OLD: _inflate, PACKBITS: packbits_decode}
_WRITERS = {RAW: bytes, LZW: lzw_encode, DEFLATE: zlib.compress, PACKBITS: packbits_encode}


def decode(data: bytes, max_pixels: int = MAX_PIXELS, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The plane of a classic or big TIFF: one page, one 16-bit sample, black is zero, top-left; raw, PackBits, LZW or
    deflate segments, with or without horizontal differences."""
    if data[:2] not in (b"II", b"MM") or len(data) < 8:
        raise BadTiff("not a TIFF")
    o = "<" if data[:2] == b"II" else ">"
    magic = struct.unpack_from(f"{o}H", data, 2)[0]
    if magic not in (42, 43):
        raise BadTiff("not a TIFF")
    big = magic == 43
    try:
        at = struct.unpack_from(f"{o}{'Q' if big else 'I'}", data, 8 if big else 4)[0]
        n = struct.unpack_from(f"{o}{'Q' if big else 'H'}", data, at)[0]
        first, size, room = at + (8 if big else 2), 20 if big else 12, 8 if big else 4
        tags: dict[int, tuple] = {}
        for i in range(n):
            p = first + i * size
            tag, kind = struct.unpack_from(f"{o}HH", data, p)
            count = struct.unpack_from(f"{o}{'Q' if big else 'I'}", data, p + 4)[0]
            if kind not in _CODES:
                continue
            place = p + 4 + room
            if _SIZES[kind] * count > room:
                place = struct.unpack_from(f"{o}{'Q' if big else 'I'}", data, place)[0]
            tags[tag] = struct.unpack_from(f"{o}{count}{_CODES[kind]}", data, place)
        following = struct.unpack_from(f"{o}{'Q' if big else 'I'}", data, first + n * size)[0]
    except struct.error:
        raise BadTiff("directory cut off") from None
    if following:
        raise BadTiff("more than one page")
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h = one(256, 0), one(257, 0)
    if not w or not h:
        raise BadTiff("no size")
    if w * h > max_pixels or 2 * w * h > max_bytes:
        raise BadTiff("plane too large")
    for rule, reason in ((tags.get(258, (1,)) == (16,), "samples are not 16 bits"), (one(277, 1) == 1, "more than one sample"), (one(339, 1) == 1, "samples are not unsigned"), (one(262, -1) == 1, "black is not zero"), (one(274, 1) == 1, "orientation"), (one(259, 1) in _READERS, "compression"), (one(317, 1) in (1, 2), "predictor")):
        if not rule:
            raise BadTiff(reason)
    tiled = 324 in tags
    th, tw = (one(323, 0), one(322, 0)) if tiled else (min(one(278, h), h), w)
    places, counts = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    if not th or not tw or not places or not counts or len(places) != len(counts) or len(places) != -(-h // th) * -(-w // tw):
        raise BadTiff("segments missing")
    if any(c <= 0 or p + c > len(data) for p, c in zip(places, counts, strict=True)):
        raise BadTiff("segment empty or outside the file")
    out, k = np.empty((h, w), np.uint16), 0
    for y in range(0, h, th):
        for x in range(0, w, tw):
            rows = th if tiled else min(th, h - y)
            try:
                raw = _READERS[one(259, 1)](data[places[k] : places[k] + counts[k]], rows * tw * 2)
            except (zlib.error, CodecError):
                raise BadTiff("segment doesn't decode") from None
            if len(raw) < rows * tw * 2:
                raise BadTiff("segment too short")
            block = np.frombuffer(raw, f"{o}u2", rows * tw).reshape(rows, tw).astype(np.uint16)
            if one(317, 1) == 2:
                block = np.add.accumulate(block, axis=1, dtype=np.uint16)
            out[y : y + th, x : x + tw] = block[: h - y, : w - x]
            k += 1
    return out


def encode(plane: np.ndarray, deflate: bool = False, order: str = "<", rows: int = 64, tile: int | None = None, compression: int | None = None, predictor: int = 1) -> bytes:
    """A classic TIFF of one unsigned 16-bit plane."""
    h, w = plane.shape
    compression = compression or (DEFLATE if deflate else RAW)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    places, counts = [], []
    dy, dx = (tile, tile) if tile else (rows, w)
    for y in range(0, h, dy):
        for x in range(0, w, dx):
            block = plane[y : y + dy, x : x + dx]
            if tile:
                block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1])))
            if predictor == 2:
                block = np.diff(block.astype(np.uint16), axis=1, prepend=np.zeros((len(block), 1), np.uint16))
            raw = _WRITERS[compression](block.astype(f"{order}u2").tobytes())
            places.append(len(out))
            counts.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [16]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
    tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, places), (325, 4, counts)] if tile else [(273, 4, places), (278, 4, [rows]), (279, 4, counts)]
    entries = b""
    for tag, kind, values in sorted(tags):
        body = struct.pack(f"{order}{len(values)}{_CODES[kind]}", *values)
        if len(body) > 4:
            at = len(out)
            out += body
            body = struct.pack(f"{order}I", at)
        entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    struct.pack_into(f"{order}I", out, 4, len(out))
    return bytes(out + struct.pack(f"{order}H", len(tags)) + entries + b"\0\0\0\0")


def pixel_sha(plane: np.ndarray) -> str:
    """sha256 of the samples, little endian, in row order."""
    return hashlib.sha256(np.ascontiguousarray(plane, "<u2").tobytes()).hexdigest()


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified, file_sha256, content."""
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_sha256"), "content")


def read_tiles(source: DataFrame, size: int = 1024) -> DataFrame:
    """Tiles of each file (path, content), with status and reason; the plane's sample hash on each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    plane = decode(content)
                except BadTiff as e:
                    yield pd.DataFrame([{"plane_id": path, "height": None, "width": None, "y0": None, "x0": None, "h": None, "w": None, "data": None, "pixel_sha256": None, "status": "rejected", "reason": str(e)}])
                    continue
                sha = pixel_sha(plane)
                for tile in cut(path, plane, size):
                    yield pd.DataFrame([{**tile, "pixel_sha256": sha, "status": "ok", "reason": None}])

    return source.select("path", "content").mapInPandas(run, TILE_SCHEMA + ", pixel_sha256 string, status string, reason string")


def cut(plane_id: str, plane: np.ndarray, size: int) -> Iterator[dict]:
    h, w = plane.shape
    for y in range(0, h, size):
        for x in range(0, w, size):
            part = plane[y : y + size, x : x + size]
            yield {"plane_id": plane_id, "height": h, "width": w, "y0": y, "x0": x, "h": part.shape[0], "w": part.shape[1], "data": part.astype("<u2").tobytes()}


def pixels(tiles: DataFrame) -> DataFrame:
    """plane_id, y, x, v: tiles as rows of samples, without leaving the JVM."""
    two = F.expr("transform(sequence(0, h * w - 1), i -> conv(hex(substring(data, 2 * i + 2, 1)), 16, 10) * 256 + conv(hex(substring(data, 2 * i + 1, 1)), 16, 10))")
    each = tiles.select("plane_id", "y0", "x0", "w", F.posexplode(two).alias("i", "v"))
    return each.select("plane_id", (F.col("y0") + F.floor(F.col("i") / F.col("w"))).cast("long").alias("y"), (F.col("x0") + F.col("i") % F.col("w")).cast("long").alias("x"), F.col("v").cast("long").alias("v"))


def tile_histogram(tiles: DataFrame) -> DataFrame:
    """plane_id, v, cnt: counts a tile in numpy, summed by Spark; for planes too large to explode into rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for plane, data in zip(frame["plane_id"], frame["data"], strict=True):
                v, n = np.unique(np.frombuffer(data, "<u2"), return_counts=True)
                yield pd.DataFrame({"plane_id": plane, "v": v.astype(np.int64), "cnt": n})

    return tiles.select("plane_id", "data").mapInPandas(run, "plane_id string, v long, cnt long").groupBy("plane_id", "v").agg(F.sum("cnt").alias("cnt"))


def crop(tiles: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Tiles that a box touches; the box's samples follow from pixels() and the same box."""
    return tiles.where((F.col("x0") < x1) & (F.col("x0") + F.col("w") > x0) & (F.col("y0") < y1) & (F.col("y0") + F.col("h") > y0))


def to_files(tiles: DataFrame) -> DataFrame:
    """plane_id, content, file_sha256, pixel_sha256: one TIFF a plane, read back and compared before it is returned."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        plane = assemble(group)
        content = encode(plane)
        back = decode(content)
        if pixel_sha(back) != pixel_sha(plane):
            raise BadTiff("readback differs")
        return pd.DataFrame([{"plane_id": group["plane_id"].iloc[0], "content": content, "file_sha256": hashlib.sha256(content).hexdigest(), "pixel_sha256": pixel_sha(plane)}])

    return tiles.groupBy("plane_id").applyInPandas(build, "plane_id string, content binary, file_sha256 string, pixel_sha256 string")


def assemble(group: pd.DataFrame) -> np.ndarray:
    out = np.zeros((int(group["height"].iloc[0]), int(group["width"].iloc[0])), np.uint16)
    for r in group.itertuples(index=False):
        out[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.frombuffer(r.data, "<u2").reshape(r.h, r.w)
    return out
