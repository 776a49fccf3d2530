"""Records in and out: JSON folders, atomic single documents, CSV, PNG previews, and the guards around destinations."""

from __future__ import annotations

import json
import os
import struct
import tempfile
import zlib
from pathlib import Path, PurePosixPath

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all JSON documents of a folder with the file each came from; a document that doesn't parse has its text in
    `_corrupt`."""
    found = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return found.select("*", F.col("_metadata.file_path").alias("file"))


def write_json(path: str | Path, value: object) -> None:
    """One small local document, whole or not at all: a temporary file, synced, renamed; NaN and infinity are refused."""
    path = Path(path)
    text = json.dumps(value, allow_nan=False, sort_keys=True, indent=1)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
        folder = os.open(path.parent, os.O_RDONLY)
        try:
            os.fsync(folder)
        finally:
            os.close(folder)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_csv(df: DataFrame, folder: str, blank: tuple[str, ...] = (), bom: bool = True) -> None:
    """CSV part files with a header, and empty columns for people to fill in; the folder must not exist. With bom every
    file begins with the mark that spreadsheets expect: it stands before the first column's name."""
    out = df.select("*", *[F.lit("").alias(c) for c in blank])
    if bom:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    out.write.option("header", True).option("encoding", "UTF-8").csv(folder)


def with_bom(csv_text: str) -> bytes:
    """A CSV document as spreadsheets expect it."""
    return b"\xef\xbb\xbf" + csv_text.encode()


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = gray.shape
    rows = np.zeros((h, w + 1), np.uint8)
    rows[:, 1:] = gray
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def fresh_destination(path: str | Path, source: str | Path) -> Path:
    """The resolved destination, if it doesn't exist and isn't inside the source's folder; else an error."""
    where, origin = Path(path).resolve(), Path(source).resolve()
    root = origin if origin.is_dir() else origin.parent
    if where.exists():
        raise FileExistsError(str(where))
    if where == root or root in where.parents:
        raise ValueError("the destination lies in the source's folder")
    return where


def contained(root: str | Path, recorded: str) -> Path:
    """A recorded path below root, if that is where it leads; else an error."""
    root = Path(root).resolve()
    path = (Path(recorded) if PurePosixPath(recorded).is_absolute() else root / recorded).resolve()
    if root != path and root not in path.parents:
        raise ValueError("the path leads outside")
    return path


def mounts(lines: DataFrame) -> DataFrame:
    """mount, fstype, depth from the lines (column value) of a mountinfo file; \\040 and its kin are unescaped."""
    parts = F.split("value", " - ", 2)
    point = F.split(parts[0], " ")[4]
    for code, char in (("\\\\040", " "), ("\\\\011", "\t"), ("\\\\012", "\n"), ("\\\\134", "\\\\")):
        point = F.regexp_replace(point, code, char)
    return lines.where(F.col("value").contains(" - ")).select(point.alias("mount"), F.split(parts[1], " ")[0].alias("fstype")).withColumn("depth", F.length("mount"))


def filesystem_type(mounted: DataFrame, path: str) -> DataFrame:
    """fstype of the longest mount that holds the path: one row, null if none does."""
    p = F.lit(path)
    holds = (F.col("mount") == "/") | (p == F.col("mount")) | p.startswith(F.concat("mount", F.lit("/")))
    return mounted.where(holds).agg(F.max_by("fstype", "depth").alias("fstype"))
