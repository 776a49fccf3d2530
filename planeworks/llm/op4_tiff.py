"""TIFF media columns: writing byte payloads as 8-bit TIFF pages, and reading TIFF files to one row a page.

The reader walks the chain of image directories (either byte order, strips or tiles), decodes uncompressed, PackBits,
LZW and deflate data, undoes horizontal differencing, and gives each page's samples in row order. The writer makes what
the reader reads. Both are per row, so nothing is shuffled.

A text's payload is its UTF-8 bytes and bytes 0 up to a positive multiple of 64, as rows of 64 samples. It is dealt to a
layout (compression, predictor, strips or tiles, byte order, one to three pages) by its checksum alone, so every layout
has its share of texts of every length, and equal texts are equal files.

Defined cases: null content is no file: one row with page null and status `null`; content that is no TIFF, or is cut
off, or uses what isn't supported, gives one row with page null and a status that says why, never a crash; a chain of
directories that loops is cut at the first repeat. A null or empty text is one row of 64 zeros. Repeated rows stay
repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeworks.llm.text import id_text, slices
from planeworks.sources.codecs import lzw_decode, lzw_encode, packbits_decode, packbits_encode

#: Fixed values of the format.
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
_DEFLATE_OLD = 32946
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
#: Samples in a row of a text's page.
WIDTH = 64


class TiffError(ValueError):
    pass


def _decode(raw: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return raw
    if compression == PACKBITS:
        return packbits_decode(raw, size)
    if compression == LZW:
        return lzw_decode(raw, size)
    if compression in (DEFLATE, _DEFLATE_OLD):
        try:
            return zlib.decompressobj().decompress(raw, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    raise TiffError(f"compression {compression}")


_ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 3), PACKBITS: packbits_encode}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 512, tile: int | None = None, order: str = "<") -> bytes:
    """A classic TIFF of 8-bit gray pages (2-d uint8), in strips or square tiles (a multiple of 16)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for page in pages:
        h, w = page.shape
        step_y, step_x = (tile, tile) if tile else (rows_per_strip, w)
        places, counts = [], []
        for y in range(0, h, step_y):
            for x in range(0, w, step_x):
                block = page[y : y + step_y, x : x + step_x]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
                raw = _ENCODERS[compression](np.ascontiguousarray(block).tobytes())
                places.append(len(out))
                counts.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1])]
        tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, places), (325, 4, counts)] if tile else [(273, 4, places), (278, 4, [rows_per_strip]), (279, 4, counts)]
        tags += [(317, 3, [predictor])]
        entries = bytearray()
        for tag, kind, values in sorted(tags):
            body = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(body) > 4:
                at, body_ = len(out), body
                out += body_ + b"\0" * (len(body_) % 2)
                body = struct.pack(f"{order}I", at)
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries) // 12) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """(byte order, {tag: values}) of each image directory."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(f"{order}HI", data, 2)
    if magic != 42:
        raise TiffError(f"magic {magic}")
    seen = set()
    while at and at not in seen:
        seen.add(at)
        if at + 2 > len(data):
            raise TiffError("directory outside the file")
        (n,) = struct.unpack_from(f"{order}H", data, at)
        if at + 6 + 12 * n > len(data):
            raise TiffError("directory cut off")
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
            if kind not in (1, 3, 4):
                continue
            size, place = _SIZES[kind] * count, at + 10 + 12 * i
            if size > 4:
                (place,) = struct.unpack_from(f"{order}I", data, place)
            if place + size > len(data):
                raise TiffError("tag outside the file")
            tags[tag] = list(struct.unpack_from(f"{order}{count}{'B' if kind == 1 else 'H' if kind == 3 else 'I'}", data, place))
        yield order, tags
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def read_page(data: bytes, order: str, tags: dict[int, list[int]]) -> np.ndarray:
    """Samples (rows, columns, samples a pixel) of unsigned 8- or 16-bit pages."""
    w, h = tags.get(256, [0])[0], tags.get(257, [0])[0]
    bits, spp = set(tags.get(258, [1])), tags.get(277, [1])[0]
    if not w or not h:
        raise TiffError("no size")
    if bits not in ({8}, {16}) or tags.get(339, [1])[0] != 1:
        raise TiffError(f"samples of {sorted(bits)} bits")
    if tags.get(284, [1])[0] != 1 and spp > 1:
        raise TiffError("separate planes")
    kind = np.dtype(np.uint8) if bits == {8} else np.dtype(f"{order}u2")
    compression, predictor = tags.get(259, [1])[0], tags.get(317, [1])[0]
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor}")
    tiled = 324 in tags
    th, tw = (tags[323][0], tags[322][0]) if tiled else (min(h, tags.get(278, [h])[0]), w)
    places, counts = (tags[324], tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    if not places or not counts or len(places) != len(counts) or len(places) != -(-h // th) * -(-w // tw):
        raise TiffError("strips or tiles missing")
    out = np.empty((h, w, spp), kind.newbyteorder("="))
    k = 0
    for y in range(0, h, th):
        for x in range(0, w, tw):
            rows = th if tiled else min(th, h - y)
            size = rows * tw * spp * kind.itemsize
            if places[k] + counts[k] > len(data):
                raise TiffError("strip or tile outside the file")
            raw = _decode(data[places[k] : places[k] + counts[k]], compression, size)
            if len(raw) < size:
                raise TiffError("strip or tile too short")
            block = np.frombuffer(raw[:size], kind).reshape(rows, tw, spp).astype(out.dtype)
            if predictor == 2:
                block = np.add.accumulate(block, axis=1, dtype=out.dtype)
            out[y : y + th, x : x + tw] = block[: h - y, : w - x]
            k += 1
    return out


def features(samples: bytes) -> str:
    """size, mean, deviation, entropy of the sample values, share of zeros: rounded, so that they are stable text."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n = max(1, int(counts.sum()))
    p = counts / n
    total, squares = int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
    mean, deviation = total / n, (n * squares - total * total) ** 0.5 / n
    own = p[p > 0]
    return f"n={len(samples)};mean={mean:.4f};sd={deviation:.4f};bits={float(-(own * np.log2(own)).sum()):.4f};zeros={p[0]:.4f}"


PAGE_SCHEMA = "{key} long, page int, status string, byte_order string, width int, height int, samples_per_pixel int, bits int, compression int, predictor int, tiled boolean, samples binary"


def page_rows(key: int | None, data: bytes | None) -> Iterator[dict]:
    """One row a page, or one row that says why there is none."""
    empty = dict.fromkeys(("page", "byte_order", "width", "height", "samples_per_pixel", "bits", "compression", "predictor", "tiled", "samples"))
    if data is None:
        yield {"key": key, **empty, "status": "null"}
        return
    number = 0
    try:
        for order, tags in directories(data):
            page = read_page(data, order, tags)
            yield {"key": key, "page": number, "status": "ok", "byte_order": order, "width": page.shape[1], "height": page.shape[0], "samples_per_pixel": page.shape[2], "bits": page.dtype.itemsize * 8, "compression": tags.get(259, [1])[0], "predictor": tags.get(317, [1])[0], "tiled": 324 in tags, "samples": page.tobytes()}
            number += 1
        if not number:
            yield {"key": key, **empty, "status": "no pages"}
    except (TiffError, struct.error, ValueError, MemoryError) as e:
        yield {"key": key, **empty, "status": str(e)[:200] or "bad"}


def pages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a page of batches of (key, content, further columns), which each page carries on; about 4 MB at once."""
    for b in batches:
        rows, held = [], 0
        for i, (key, data) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
            for row in page_rows(key, data.as_py()):
                rows.append((i, row))
                held += len(row["samples"] or b"")
                if held >= 4 << 20:
                    yield _page_batch(b, rows)
                    rows, held = [], 0
        if rows:
            yield _page_batch(b, rows)


def _page_batch(b: pa.RecordBatch, rows: list[tuple[int, dict]]) -> pa.RecordBatch:
    pages = pa.RecordBatch.from_pylist([r for _, r in rows], schema=_PAGES)
    take = pa.array([i for i, _ in rows])
    more = b.schema.names[2:]
    return pa.RecordBatch.from_arrays([*pages.columns, *[b.column(c).take(take) for c in more]], names=[*pages.schema.names, *more])


def read_tiff_pages(files: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """One row a page of each file in a binary column: id, page, status, layout columns, samples."""
    chosen = files.select(F.col(id_col).cast("long").alias("key"), F.col(content_col).alias("content"))
    return chosen.mapInArrow(pages_of, PAGE_SCHEMA.format(key="key")).withColumnRenamed("key", "doc_id")


_PAGES = pa.schema([("key", pa.int64()), ("page", pa.int32()), ("status", pa.string()), ("byte_order", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("samples_per_pixel", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("samples", pa.binary())])


#: Every way in which a payload may be stored, in the order in which checksums are dealt.
LAYOUTS = [
    {"compression": compression, "predictor": predictor, "tile": tile, "order": order, "pages": pages}
    for compression in (PACKBITS, LZW, DEFLATE) for predictor in (1, 2) for tile in (None, 64) for order in ("<", ">") for pages in (1, 2, 3)
]


def layout_of(payload: bytes) -> dict:
    """How a payload is stored: by its checksum alone."""
    return LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]


def payload_of(text: bytes) -> bytes:
    """The text and zeros up to the next positive multiple of WIDTH."""
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def store_text(payload: bytes) -> bytes:
    """64 samples a row, in as many pages as the layout says, or as there are rows."""
    layout = dict(layout_of(payload))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return write_tiff(np.array_split(rows, min(layout.pop("pages"), len(rows))), **layout)


def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, media, n_bytes of batches of (doc_id, text)."""
    for part, data, offsets in slices(batches, 4 << 20):
        raw = data.tobytes()
        media = [store_text(payload_of(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary()), pa.array(np.diff(offsets))], names=["doc_id", "media", "n_bytes"])


def folded(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """One row a text from its files' pages as pages_of() gives them, in order: payload and features of what was read."""
    names = ["doc_id", "n_bytes", "n_pages", *["media", "payload"] * keep, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary(), pa.binary()] * keep, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    held: list = []  # (key, bytes of text, file, pages' samples) of the text at hand

    def row(key: int | None, n: int, media: bytes, pages: list[bytes]) -> tuple:
        payload = b"".join(pages)
        both = (media, payload) if keep else ()
        return (key, n, len(pages), *both, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        rows = []
        for key, page, status, samples, media, n in zip(*[b.column(c).to_pylist() for c in ("key", "page", "status", "samples", "media", "n_bytes")], strict=True):
            if status != "ok":
                raise TiffError(f"a stored text doesn't read back: {status}")
            if page == 0:
                if held:
                    rows.append(row(*held))
                held = [key, n, media, []]
            held[3].append(samples)
        if rows:
            yield batch(rows)
    if held:
        yield batch([row(*held)])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_pages, media (the TIFF file) and what is read back from it, page by page: payload, features.
    keep=False leaves the two binary columns out and gives their digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(1), b.column(2)], names=["key", "content", "media", "n_bytes"]) for b in stored(batches))
        return folded(pages_of(files), keep)

    binary = "media binary, payload binary, " if keep else ""
    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_bytes long, n_pages int, {binary}payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=False)
