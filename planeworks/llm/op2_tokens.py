"""Token-id output in a block container coded by a static range asymmetric numeral system (rANS).

Texts become token ids; a row of the container (a stretch of documents of about `shard_bytes` of text) counts its ids
once, and all its blocks share that frequency table. A block is coded by many interleaved coder lanes (id i belongs to
lane i mod lanes), stands alone, and carries checkpoints (all lane states and the place in the payload at some steps)
and checksums, so that rows, blocks, and the stretches between a block's checkpoints decode in parallel: reading takes
all stretches of a block at once, as so many more lanes.

Container: `data`, Parquet files with one row a stretch, written by Spark, so that any file system Spark knows will do:

    shard, part            place of the row; rows ascend with doc_id
    doc_ids, doc_tokens    the documents in it and their ids' counts (the end id counted)
    n_tokens, ids_crc32    all ids of the row; of the ids as little-endian uint32
    symbols, freqs         the row's table (uint32 little endian)
    blocks                 of at most block_tokens ids each, in order:
        lanes, n_tokens
        states             final coder states, uint64 each
        checkpoints        per `checkpoint_every` steps: position in the payload (uint64) and the lanes' states (uint64)
        payload            32-bit words
        payload_crc32      of the payload

and `starts`, (shard, part, start): the ids before each row, summed from the counts alone once `data` is written.

Defined cases: a null or empty text is the end id alone; a null doc_id is kept and sorts first; repeated rows stay
repeated rows; an empty table gives an empty container. A document is never split over rows, so that a row holds one
document's ids at least, however long; blocks may begin within a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planeworks.llm.text import bounded, id_text, shared_dir, text_bytes
from planeworks.llm.tokens import Encoder, default_path

#: log2 of the table's total; at least as many slots as there are ids.
SCALE = 20
LANES = 2048
BLOCK_TOKENS = 1 << 19
CHECKPOINT_EVERY = 128
#: Bytes of text in a row, and in a task's range of documents: what a task holds follows from the first.
SHARD_BYTES = 8 << 20
RANGE_BYTES = 24 << 20
#: Rows of `starts` (24 bytes each) that are broadcast at most; beyond that the rows' digests are joined with them.
BROADCAST_ROWS = 500_000
_LOW = np.uint64(1 << 31)

BLOCK = "struct<lanes: int, n_tokens: long, states: binary, checkpoints: binary, payload: binary, payload_crc32: long>"
SCHEMA = f"shard int, part int, doc_ids array<long>, doc_tokens array<long>, n_tokens long, ids_crc32 long, symbols binary, freqs binary, blocks array<{BLOCK}>"


def table_of(counts: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies that sum to 2**scale, each at least 1) of ids' counts."""
    symbols = np.flatnonzero(counts)
    if len(symbols) == 0:
        return symbols.astype(np.uint32), np.zeros(0, np.uint32)
    total, room = int(counts.sum()), (1 << scale) - len(symbols)
    if room < 0:
        raise ValueError("more distinct ids than table slots")
    share = counts[symbols].astype(np.float64) * room / total
    freqs = np.floor(share).astype(np.int64)
    rest = room - int(freqs.sum())
    freqs[np.lexsort((symbols, freqs - share))[:rest]] += 1
    return symbols.astype(np.uint32), (freqs + 1).astype(np.uint32)


class Coder:
    """Encodes and decodes blocks under one frequency table."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, scale: int = SCALE) -> None:
        self.scale = np.uint64(scale)
        self.mask = np.uint64((1 << scale) - 1)
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.freq, self.base = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[symbols] = freqs
        self.base[symbols] = np.cumsum(freqs) - freqs
        self.slot = np.repeat(symbols.astype(np.uint16 if size <= 1 << 16 else np.uint32), freqs)

    def encode(self, ids: np.ndarray, lanes: int, every: int = CHECKPOINT_EVERY) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(payload words, states at the start of decoding, checkpoints)."""
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        limit = np.uint64(63) - self.scale
        shift = np.uint64(32)
        for t in range(steps - 1, -1, -1):
            part = ids[t * lanes : (t + 1) * lanes]
            if (t + 1) % every == 0 and t + 1 < steps:
                marks.append((t + 1, state.copy()))
            x = state[: len(part)]
            f = self.freq[part]
            full = (x >> limit) >= f
            low = x[full]
            words.append(low.astype(np.uint32))
            x = x.copy()
            x[full] = low >> shift
            q = x // f
            state[: len(part)] = (q << self.scale) + (x - q * f) + self.base[part]
        words.reverse()
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])]) if words else np.zeros(1, np.int64)
        points = b"".join(np.uint64(at[t]).tobytes() + s.tobytes() for t, s in reversed(marks))
        return (np.concatenate(words) if words else np.zeros(0, np.uint32)), state, points

    def decode(self, words: np.ndarray, state: np.ndarray, n: int, points: bytes = b"", every: int = CHECKPOINT_EVERY) -> np.ndarray:
        """The n ids. Each stretch of `every` steps begins with the states and the place that its checkpoint gives; all
        stretches take a step at once."""
        lanes = len(state)
        marks = [(0, state), *checkpoint_states(points, lanes)]
        position = np.array([m[0] for m in marks], np.int64)
        state = np.concatenate([m[1] for m in marks])
        last = (len(marks) - 1) * every * lanes  # ids before the last stretch
        steps = every if len(marks) > 1 else -(-n // lanes)
        out = np.empty((len(marks), steps * lanes), self.slot.dtype)
        bounds = np.arange(len(marks) + 1) * lanes
        shift = np.uint64(32)
        for t in range(steps):
            own = max(0, min(lanes, n - last - t * lanes))  # lanes of the last stretch that are at work
            x = state[: len(state) - lanes + own]
            slot = x & self.mask
            ids = self.slot[slot]
            step = out[:, t * lanes : (t + 1) * lanes]
            step[:-1] = ids[: len(state) - lanes].reshape(-1, lanes)
            step[-1, :own] = ids[len(state) - lanes :]
            x = self.freq[ids] * (x >> self.scale) + slot - self.base[ids]
            need = np.flatnonzero(x < _LOW)
            before = np.searchsorted(need, bounds)
            count = np.diff(before)
            place = np.repeat(position - before[:-1], count) + np.arange(len(need))
            x[need] = (x[need] << shift) | words[place]
            position += count
            state[: len(x)] = x
        return out.ravel()[:n]


def checkpoint_states(points: bytes, lanes: int) -> list[tuple[int, np.ndarray]]:
    """[(payload position, states)], in order of steps."""
    flat = np.frombuffer(points, np.uint64).reshape(-1, lanes + 1)
    return [(int(r[0]), r[1:]) for r in flat]


def tokenize(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (uint32 little endian; the end id last), in the input's partitions."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, at in Encoder.of(path).parts(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(at)), _runs(ids.astype("<u4"), at)], names=["doc_id", "n_tokens", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _runs(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """The runs ids[at[k]:at[k + 1]] (uint32) as binary values."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(ids)]).cast(pa.binary())


def encode_container(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lanes: int = LANES, block_tokens: int = BLOCK_TOKENS, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of the container, ascending in doc_id by (shard, part). Ranges of doc_id (and, within one doc_id, of the
    texts' hashes) are dealt out, so that a hot source is spread; the texts cross one exchange, and the range bounds are
    sampled from the scan alone."""
    path = path or default_path()
    texts = id_text(docs, id_col, text_col)
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(texts) // range_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = texts.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def row(shard: int, part: int, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        symbols, freqs = table_of(counts)
        coder = Coder(symbols, freqs)
        blocks, crc = [], 0
        for first in range(0, len(ids), block_tokens):
            own = ids[first : first + block_tokens]
            k = int(min(lanes, max(1, len(own) // 64)))
            words, state, points = coder.encode(own, k)
            payload = words.astype("<u4").tobytes()
            crc = zlib.crc32(own.astype("<u4").tobytes(), crc)
            blocks.append({"lanes": k, "n_tokens": len(own), "states": state.astype("<u8").tobytes(), "checkpoints": points, "payload": payload, "payload_crc32": zlib.crc32(payload)})
        values = {"shard": shard, "part": part, "doc_ids": doc_ids, "doc_tokens": sizes.tolist(), "n_tokens": len(ids), "ids_crc32": crc, "symbols": symbols.astype("<u4").tobytes(), "freqs": freqs.astype("<u4").tobytes(), "blocks": blocks}
        return pa.RecordBatch.from_pylist([values], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part, held = TaskContext.get().partitionId(), 0, 0
        encoder = Encoder.of(path)
        doc_ids, parts, lengths, counts = [], [], [], np.zeros(encoder.size, np.int64)
        for keys, own, own_at in encoder.parts(batches):
            doc_ids += keys.to_pylist()
            parts.append(own.astype(encoder.kind))
            lengths.append(np.diff(own_at))
            counts += np.bincount(own, minlength=encoder.size)
            held += len(own)
            if held >= shard_bytes // 4:  # about 4 bytes an id; a slice is the least that is added
                yield row(shard, part, doc_ids, np.concatenate(lengths), np.concatenate(parts), counts)
                part, held, doc_ids, parts, lengths, counts = part + 1, 0, [], [], [], np.zeros(encoder.size, np.int64)
        if doc_ids:
            yield row(shard, part, doc_ids, np.concatenate(lengths), np.concatenate(parts), counts)

    return ordered.mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("symbols", pa.binary()), ("freqs", pa.binary()),
        ("blocks", pa.list_(pa.struct([("lanes", pa.int32()), ("n_tokens", pa.int64()), ("states", pa.binary()), ("checkpoints", pa.binary()), ("payload", pa.binary()), ("payload_crc32", pa.int64())]))),
    ]
)


def starts_of(counts: DataFrame) -> DataFrame:
    """shard, part, start of (shard, part, n_tokens): running sums in two levels, so that no task holds all rows."""
    named = counts.withColumn("run", F.floor(F.col("shard") / 1024))
    runs = named.groupBy("run").agg(F.sum("n_tokens").alias("n"))
    before = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("run_start"))
    inner = Window.partitionBy("run").orderBy("shard", "part")
    placed = named.select("run", "shard", "part", (F.sum("n_tokens").over(inner) - F.col("n_tokens")).alias("inner_start"))
    return placed.join(before, "run").select("shard", "part", (F.col("run_start") + F.col("inner_start")).alias("start"))


def write_tokens(docs: DataFrame, folder: str, **options) -> str:
    """Writes the container to `folder` (must not exist); returns it."""
    encode_container(docs, **options).write.parquet(f"{folder}/data")
    starts_of(docs.sparkSession.read.schema(SCHEMA).parquet(f"{folder}/data").select("shard", "part", "n_tokens")).write.parquet(f"{folder}/starts")
    return folder


def decode_row(r: dict) -> np.ndarray:
    """The ids (uint32) of one row, each checksum compared."""
    coder = Coder(np.frombuffer(r["symbols"], "<u4"), np.frombuffer(r["freqs"], "<u4"))
    out = np.empty(r["n_tokens"], "<u4")
    at = 0
    for b in r["blocks"]:
        if zlib.crc32(b["payload"]) != b["payload_crc32"]:
            raise ValueError("a block's payload does not match its checksum")
        out[at : at + b["n_tokens"]] = coder.decode(np.frombuffer(b["payload"], "<u4"), np.frombuffer(b["states"], "<u8"), b["n_tokens"], b["checkpoints"])
        at += b["n_tokens"]
    if at != len(out) or zlib.crc32(out) != r["ids_crc32"]:
        raise ValueError("a row's ids do not match their checksum")
    return out


def read_tokens(spark: SparkSession, folder: str, digests: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (uint32 little endian), or ids_crc32 in their place,
    from the files. What doesn't match its checksum raises. Only documents' rows meet `starts`, never payloads."""
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/data")
    starts = spark.read.schema("shard int, part int, start long").parquet(f"{folder}/starts")
    name, kind = ("ids_crc32", "long") if digests else ("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {k: b.column(k)[i].as_py() for k in b.schema.names}
                ids, sizes, doc_ids = decode_row(r), np.asarray(r["doc_tokens"], np.int64), r["doc_ids"]
                shard, part = r["shard"], r["part"]
                del r
                at = np.concatenate([[0], np.cumsum(sizes)])
                first = 0
                while first < len(sizes):  # about 4 MB of ids at once
                    last = max(first + 1, int(np.searchsorted(at, at[first] + (1 << 20), side="right")) - 1)
                    own, n = at[first : last + 1], last - first
                    value = pa.array([zlib.crc32(ids[x:y]) for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)], pa.int64()) if digests else _runs(ids[own[0] : own[-1]], own - own[0])
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(doc_ids[first:last], pa.int64()), pa.array(own[:-1]), pa.array(sizes[first:last]), value], names=["shard", "part", "doc_id", "inner", "n_tokens", name])
                    first = last

    found = rows.mapInArrow(run, f"shard int, part int, doc_id long, inner long, n_tokens long, {name} {kind}")
    return found.join(bounded(starts, broadcast_rows), ["shard", "part"]).select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", name)


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "tokens"))
    return read_tokens(spark, folder, digests=True)
