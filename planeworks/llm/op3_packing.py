"""Packing documents' token ids into windows by Karmarkar-Karp multiway differencing.

The documents of an input partition are taken in groups of about `group_windows` windows. Within a group the pieces
(whole documents where they fit) are partitioned among m windows by the largest differencing method: every piece
begins as a partial partition (its size, 0, ..., 0); the two partial partitions with the largest spread are merged,
the largest part of one with the smallest of the other, until one is left. m starts at the least count that could
hold the group and rises whenever a window exceeds its capacity. Where a group's pieces are so long that the rise would
cost more padding than `slack`, the longest are halved first (a document may be cut anywhere).

Partial partitions are sparse: single pieces are a sorted stream, a partition of fewer than m pieces is the list of
its pieces, and only partitions in which every window has a part hold m sums. A group costs memory in proportion to its
pieces, also if these are 500,000 texts of one id.

Groups are formed within input partitions, so nothing is shuffled, memory is bounded by a group, and a lost task
repeats its own groups with the same ids. sequence_id is (input partition << 36) + a count within it.

Defined cases: a null or empty text is the end id alone; null ids and repeated rows are packed as any row; a document
longer than a window fills windows of its own and its rest is a piece; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeworks.llm.text import id_text, spread
from planeworks.llm.tokens import Encoder, default_path

CAPACITY = 2048
GROUP_WINDOWS = 256
#: Share of a group's capacity that may stay empty before long pieces are halved.
SLACK = 0.01


def differencing(sizes: np.ndarray, m: int) -> list[np.ndarray]:
    """Indices of `sizes` by window: m near-equal windows by Karmarkar-Karp multiway differencing."""
    n = len(sizes)
    by = np.argsort(-sizes, kind="stable")
    stream = sizes[by].tolist()
    up = [-1] * n  # merged parts form trees: the tree of which each is part
    at = 0  # pieces stream[at:] are partial partitions of their own
    # (-spread, order of making, descending sums, their trees): of m windows, or of fewer while the others are empty
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    order = 0

    def push(sums: np.ndarray, trees: np.ndarray) -> None:
        nonlocal order
        if len(sums) == m:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), order, sums, trees))
        order += 1

    def merge(a: tuple, b: tuple) -> None:
        (x, p), (y, q) = a[2:], b[2:]
        if len(x) + len(y) <= m:
            sums, trees = np.concatenate([x, y]), np.concatenate([p, q])
        else:  # x from the largest on, y from the smallest on; they meet in the windows that both have parts in
            both = len(x) + len(y) - m
            lone = len(x) - both
            y, q = y[::-1], q[::-1]
            new = len(up) + np.arange(both)
            up.extend([-1] * both)
            for k, i, j in zip(new.tolist(), p[lone:].tolist(), q[:both].tolist(), strict=True):
                up[i] = up[j] = k
            sums = np.concatenate([x[:lone], x[lone:] + y[:both], y[both:]])
            trees = np.concatenate([p[:lone], new, q[both:]])
        rank = np.argsort(-sums, kind="stable")
        push(sums[rank], trees[rank])

    while len(heap) + n - at > 1:
        widest = -heap[0][0] if heap else -1
        if at < n and stream[at] >= widest:
            # pieces stay the partitions of largest spread until their windows run out or another's spread is larger
            stop = at + 1
            while stop < n and stop - at < m and stream[stop] >= widest:
                stop += 1
            push(np.array(stream[at:stop], np.int64), by[at:stop].astype(np.int64))
            if stop - at == 1 and len(heap) > 1:
                merge(heapq.heappop(heap), heapq.heappop(heap))
            at = stop
            continue
        first = heapq.heappop(heap)
        second = -heap[0][0] if heap else -1
        if at < n and stream[at] >= second:
            if len(first[2]) < m:
                stop = at + 1
                while stop < n and stop - at < m - len(first[2]) and stream[stop] >= second:
                    stop += 1
                push(np.concatenate([first[2], np.array(stream[at:stop], np.int64)]), np.concatenate([first[3], by[at:stop]]))
                at = stop
                continue
            # the next pieces go one by one to the window with the least sum, while this spread is one of the two largest
            least = [(v, k) for v, k in zip(first[2][::-1].tolist(), first[3][::-1].tolist(), strict=True)]
            most = least[-1][0]
            own = most - least[0][0]
            while at < n and stream[at] >= second and (own >= stream[at] or own >= max(second, stream[at + 1] if at + 1 < n else -1)):
                v, k = least[0]
                new = len(up)
                up.append(-1)
                up[k] = up[by[at]] = new
                heapq.heapreplace(least, (v + stream[at], new))
                most = max(most, v + stream[at])
                own = most - least[0][0]
                at += 1
            least.sort(reverse=True)
            push(np.array([v for v, _ in least], np.int64), np.array([k for _, k in least], np.int64))
            continue
        merge(first, heapq.heappop(heap))
    window = np.full(len(up), -1, np.int64)
    roots = heap[0][3] if heap else by
    window[roots] = np.arange(len(roots))
    above = np.array(up, np.int64)
    for k in range(len(up) - 1, n - 1, -1):  # a tree is made after its parts
        if above[k] >= 0:
            window[k] = window[above[k]]
    leaf = np.flatnonzero(above[:n] >= 0)
    window[leaf] = window[above[leaf]]
    rank = np.argsort(window[:n], kind="stable")
    return np.split(rank, np.searchsorted(window[:n][rank], np.arange(1, m)))


def pack(lengths: np.ndarray, capacity: int = CAPACITY, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """(document, start, length) of pieces that hold every id of documents with these lengths exactly once, and each
    piece's window; the windows ascend."""
    whole = lengths // capacity
    doc = np.repeat(np.arange(len(lengths)), whole)
    filled = np.stack([doc, spread(whole) * capacity, np.full(len(doc), capacity)], axis=1).astype(np.int64)
    rest = np.flatnonzero(lengths % capacity)
    pieces = np.stack([rest, whole[rest] * capacity, lengths[rest] % capacity], axis=1).astype(np.int64)
    total = int(pieces[:, 2].sum())
    if not total:
        return filled, np.arange(len(filled))
    while True:
        m = least = -(-total // capacity)
        sizes = pieces[:, 2]
        while True:
            found = differencing(sizes, m)
            over = max(int(sizes[w].sum()) for w in found) - capacity
            if over <= 0:
                break
            m += max(1, over * m // (4 * capacity))
        longest = int(sizes.max())
        if m - least <= max(1, slack * least) or longest == 1:
            break
        long = sizes > longest // 2
        a, b = pieces[long], pieces[long]
        a[:, 2] //= 2
        b[:, 1] += a[:, 2]
        b[:, 2] -= a[:, 2]
        pieces = np.concatenate([pieces[~long], a, b])
    windows = [w for w in found if len(w)]
    order = np.concatenate(windows)
    number = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
    return np.concatenate([filled, pieces[order]]), np.concatenate([np.arange(len(filled)), len(filled) + number])


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS, slack: float = SLACK) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (uint32 little endian)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, count = Encoder.of(path), TaskContext.get().partitionId() << 36

        def emit(keys: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            nonlocal count
            lengths = np.diff(at)
            flat, sequence = pack(lengths, capacity, slack)
            run_up = np.cumsum(flat[:, 2]) - flat[:, 2]
            first = np.flatnonzero(np.diff(sequence, prepend=-1))
            offset = run_up - run_up[first][sequence]
            place = at[flat[:, 0]] + flat[:, 1]
            end = np.concatenate([[0], np.cumsum(flat[:, 2])])
            taken = ids[np.repeat(place - end[:-1], flat[:, 2]) + np.arange(end[-1])].astype("<u4")
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(flat), [None, pa.py_buffer(end * 4), pa.py_buffer(taken)]).cast(pa.binary())
            out = pa.RecordBatch.from_arrays(
                [keys.take(pa.array(flat[:, 0])), pa.array(flat[:, 1]), pa.array(flat[:, 2]), pa.array(lengths[flat[:, 0]]), pa.array(sequence + count), pa.array(offset), raw],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            count += len(first)
            return out

        held: tuple[pa.Array, np.ndarray, np.ndarray] | None = None
        for keys, ids, at in encoder.parts(batches):
            if held is not None:
                keys, ids, at = pa.concat_arrays([held[0], keys]), np.concatenate([held[1], ids]), np.concatenate([held[2], held[2][-1] + at[1:]])
                held = None
            first = 0
            while first < len(keys):
                last = int(np.searchsorted(at, at[first] + group_windows * capacity, side="left"))
                if last > len(keys):
                    held = (keys.slice(first), ids[at[first] :].copy(), at[first:] - at[first])
                    break
                last = max(last, first + 1)
                yield emit(keys.slice(first, last - first), ids[at[first] : at[last]], at[first : last + 1] - at[first])
                first = last
        if held is not None and len(held[0]):
            yield emit(*held)

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
