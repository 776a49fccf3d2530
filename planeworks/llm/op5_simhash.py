"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits, one for each bit set in over half of its shingles' XXH64 values. Two fingerprints link if
they differ in at most `distance` bits. To find links, 63 of the bits are dealt into `parts` parts of 7-bit blocks.
The code words of the perfect (7,4) Hamming code, block by block, are the anchors of a part: every value is within
one bit a block (the covering radius) of exactly one anchor, its home. Two linked fingerprints differ by at most
distance // parts bits in some part; so if each is kept at its home and replicated to every anchor that is the home of
some value within those bits (anchors within covering radius plus threshold, less those no such value calls home),
the two meet at an anchor of that part. Fingerprints are compared there, 64 bits against 64, and nothing is missed.

Only distinct fingerprints take part: copies of a text cost one row. At an anchor, links already implied by earlier
ones aren't sought again, so a dense group costs about its size and gives a spanning forest, never all its pairs.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and links like any other; texts of
fewer words than a shingle are one shingle; a null doc_id is reported as a row of its own kind and is never a
component_id unless its whole component has none; repeated rows stay repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeworks.llm.components import connected_components
from planeworks.llm.text import LOWER_BYTES, SPACE, bounded, give_back, id_text, map_slices, shared_dir, words_of

SHINGLE, DISTANCE, PARTS, SEED = 4, 4, 3, 42
#: Comparisons held at once (about 30 bytes each), and rows (17 bytes each) that a task of comparisons is meant for.
COMPARISONS, BUCKET_ROWS = 1 << 18, 1 << 20
#: Rows of ids that are broadcast at most, once counted.
BROADCAST_ROWS = 500_000


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 for each row."""
    from xxhash import xxh64_intdigest

    low = np.frombuffer(data.tobytes().translate(LOWER_BYTES), np.uint8).copy()
    starts, ends, before = words_of(low, offsets, ~SPACE)
    out = np.zeros(len(offsets) - 1, np.uint64)
    per = np.diff(before)
    if len(starts) == 0:
        return out
    # words of a row joined by one space
    inside = np.zeros(len(low) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    keep = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    is_last = np.zeros(len(starts), bool)
    is_last[before[1:][per > 0] - 1] = True
    gaps = ends[~is_last]
    low[gaps], keep[gaps] = 0x20, True
    joined = low[keep].tobytes()
    sizes = ends - starts
    begin = np.cumsum(sizes + ~is_last) - (sizes + ~is_last)
    end = begin + sizes
    count = np.where(per >= shingle, per - shingle + 1, np.minimum(per, 1))
    row = np.repeat(np.arange(len(per)), count)
    first = np.repeat(before[:-1] - (np.cumsum(count) - count), count) + np.arange(len(row))
    last = np.minimum(first + shingle, before[1:][row]) - 1
    values = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(begin[first].tolist(), end[last].tolist(), strict=True)], np.uint64)
    at = np.cumsum(count) - count
    full = np.flatnonzero(count)
    for i in range(0, len(full), 4096):
        rows = full[i : i + 4096]
        own = values[at[rows[0]] : at[rows[-1]] + count[rows[-1]]]
        ones = np.add.reduceat(np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), at[rows] - at[rows[0]], axis=0, dtype=np.int32)
        out[rows] = np.packbits(2 * ones > count[rows][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def make():
        return lambda keys, data, offsets: {"doc_id": keys, "fp": pa.array(fingerprints_of(data, offsets, shingle, seed).view(np.int64))}

    return map_slices(id_text(docs, id_col, text_col), make, "doc_id long, fp long", 1 << 20)


def _codes(most: int) -> tuple[np.ndarray, list[list[list[int]]]]:
    """(home code word's number of each 7-bit value, per value and number of flips the further code words reached)."""
    words = [w for w in range(128) if not (_parity(w & 0b1010101) or _parity(w & 0b1100110) << 1 or _parity(w & 0b1111000) << 2)]
    home = np.array([min(range(16), key=lambda k: (v ^ words[k]).bit_count()) for v in range(128)])
    reach: list[list[list[int]]] = []
    for v in range(128):
        seen, levels = {int(home[v])}, [[int(home[v])]]
        for f in range(1, most + 1):
            new = sorted({int(home[v ^ x]) for x in range(128) if x.bit_count() == f} - seen)
            seen |= set(new)
            levels.append(new)
        reach.append(levels)
    return home, reach


def _parity(x: int) -> int:
    return x.bit_count() & 1


def anchors_of(fps: np.ndarray, blocks: list[int], most: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is it the home) of every anchor that a fingerprint is kept at, for one part."""
    home, reach = _codes(most)
    rows, keys, cost = np.arange(len(fps)), np.full(len(fps), salt, np.int64), np.zeros(len(fps), np.int64)
    for b in blocks:
        value = ((fps >> np.uint64(7 * b)) & np.uint64(127)).astype(np.int64)[rows]
        out = []
        for f in range(most + 1):
            width = max((len(reach[v][f]) for v in range(128)), default=0)
            table = np.array([reach[v][f] + [-1] * (width - len(reach[v][f])) for v in range(128)], np.int64).reshape(128, width)
            for c in range(width):
                word = table[value, c]
                ok = np.flatnonzero((word >= 0) & (cost + f <= most))
                out.append((rows[ok], keys[ok] * 16 + word[ok], cost[ok] + f))
        rows, keys, cost = (np.concatenate(x) for x in zip(*out, strict=True))
    return rows, keys, cost == 0


def replicate(fps: DataFrame, distance: int = DISTANCE, parts: int = PARTS) -> DataFrame:
    """fp, anchor, home of distinct fingerprints."""
    deal = [list(x) for x in np.array_split(np.arange(9), parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False)
            for salt, blocks in enumerate(deal):
                rows, keys, home = anchors_of(values.view(np.uint64), blocks, distance // parts, salt + 1)
                yield pa.RecordBatch.from_arrays([pa.array(values[rows]), pa.array(keys), pa.array(home)], names=["fp", "anchor", "home"])

    return fps.mapInArrow(run, "fp long, anchor long, home boolean")


class _Forest:
    """Labels 0..n-1 that unions lower."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def labels(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return self.up
            self.up = nxt

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.labels()[a], self.labels()[b]
            differ = x != y
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(x, y)[differ], np.minimum(x, y)[differ])


def link_within(fp: np.ndarray, anchor: np.ndarray, home: np.ndarray, distance: int, block: int = COMPARISONS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (fp, fp) of the links found at these anchors. `block` bounds the comparisons held at once."""
    values, code = np.unique(fp, return_inverse=True)
    forest = _Forest(len(values))
    bits = values.view(np.uint64)
    order = np.argsort(anchor, kind="stable")
    code, home, anchor = code[order], home[order], anchor[order]
    cut = np.flatnonzero(np.diff(anchor, prepend=anchor[:1] - 1))
    size = np.diff(np.append(cut, len(anchor)))
    homes = np.add.reduceat(home.astype(np.int64), cut) if len(cut) else size
    small = (size * homes <= block // 64) & (homes > 0) & (size > 1)
    group = np.flatnonzero(small)
    # many small anchors at once: every home against every fingerprint of its anchor
    work = np.cumsum((size * homes)[group])
    for lo in range(0, int(work[-1]) if len(work) else 0, block):
        g = group[(work > lo) & (work <= lo + block)]
        if not len(g):
            continue
        pick = np.repeat(cut[g], size[g]) + np.arange(size[g].sum()) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
        owner = np.repeat(np.arange(len(g)), size[g])
        h = pick[home[pick]]
        ho = owner[home[pick]]
        left = np.repeat(h, size[g][ho])
        right = np.repeat(cut[g][ho], size[g][ho]) + np.arange(len(left)) - np.repeat(np.cumsum(size[g][ho]) - size[g][ho], size[g][ho])
        near = np.bitwise_count(bits[code[left]] ^ bits[code[right]]) <= distance
        forest.union(code[left[near]], code[right[near]])
    for g in np.flatnonzero(~small & (homes > 0) & (size > 1)):
        own = code[cut[g] : cut[g] + size[g]]
        at_home = own[home[cut[g] : cut[g] + size[g]]]
        step = max(1, block // len(own))
        i = 0
        while i < len(at_home):
            labels = forest.labels()
            # homes that share one component need no look at fingerprints already in it
            mine = at_home[i : i + step] if i else at_home[:1]
            rest = own[labels[own] != labels[mine[0]]] if (labels[mine] == labels[mine[0]]).all() else own
            for j in range(0, len(rest), block):
                near = np.bitwise_count(bits[mine][:, None] ^ bits[rest[j : j + block]][None, :]) <= distance
                a, b = np.nonzero(near)
                forest.union(mine[a], rest[j : j + block][b])
            i += len(mine)
    root = forest.labels()
    own = np.flatnonzero(root != np.arange(len(values)))
    return values[own], values[root[own]]


def links(fps: DataFrame, distance: int = DISTANCE, parts: int = PARTS, n: int | None = None) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp; n of them, counted if not given) whose closure is that of all links. Anchors are dealt
    into buckets of about BUCKET_ROWS rows; `copies` is how many anchors keep a fingerprint on average."""
    spark = fps.sparkSession
    n = fps.count() if n is None else n
    some = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    copies = sum(len(anchors_of(some, list(x), distance // parts, 1)[0]) for x in np.array_split(np.arange(9), parts)) // 1000
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * copies // BUCKET_ROWS))
    dealt = replicate(fps, distance, parts).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int"))

    def join(table: pa.Table) -> pa.Table:
        a, b = link_within(table["fp"].to_numpy(), table["anchor"].to_numpy(), table["home"].to_numpy(zero_copy_only=False), distance)
        give_back()
        return pa.table({"a": a, "b": b})

    return dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, parts: int = PARTS, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable over links, the document itself included). What is joined is
    written first, so that both sides of each join are plain scans, whose hot keys Spark can split at run time."""
    spark = docs.sparkSession

    def kept(table: DataFrame, name: str) -> DataFrame:
        folder = shared_dir(spark, name)
        table.write.parquet(folder)
        return spark.read.parquet(folder)

    found = kept(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    least = kept(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    n = least.count()
    spread = least.select("fp").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS)))
    joined = connected_components(links(spread, distance, parts, n))
    member = kept(least.join(joined, least.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "members")
    roots = kept(member.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    return found.join(member.join(roots, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The rows of docs, all columns, but those of documents that aren't their component's least doc_id. Rows that share
    a doc_id are one document; rows without one stay. An empty table stays empty. The ids that go are broadcast if they
    are at most `broadcast_rows`; beyond that the rows are joined with them by id."""
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    folder = shared_dir(docs.sparkSession, "near-copies")
    gone.write.parquet(folder)
    gone = bounded(docs.sparkSession.read.parquet(folder), broadcast_rows)
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
