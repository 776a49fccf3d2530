"""Suffix-array deduplication of byte strings across documents.

Every byte covered by a `length`-byte string that also starts in a document with a smaller doc_id is removed. Strings
that cannot occur twice are set aside by their anchors first (windows.py); the rest meets in buckets, where

* the bucket's bytes are suffix sorted by Larsson-Sadakane refinement in numpy: suffixes sorted by their first h bytes
  are refined to 2h by the ranks h further on, and only groups that are still tied are sorted again;
* Kasai's scan gives the common prefixes of neighbours in that order (many stretches of the text at once, eight bytes a
  comparison); runs of neighbours that share `length` bytes are the classes of equal strings;
* a bucket of more than `part_bytes` is sorted in parts, whose sorted strings are merged by binary search, so memory
  is bounded and strings in different suffix arrays meet.

Defined cases: null texts are empty; texts shorter than `length` keep everything; a null doc_id counts as the largest;
rows that share a doc_id don't remove from each other, and copies of a row are all removed from alike; an empty table
gives no rows. Removal works on bytes, so what is left may split a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from planeworks.llm.windows import Rule, Sequence, find_repeats

LENGTH, GRAM = 50, 24
PART_BYTES = 1 << 20
_BITS = 21


def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte, by the splitmix rule."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_VALUES = _byte_values()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of text (at most 2**21 bytes), sorted by the suffixes; a suffix that begins another comes first."""
    n = len(text)
    if n > 1 << _BITS:
        raise ValueError("text too long for one suffix array")
    low = np.uint64((1 << _BITS) - 1)
    up, up2 = np.uint64(_BITS), np.uint64(2 * _BITS)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(4, np.uint64)])
    key = padded[:n]
    for j in range(1, 4):  # four bytes, each with a ninth bit for the end
        key = (key << np.uint64(9)) | padded[j : n + j]
    order = np.sort((key << up) | np.arange(n, dtype=np.uint64))
    head = order >> up
    place = (order & low).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = head[1:] != head[:-1]
    rank = np.zeros(n + 1, np.uint64)  # the end ranks 0; a group ranks by its first place in the order, from 1 on
    first = np.flatnonzero(new)
    group = np.repeat(first, np.diff(np.append(first, n)))
    rank[place] = (group + 1).astype(np.uint64)
    h = 4
    while h < n:
        new_next = np.append(new[1:], True)
        tied = np.flatnonzero(~(new & new_next))
        if not len(tied):
            break
        own = place[tied]
        ahead = rank[np.minimum(own + h, n)]
        packed = np.sort((rank[own] - np.uint64(1) << up2) | (np.minimum(ahead, low) << up) | own.astype(np.uint64))
        own = (packed & low).astype(np.int64)
        place[tied] = own
        head = packed >> up
        fresh = np.ones(len(tied), bool)
        fresh[1:] = head[1:] != head[:-1]
        new[tied] = fresh
        first = np.flatnonzero(fresh)
        rank[own] = np.repeat(tied[first] + 1, np.diff(np.append(first, len(tied)))).astype(np.uint64)
        h *= 2
    return place


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """lcp[i]: common prefix of suffixes order[i - 1] and order[i], at most cap; lcp[0] = 0. Kasai's scan in text order,
    one stretch of the text a lane: the next place's prefix is at least this one's less one."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (n + cap + 8, 8), (1, 1)).copy().view("<u8").ravel()
    lanes = max(1, min(lanes, n // 64))
    stretch = -(-n // lanes)
    out = np.zeros(n, np.int64)
    h = np.zeros(lanes, np.int64)
    start = np.arange(lanes) * stretch
    for t in range(stretch):
        i = start + t
        live = i < n
        if not live.all():
            i, h = i[live], h[live]
            start = start[live]
        j = before[i]
        np.maximum(h - 1, 0, out=h)
        h[j < 0] = 0
        room = np.minimum(n - i, n - j)
        np.minimum(room, cap, out=room)
        np.minimum(h, room, out=h)
        go = np.flatnonzero((h < room) & (j >= 0))
        while len(go):
            x = eight[i[go] + h[go]] ^ eight[j[go] + h[go]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            h[go] = np.minimum(h[go] + same, room[go])
            go = go[(same == 8) & (h[go] < room[go])]
        out[i] = h
    return out[order]


def classes_of(text: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of valid windows in suffix order, class of each: equal strings of `length` bytes), classes ascending."""
    order = suffix_array(text)
    lcp = common_prefixes(text, order, length)
    # neighbours that are no windows are bridged: the prefix of two windows is the least one between them
    split = np.cumsum(lcp < length)
    keep = valid[order]
    order, split = order[keep], split[keep]
    return order, np.cumsum(np.concatenate([[False], split[1:] != split[:-1]])) if len(order) else split


def resolve_bytes(content: np.ndarray, sizes: np.ndarray, docs: np.ndarray, places: np.ndarray | None, length: int = LENGTH, part_bytes: int = PART_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(flag of each window of each piece: it occurs in a document smaller than the piece's; windows of each piece)."""
    count = sizes - length + 1
    at = np.cumsum(sizes) - sizes
    out_at = np.cumsum(count) - count
    flags = np.zeros(int(count.sum()), bool)
    ends = np.cumsum(sizes)
    parts, first = [], 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, at[first] + part_bytes, side="right")))
        parts.append((first, last))
        first = last
    found = []
    for first, last in parts:
        text = content[at[first] : ends[last - 1]]
        piece = np.repeat(np.arange(first, last), sizes[first:last])
        offset = np.arange(len(text)) - (at[piece] - at[first])
        order, label = classes_of(text, offset < count[piece], length)
        least = np.full(int(label[-1]) + 1 if len(label) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, label, docs[piece[order]])
        lead = order[np.searchsorted(label, np.arange(len(least)))]
        found.append([out_at[piece[order]] + offset[order], piece[order], label, least, text, lead])
    if len(found) > 1:
        _merge(found, length)
    for window, piece, label, least, _, _ in found:
        flags[window] = least[label] < docs[piece]
    return flags, count


def _merge(found: list[list], length: int) -> None:
    """The least document of each class over all parts: their sorted strings, merged pairwise by binary search."""

    def strings(text: np.ndarray, lead: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(text, length)[lead].copy().view(f"S{length}").ravel()

    runs = [(strings(f[4], f[5]), f[3]) for f in found]
    while len(runs) > 1:
        merged = []
        for k in range(0, len(runs) - 1, 2):
            (a, la), (b, lb) = runs[k], runs[k + 1]
            at = np.searchsorted(a, b)
            same = np.zeros(len(b), bool)
            inside = at < len(a)
            same[inside] = a[at[inside]] == b[inside]
            la = la.copy()
            la[at[same]] = np.minimum(la[at[same]], lb[same])
            both, least = np.concatenate([a, b[~same]]), np.concatenate([la, lb[~same]])
            by = np.argsort(both, kind="stable")
            merged.append((both[by], least[by]))
        runs = merged + ([runs[-1]] if len(runs) % 2 else [])
    every, least = runs[0]
    for f in found:
        f[3] = least[np.searchsorted(every, strings(f[4], f[5]))]


def _read(keys: np.ndarray, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> Sequence:
    return Sequence(keys, ids, data.tobytes(), offsets, _VALUES[data])


def covered(flags: np.ndarray, n: int, length: int) -> np.ndarray:
    """Symbols inside a flagged window, of n."""
    edge = np.zeros(n + 1, np.int32)
    edge[: len(flags)] += flags
    edge[length : length + len(flags)] -= flags
    return np.cumsum(edge[:n]) > 0


def _finish(length: int, keep_text: bool):
    def finish(s: Sequence | None, flags: np.ndarray | None) -> dict:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        if s is None:
            return {k: pa.array([], t) for k, t in zip(names, kinds, strict=False)}
        n = len(s.values)
        gone = covered(flags, n, length)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        cut = s.rows[:-1][s.rows[:-1] < n]
        begins[cut] = gone[cut]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[s.rows])
        removed, spans = total(gone), total(begins)
        rest = np.frombuffer(s.raw, np.uint8)[~gone].tobytes()
        at = np.concatenate([[0], np.cumsum(np.diff(s.rows) - removed)]).tolist()
        kept = [rest[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        out = [s.ids, pa.array(np.diff(s.rows)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())]
        return dict(zip(names, out, strict=False))

    return finish


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = True, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless left out, kept (the remaining bytes)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    resolve = lambda content, sizes, ids, places: resolve_bytes(content, sizes, ids, places, length)
    return find_repeats(docs, Rule(length, min(gram, length), False, _read, resolve, _finish(length, keep_text), schema), id_col, text_col, **options)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
