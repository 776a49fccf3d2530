"""Incremental deduplication of word windows over a log-structured fingerprint index.

Every word covered by a window of `length` words whose sequence also starts earlier (smaller doc_id, or the same
document further ahead) is removed. Documents come in batches of ascending doc_id. The index (windows.Index) keeps sorted
immutable runs of the fingerprints of all batches before: hashes of the `gram`-word windows that anchor the
`length`-word windows, with the shards that have them. A batch's sorted runs are merge-joined with the runs of history;
candidates on either side, of history too, are verified word by word against each other (`resolve_words`: equal hashes
propose, equal words decide); then the batch's runs join the index, where two runs of one level are compacted into one
of the next. A later batch costs its own size and another look at the shards of history that have anchors in common.

`add_batch` is the incremental form: one batch against all that its index has seen. `remove_repeated_windows` adds a
table in `batches` ranges of doc_id.

Defined cases: null texts have no words; texts shorter than a window keep everything; a null doc_id counts as the
largest; rows that share a doc_id and their place are told apart by their order in the shard, copies included; what a
batch holds is later than all of history, whatever its doc_ids; an empty table gives no rows. White space between kept
words becomes one space.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from planeworks.llm.op1_suffix_dedup import covered
from planeworks.llm.text import SPACE, dictionary, id_text, text_bytes, words_of
from planeworks.llm.windows import Index, Rule, Sequence, find_repeats, gram_hashes

LENGTH, GRAM = 20, 8
#: Batches in which a whole table is added.
BATCHES = 2
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from xxhash import xxh64_intdigest

    code, distinct = dictionary(data, starts, ends)
    return np.array([xxh64_intdigest(w) for w in distinct.to_pylist()], np.uint64)[code] if len(code) else np.zeros(0, np.uint64)


def _read(keys: np.ndarray, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> Sequence:
    starts, ends, before = words_of(data, offsets, ~SPACE)
    values = word_hashes(data, starts, ends)
    # words joined by one space each, whatever stood between them
    sizes = ends - starts
    end = np.cumsum(sizes + 1) - 1
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.ones(len(out), bool)
    inside[end] = False
    out[inside] = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)] if len(data) else data
    return Sequence(keys, ids, out.tobytes(), before, values, end - sizes, end)


def resolve_words(content: np.ndarray, sizes: np.ndarray, docs: np.ndarray, places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(flag of each window of each piece: the same words also start earlier than in this piece; windows a piece).

    The windows' fingerprints are sorted, earlier windows first; every window is then compared, word by word, with the
    first of its fingerprint. Those that differ in words, for all their equal fingerprints, are compared among
    themselves in the same way until none are left."""
    ends = np.cumsum(sizes)
    at = ends - sizes
    starts, stops, before = words_of(content, np.append(at, ends[-1]), ~SPACE)
    code, _ = dictionary(content, starts, stops)
    count = np.diff(before) - length + 1
    piece = np.repeat(np.arange(len(sizes)), count)
    first = np.repeat(before[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    prints = window_prints(code, length)[first]
    order = np.lexsort((places[piece] + first - before[piece], docs[piece], prints))
    flags = np.zeros(len(first), bool)
    while len(order):
        new = np.concatenate([[True], prints[order][1:] != prints[order][:-1]])
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        same = np.ones(len(order), bool)
        for k in range(length):
            same &= code[first[order] + k] == code[first[lead] + k]
        flags[order[same & ~new]] = True
        order = order[~same]
    return flags, count


def window_prints(code: np.ndarray, length: int) -> np.ndarray:
    """A fingerprint of each `length` consecutive word codes."""
    with np.errstate(over="ignore"):
        return gram_hashes((code.astype(np.uint64) + np.uint64(1)) * _SPREAD, length)


def _finish(length: int, keep_text: bool):
    def finish(s: Sequence | None, flags: np.ndarray | None) -> dict:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        if s is None:
            return {k: pa.array([], t) for k, t in zip(names, kinds, strict=False)}
        n = len(s.values)
        gone = covered(flags, n, length)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[s.rows])
        rest = ~gone
        keep = np.repeat(rest, s.end - s.begin + 1)
        raw = np.frombuffer(s.raw, np.uint8)[keep].tobytes()
        at = np.concatenate([[0], np.cumsum(np.where(rest, s.end - s.begin + 1, 0))])[s.rows].tolist()
        kept = [raw[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]
        out = [s.ids, pa.array(np.diff(s.rows)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        return dict(zip(names, out + [pa.array([x.decode() for x in kept])] * keep_text, strict=True))

    return finish


def _rule(length: int, gram: int, keep_text: bool) -> Rule:
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    resolve = lambda content, sizes, ids, places: resolve_words(content, sizes, ids, places, length)
    return Rule(length, min(gram, length), True, _read, resolve, _finish(length, keep_text), schema)


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = True, batches: int = BATCHES, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, unless left out, kept (the remaining words)."""
    return find_repeats(docs, _rule(length, gram, keep_text), id_col, text_col, batches=batches, **options)


def new_index(spark: SparkSession, buckets: int = 64, length: int = LENGTH, gram: int = GRAM, keep_text: bool = True, **options) -> Index:
    """An empty index. `buckets` deals out its hashes; each should hold some megabytes once the index is full."""
    return Index(spark, _rule(length, gram, keep_text), buckets, **options)


def add_batch(index: Index, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As remove_repeated_windows, of one batch against all batches before, which count as earlier."""
    texts = id_text(docs, id_col, text_col)
    return index.add(texts, text_bytes(texts))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
