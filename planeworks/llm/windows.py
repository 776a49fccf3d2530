"""Which windows of a corpus occur earlier in it: the frame shared by the two substring operators.

A window is `length` consecutive symbols of one document. Every window has an anchor: its `gram` consecutive symbols
with the least hash, which depends on the window's content alone, so equal windows have equal anchors. Neighbouring
windows share anchors; the maximal run of windows with one anchor is a piece. `Index.add` takes a batch of documents:

1. the batch is dealt into shards, each small enough for one task's memory; a shard reports its anchors' hashes, sorted.
   These runs are immutable; they are kept in the shared folder if the index is to outlive the batch;
2. a bucket of hashes merge-joins the batch's runs with each other and with the runs of history. It tells each shard of
   the batch which of its hashes occur elsewhere too (a bit each, and a second bit for those in very many shards), and
   each shard of history which of its hashes the batch has. A window without an equal elsewhere mostly stops here;
3. shards, of history too, send the pieces of these anchors, each distinct piece once with the least document it occurs
   in; pieces of very common anchors are sent window by window, dealt by the window's content, so that no bucket holds
   them all;
4. a bucket finds the equal windows among its pieces exactly (`resolve`) and returns a bit a window: does it occur
   earlier than in this piece's least document? What is in an earlier batch is earlier;
5. shards of the batch mark their windows from these bits and finish their documents;
6. runs of one level are compacted into one of the next before another batch comes.

What goes from a shard to a bucket is one row if there is anything, so a shard's rows are at most its hashes, and the
work of a shard doesn't grow with the number of buckets. Texts cross one exchange, which the three steps that read them
share. Nothing goes to the driver but the corpus' size. All steps are functions of their input, so a lost task or
shuffle file is made again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeworks.llm.text import give_back, id_text, row_bytes, shared_dir

#: Bytes of text in a shard, and shards that an anchor must be in to be very common.
SHARD_BYTES = 6 << 20
COMMON_SHARDS = 256
#: A null doc_id counts as the largest one.
NO_ID = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Sequence:
    """A shard's documents in ascending doc_id order, as symbols. Symbol i is bytes begin[i]:end[i] of raw; a document
    is symbols rows[d]:rows[d+1]. For bytes as symbols begin and end are None."""

    keys: np.ndarray
    ids: pa.Array
    raw: bytes
    rows: np.ndarray
    values: np.ndarray
    begin: np.ndarray | None = None
    end: np.ndarray | None = None

    def content(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Bytes of symbols first..last (inclusive)."""
        a, b = (first, last + 1) if self.begin is None else (self.begin[first], self.end[last])
        raw = self.raw
        return [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


@dataclass(frozen=True)
class Rule:
    """length and gram in symbols; by_place: an earlier start in the same document is earlier, too (otherwise only a
    smaller doc_id is); read: (ids, bytes, offsets) -> Sequence; resolve: see step 4; finish: (sequence, flags of window
    starts) -> record batch."""

    length: int
    gram: int
    by_place: bool
    read: Callable
    resolve: Callable
    finish: Callable
    schema: str


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive values (uint64), by doubling."""
    with np.errstate(over="ignore"):
        out, have = None, 0
        power, span, at = values, 1, _ODD
        while span <= k:
            if k & span:
                # out covers the first `have` of the values, this power the next `span`
                out = power if out is None else out[: len(power) - have] * at + power[have:]
                have += span
            if span * 2 <= k:
                power = power[:-span] * at + power[span:]
            span, at = span * 2, at * at
        out = out[: max(0, len(values) - k + 1)]
        out = (out ^ (out >> np.uint64(31))) * _MIX
        return out ^ (out >> np.uint64(29))


def anchors(hashes: np.ndarray, width: int, block: int = 1 << 15) -> np.ndarray:
    """For each window of `width` hashes, the place of its least one (ties within 2**-48: the first)."""
    n = len(hashes) - width + 1
    out = np.empty(max(0, n), np.int32)
    low = np.uint64(0xFFFF)
    steps = np.arange(block + width, dtype=np.uint64)
    for c in range(0, n, block):
        m = min(block, n - c)
        p = (hashes[c : c + m + width - 1] & ~low) | steps[: m + width - 1]
        span = 1
        while span * 2 <= width:
            p = np.minimum(p[:-span], p[span:])
            span *= 2
        if span < width:
            p = np.minimum(p[: len(p) - (width - span)], p[width - span :])
        out[c : c + m] = (p[:m] & low).astype(np.int32) + c
    return out


def pieces_of(s: Sequence, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, hash of the anchor, document) of each piece, in order."""
    n = len(s.values) - rule.length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none
    hashes = gram_hashes(s.values, rule.gram)
    at = anchors(hashes, rule.length - rule.gram + 1)
    edge = np.zeros(n + 1, np.int32)
    inner = s.rows[1:-1]
    inner = inner[(inner > 0) & (inner < len(s.values))]
    np.add.at(edge, np.clip(inner - rule.length + 1, 0, n), 1)
    np.add.at(edge, np.clip(inner, 0, n), -1)
    valid = np.cumsum(edge[:-1]) == 0
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.empty(n, bool)
    stop[-1] = True
    stop[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    return first, last, hashes[at[first]], np.searchsorted(s.rows, first, side="right") - 1


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _cells(group: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(group, places of its members in order) of the groups that have members, ascending."""
    by = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[by], prepend=-1))
    return list(zip(group[by[first]].tolist(), np.split(by, first[1:]), strict=True)) if len(by) else []


def _sequence(table: pa.Table, rule: Rule) -> Sequence:
    give_back()  # what the group before has left
    ids = table["doc_id"].combine_chunks()
    keys = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
    by = np.argsort(keys, kind="stable")
    table = table.take(pa.array(by))
    column = table["text"].cast(pa.large_string()).combine_chunks()
    data, offsets = row_bytes(column)
    return rule.read(keys[by], table["doc_id"].combine_chunks(), data, offsets)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).view(bool)


_RUNS = "bucket int, shard int, hashes binary, multi binary"
_HISTORY = "bucket int, hashes binary, shards binary"
_ANSWERS = "shard int, bucket int, kind int, payload binary"
_SENT = "bucket int, shard int, age int, content binary, bytes binary, docs binary, places binary"
#: Kinds of answers: bits of a batch's hashes, bits of windows, hashes that a batch wants of history.
_MASK, _EARLIER, _WANTED = 0, 1, 2


def _report(rule: Rule, buckets: int):
    def report(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        s = _sequence(table, rule)
        _, _, hashes, doc = pieces_of(s, rule)
        by = np.argsort(hashes, kind="stable")
        h = hashes[by]
        owner = s.keys[doc[by]] if not rule.by_place else np.arange(len(by))
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        differs = np.zeros(len(h), bool)
        differs[1:] = (h[1:] == h[:-1]) & (owner[1:] != owner[:-1])
        multi = np.add.reduceat(differs.astype(np.int64), first) > 0 if len(first) else differs
        distinct = h[first]
        cells = _cells(_bucket(distinct, buckets))
        return pa.table({"bucket": pa.array([b for b, _ in cells], pa.int32()), "shard": pa.array([shard] * len(cells), pa.int32()), "hashes": pa.array([distinct[x].tobytes() for _, x in cells], pa.binary()), "multi": pa.array([_bits(multi[x]) for _, x in cells], pa.binary())})

    return report


def _meet(common: int):
    """The batch's runs of a bucket (_RUNS) with history's (_HISTORY)."""

    def meet(new: pa.Table, old: pa.Table | None = None) -> pa.Table:
        new = new.sort_by("shard")
        runs = [np.frombuffer(x, np.uint64) for x in new["hashes"].to_pylist()]
        values, n = merge_runs(runs)
        out = []
        if old is not None and old.num_rows and len(values):
            for h, own in zip(old["hashes"].to_pylist(), old["shards"].to_pylist(), strict=True):
                h, own = np.frombuffer(h, np.uint64), np.frombuffer(own, np.int32)
                n = n + np.searchsorted(h, values, side="right") - np.searchsorted(h, values)
                hit = _in_sorted(h, values)
                out += [(shard, h[hit][x]) for shard, x in _cells(own[hit].astype(np.int64))]
        shared, often = values[n > 1], values[n > common]
        wanted = [np.unique(h) for _, h in out]
        shards = new["shard"].to_pylist() + [k for k, _ in out]
        payload = [_bits(_unbits(m, len(run)) | _in_sorted(run, shared)) + _bits(_in_sorted(run, often)) for run, m in zip(runs, new["multi"].to_pylist(), strict=True)]
        payload += [h.tobytes() + _bits(_in_sorted(h, often)) for h in wanted]
        bucket = (new if new.num_rows else old)["bucket"][0].as_py()
        kinds = [_MASK] * len(runs) + [_WANTED] * len(wanted)
        return pa.table({"shard": pa.array(shards, pa.int32()), "bucket": pa.array([bucket] * len(shards), pa.int32()), "kind": pa.array(kinds, pa.int32()), "payload": pa.array(payload, pa.binary())})

    return meet


def _candidates(s: Sequence, right: pa.Table, rule: Rule, buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(first window, last window, content, bucket, document) of what this shard sends, repeats included."""
    from xxhash import xxh64_intdigest

    first, last, hashes, doc = pieces_of(s, rule)
    distinct, code = np.unique(hashes, return_inverse=True)
    shared, common = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    places = dict(_cells(_bucket(distinct, buckets)))
    for b, kind, payload in zip(right["bucket"].to_pylist(), right["kind"].to_pylist(), right["payload"].to_pylist(), strict=True):
        if kind == _MASK:
            own = places[b]
            half = len(payload) // 2
            shared[own], common[own] = _unbits(payload[:half], len(own)), _unbits(payload[half:], len(own))
        elif kind == _WANTED:
            n = 8 * len(payload) // 65  # n hashes of 64 bits and n bits, in whole bytes
            own = np.searchsorted(distinct, np.frombuffer(payload, np.uint64, n))
            shared[own], common[own] = True, _unbits(payload[8 * n :], n)
    use = shared[code]
    rare, often = np.flatnonzero(use & ~common[code]), np.flatnonzero(use & common[code])
    count = last[often] - first[often] + 1
    singles = np.repeat(first[often] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    begin, end = np.concatenate([first[rare], singles]), np.concatenate([last[rare], singles])
    owner = np.concatenate([doc[rare], np.repeat(doc[often], count)])
    content = s.content(begin, end + rule.length - 1)
    lone = np.array([xxh64_intdigest(x) for x in content[len(rare) :]], np.uint64)
    return begin, end, content, _bucket(np.concatenate([hashes[rare], lone]), buckets), owner


def _numbered(content: list[bytes], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each piece's content, the first piece, in document order, with each number)."""
    order = np.argsort(begin, kind="stable")
    seen: dict[bytes, int] = {}
    number = np.empty(len(content), np.int64)
    for i in order.tolist():
        number[i] = seen.setdefault(content[i], len(seen))
    lead = np.empty(len(seen), np.int64)
    lead[number[order[::-1]]] = order[::-1]
    return number, lead


def _send(rule: Rule, buckets: int, age: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("bucket", "shard", "age", "content", "bytes", "docs", "places")}
        if left.num_rows and right.num_rows:
            s = _sequence(left, rule)
            begin, _, content, group, owner = _candidates(s, right, rule, buckets)
            _, lead = _numbered(content, begin)
            for b, x in _cells(group[lead]):
                own = lead[x]
                mine = [content[i] for i in own.tolist()]
                row = (b, left["shard"][0].as_py(), age, b"".join(mine), np.fromiter(map(len, mine), np.int32, len(mine)).tobytes(), s.keys[owner[own]].tobytes(), (begin[own] - s.rows[owner[own]]).astype(np.int64).tobytes() if rule.by_place else b"")
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        return pa.table({k: pa.array(v, pa.int32() if k in ("bucket", "shard", "age") else pa.binary()) for k, v in out.items()})

    return send


def _answer(rule: Rule):
    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        sizes = [np.frombuffer(x, np.int32) for x in table["bytes"].to_pylist()]
        docs, places = b"".join(table["docs"].to_pylist()), b"".join(table["places"].to_pylist())
        every = np.concatenate(sizes).astype(np.int64)
        own, at = np.frombuffer(docs, np.int64), np.frombuffer(places, np.int64) if places else None
        # a document's rank: by batch, then by doc_id
        age = np.repeat(table["age"].to_numpy(), [len(x) for x in sizes])
        by = np.lexsort((own, age))
        new = np.concatenate([[False], (own[by][1:] != own[by][:-1]) | (age[by][1:] != age[by][:-1])])
        own = np.empty(len(by), np.int64)
        own[by] = np.cumsum(new)
        # copies of a piece are one piece of its least document; the others' windows all occur earlier
        seen: dict[bytes, int] = {}
        raw, ends = b"".join(table["content"].to_pylist()), np.cumsum(every)
        number = np.array([seen.setdefault(raw[x:y], len(seen)) for x, y in zip((ends - every).tolist(), ends.tolist(), strict=True)], np.int64)
        by = np.lexsort((own, number)) if at is None else np.lexsort((at, own, number))
        lead = by[np.searchsorted(number[by], np.arange(len(seen)))]
        flags_, count_ = rule.resolve(np.frombuffer(b"".join(seen), np.uint8), every[lead], own[lead], None if at is None else at[lead])
        count = count_[number]
        begin = np.cumsum(count) - count
        flags = flags_[np.repeat((np.cumsum(count_) - count_)[number] - begin, count) + np.arange(count.sum())]
        later = own > own[lead[number]] if at is None else np.arange(len(number)) != lead[number]
        flags |= np.repeat(later, count)
        stop = np.cumsum(count)[np.cumsum([len(x) for x in sizes]) - 1]
        out = [_bits(x) for x in np.split(flags, stop[:-1])]
        return pa.table({"shard": table["shard"], "bucket": table["bucket"], "kind": pa.array([_EARLIER] * len(out), pa.int32()), "payload": pa.array(out, pa.binary())})

    return answer


def _end(rule: Rule, buckets: int):
    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table(rule.finish(None, None))
        s = _sequence(left, rule)
        n = max(0, len(s.values) - rule.length + 1)
        flags = np.zeros(n, bool)
        if right.num_rows:
            begin, last, content, group, owner = _candidates(s, right, rule, buckets)
            number, lead = _numbered(content, begin)
            count = last - begin + 1
            # bits come back by bucket, in the order in which the bucket's pieces were sent
            earlier_at = np.full(len(lead), -1, np.int64)
            bits, total = [], 0
            sent = dict(_cells(group[lead]))
            for b, kind, payload in zip(right["bucket"].to_pylist(), right["kind"].to_pylist(), right["payload"].to_pylist(), strict=True):
                if kind == _EARLIER:
                    own = sent[b]
                    sizes = count[lead[own]]
                    earlier_at[own] = total + np.cumsum(sizes) - sizes
                    bits.append(_unbits(payload, int(sizes.sum())))
                    total += int(sizes.sum())
            earlier = np.concatenate(bits) if bits else np.zeros(0, bool)
            place = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            source = np.repeat(earlier_at[number] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            own_lead = lead[number]
            later = (own_lead != np.arange(len(number))) if rule.by_place else s.keys[owner[own_lead]] < s.keys[owner]
            flags[place] = earlier[source] | np.repeat(later, count)
        return pa.table(rule.finish(s, flags))

    return end


def _as_history(table: pa.Table) -> pa.Table:
    """Runs of a batch's shards in a bucket as one run of history: (hash, shard), sorted."""
    hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    shards = np.repeat(table["shard"].to_numpy().astype(np.int32), [len(x) for x in hashes])
    return _history_run(table["bucket"][:1], np.concatenate(hashes), shards)


def _compacted(table: pa.Table) -> pa.Table:
    """Two runs or more of history in a bucket as one."""
    hashes, shards = (np.frombuffer(b"".join(table[k].to_pylist()), t) for k, t in (("hashes", np.uint64), ("shards", np.int32)))
    return _history_run(table["bucket"][:1], hashes, shards)


def _history_run(bucket: pa.ChunkedArray, hashes: np.ndarray, shards: np.ndarray) -> pa.Table:
    by = np.lexsort((shards, hashes))
    return pa.table({"bucket": bucket, "hashes": pa.array([hashes[by].tobytes()], pa.binary()), "shards": pa.array([shards[by].tobytes()], pa.binary())})


class Index:
    """A log-structured index of the anchors of all batches so far: immutable sorted runs (bucket, hashes, shards), by
    level, in the shared folder. Batches' texts aren't copied: their tables are read again where a later batch has
    anchors in common with them, so they must stay as they were."""

    def __init__(self, spark: SparkSession, rule: Rule, buckets: int, shard_bytes: int = SHARD_BYTES, common_shards: int = COMMON_SHARDS) -> None:
        self.spark, self.rule, self.buckets, self.shard_bytes, self.common = spark, rule, buckets, shard_bytes, common_shards
        self.runs: list[tuple[int, str]] = []  # (level, folder), oldest first
        self.batches: list[DataFrame] = []  # dealt texts
        self.shards = 0

    def _kept(self, table: DataFrame, name: str) -> str:
        folder = shared_dir(self.spark, name)
        table.write.parquet(folder)
        return folder

    def compact(self) -> None:
        """Runs of one level become one of the next, until all levels differ."""
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            (level, a), (_, b) = self.runs.pop(), self.runs.pop()
            merged = self.spark.read.schema(_HISTORY).parquet(b, a).groupBy("bucket").applyInArrow(_compacted, _HISTORY)
            self.runs.append((level + 1, self._kept(merged, "index-run")))

    def add(self, texts: DataFrame, size: int, keep: bool = True) -> DataFrame:
        """rule.finish over every document of the batch (doc_id, text; about `size` bytes), with the windows that occur
        earlier in the batch or in any batch before. With keep, the batch is history for those that follow."""
        rule, buckets = self.rule, self.buckets
        shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // self.shard_bytes))
        dealt = texts.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(shards)) + self.shards).cast("int").alias("shard"))
        reports = dealt.groupBy("shard").applyInArrow(_report(rule, buckets), _RUNS)
        if keep:
            reports = self.spark.read.schema(_RUNS).parquet(self._kept(reports, "batch-runs"))
        self.compact()
        if self.runs:
            history = self.spark.read.schema(_HISTORY).parquet(*[folder for _, folder in self.runs])
            masks = reports.groupBy("bucket").cogroup(history.groupBy("bucket")).applyInArrow(_meet(self.common), _ANSWERS)
        else:
            meet = _meet(self.common)
            masks = reports.groupBy("bucket").applyInArrow(lambda table: meet(table), _ANSWERS)
        masks = self.spark.read.schema(_ANSWERS).parquet(self._kept(masks, "index-masks"))
        sent = dealt.groupBy("shard").cogroup(masks.groupBy("shard")).applyInArrow(_send(rule, buckets, len(self.batches)), _SENT)
        for age, old in enumerate(self.batches):
            sent = sent.unionByName(old.groupBy("shard").cogroup(masks.groupBy("shard")).applyInArrow(_send(rule, buckets, age), _SENT))
        answered = sent.groupBy("bucket").applyInArrow(_answer(rule), _ANSWERS)
        out = dealt.groupBy("shard").cogroup(masks.unionByName(answered).groupBy("shard")).applyInArrow(_end(rule, buckets), rule.schema)
        if keep:
            self.runs.append((0, self._kept(reports.groupBy("bucket").applyInArrow(_as_history, _HISTORY), "index-run")))
            self.batches.append(dealt)
            self.shards += shards
        return out


def find_repeats(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, common_shards: int = COMMON_SHARDS, batches: int = 1) -> DataFrame:
    """rule.finish over every document, with the windows that occur earlier. The documents are added to an index in
    `batches` ranges of ascending doc_id, of about as many documents each."""
    texts = id_text(docs, id_col, text_col)
    spark = docs.sparkSession
    cuts = [k / batches for k in range(1, batches)]
    size, bounds = texts.agg(F.sum(F.octet_length("text")), F.percentile_approx("doc_id", cuts) if cuts else F.lit(None)).first()
    size, bounds = int(size or 0), sorted(set(bounds or []))
    index = Index(spark, rule, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes)), shard_bytes, common_shards)
    out = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = texts if low is None else texts.where(F.col("doc_id").isNull() | (F.col("doc_id") > low))
        part = part if high is None else part.where(F.col("doc_id") <= high)
        found = index.add(part, size // (len(bounds) + 1), keep=high is not None)
        out = found if out is None else out.unionByName(found)
    return out


def _in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def merge_runs(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values, the runs that each is in) of sorted, distinct runs, merged as a log: two runs of one level are compacted
    into one of the next, with counts."""
    levels: list[tuple[int, np.ndarray, np.ndarray]] = []
    for run in runs:
        levels.append((0, run, np.ones(len(run), np.int64)))
        while len(levels) > 1 and levels[-1][0] == levels[-2][0]:
            level, a, na = levels.pop()
            _, b, nb = levels.pop()
            levels.append((level + 1, *compact(b, nb, a, na)))
    while len(levels) > 1:
        level, a, na = levels.pop()
        _, b, nb = levels.pop()
        levels.append((level + 1, *compact(b, nb, a, na)))
    return levels[0][1:] if levels else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def compact(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of distinct values with counts as one: b's values are found in a by binary search."""
    at = np.searchsorted(a, b)
    same = np.zeros(len(b), bool)
    inside = at < len(a)
    same[inside] = a[at[inside]] == b[inside]
    na = na.copy()
    na[at[same]] += nb[same]
    new = ~same
    where = at[new] + np.arange(new.sum())
    out, n = np.empty(len(a) + new.sum(), a.dtype), np.empty(len(a) + new.sum(), na.dtype)
    old = np.ones(len(out), bool)
    old[where] = False
    out[old], n[old] = a, na
    out[where], n[where] = b[new], nb[new]
    return out, n
