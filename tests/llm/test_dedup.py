import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_rows import make, odd_rows

from planeworks.llm import op1_suffix_dedup as S
from planeworks.llm import op5_simhash as H
from planeworks.llm import op7_substring_dedup as W
from planeworks.llm import windows
from planeworks.llm.components import connected_components

ORDER = lambda r: (r[0] is None, r[0] or 0)


def bytes_brute(rows, length=50):
    first, out = {}, []
    rows = [(i, (t or "").encode()) for i, t in rows]
    for i, x in rows:
        for k in range(len(x) - length + 1):
            w = x[k : k + length]
            first[w] = min(first.get(w, (True, 0)), ORDER((i,)))
    for i, x in rows:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if first[x[k : k + length]] < ORDER((i,)):
                gone[k : k + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(x) else 0
        out.append((i, len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


def words_brute(rows, length=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=ORDER):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            q = tuple(w[k : k + length])
            if q in seen:
                gone[k : k + length] = [True] * length
            seen.add(q)
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for n, a in ((0, 2), (1, 2), (2, 1), (200, 1), (3000, 2), (3000, 200)):
        text = rng.integers(0, a, n).astype(np.uint8)
        raw = text.tobytes()
        order = S.suffix_array(text)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        lcp = S.common_prefixes(text, order, 50)
        for k in range(1, n):
            x, y = raw[order[k - 1] :][:50], raw[order[k] :][:50]
            assert lcp[k] == next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 900, "common_shards": 1}])
def test_bytes(spark, odd, options):
    got = Counter(tuple(r) for r in S.remove_repeats(odd, keep_text=False, **options).collect())
    assert got == bytes_brute(odd_rows())


def test_bytes_in_parts(monkeypatch):
    rng = random.Random(3)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 70))).encode() for _ in range(60)]
    pieces += pieces[:20] + [p[5:60] + b"zz" * 5 for p in pieces[:20]]
    content, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
    docs = np.array([rng.randint(0, 40) for _ in pieces])
    whole, count = S.resolve_bytes(content, sizes, docs, None)
    parts, _ = S.resolve_bytes(content, sizes, docs, None, part_bytes=300)
    assert whole.tolist() == parts.tolist() and count.tolist() == [len(p) - 49 for p in pieces]
    first = {}
    for p, d in zip(pieces, docs, strict=True):
        for k in range(len(p) - 49):
            first[p[k : k + 50]] = min(d, first.get(p[k : k + 50], 99))
    assert whole.tolist() == [bool(first[p[k : k + 50]] < d) for p, d in zip(pieces, docs, strict=True) for k in range(len(p) - 49)]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 900, "common_shards": 1}, {"batches": 1}, {"batches": 3, "shard_bytes": 900, "common_shards": 2}])
def test_words(spark, odd, options):
    got = Counter(tuple(r) for r in W.remove_repeated_windows(odd, keep_text=False, **options).collect())
    assert got == words_brute(odd_rows())


def test_kept_text(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = W.remove_repeated_windows(make(spark, [(1, text), (2, "x  y\n" + text + " z")])).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [text, "x y z"]


def test_empty_tables(spark, none):
    assert S.remove_repeats(none).count() == 0
    assert W.remove_repeated_windows(none).count() == 0
    assert H.near_duplicates(none).count() == 0


def test_small_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in S.remove_repeats(docs, keep_text=False).collect()) == bytes_brute(rows)
    assert Counter(tuple(r) for r in W.remove_repeated_windows(docs, keep_text=False).collect()) == words_brute(rows)


def test_anchor_depends_on_content_alone():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 9, 4000).astype(np.uint64)
    b = np.concatenate([rng.integers(0, 9, 777).astype(np.uint64), a[1000:1100], rng.integers(0, 9, 50).astype(np.uint64)])
    ha, hb = windows.gram_hashes(a, 24), windows.gram_hashes(b, 24)
    x, y = windows.anchors(ha, 27), windows.anchors(hb, 27, block=64)
    for s in range(51):
        assert x[1000 + s] - 1000 == y[777 + s] - 777


def test_runs_compact():
    rng = np.random.default_rng(2)
    runs = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(7)]
    n = Counter(int(v) for r in runs for v in r)
    values, counts = windows.merge_runs(runs)
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == n and values.tolist() == sorted(n)


def test_batch_by_batch_is_one_shot(spark):
    """Batches of ascending doc_id, each against its history, remove what one call on all of them removes."""
    rows = sorted((r for r in odd_rows() if r[0] is not None), key=ORDER)
    rows += [(100 + i, t) for i, t in rows[:9]]  # copies in a later batch
    index = W.new_index(spark, buckets=5, keep_text=False, shard_bytes=2000, common_shards=3)
    got, per = Counter(), -(-len(rows) // 5)
    for k in range(0, len(rows), per):
        cut = [r for r in rows[k : k + per]]
        got += Counter(tuple(r) for r in W.add_batch(index, make(spark, cut)).collect())
    assert got == words_brute(rows)
    assert [level for level, _ in index.runs] == [2, 0]  # five batches: four were compacted into one run
    runs = spark.read.parquet(index.runs[0][1])
    hashes = [np.frombuffer(bytes(r.hashes), np.uint64) for r in runs.collect()]
    assert all((np.diff(h.astype(object)) >= 0).all() for h in hashes) and runs.select("bucket").distinct().count() == runs.count()


def test_history_is_earlier(spark):
    text = " ".join(f"w{i}" for i in range(30))
    index = W.new_index(spark, buckets=3)
    assert W.add_batch(index, make(spark, [(9, text), (8, None)])).where("doc_id = 9").first().kept == text
    assert {r.doc_id: r.kept for r in W.add_batch(index, make(spark, [(1, "a b " + text), (2, text + " z")])).collect()} == {1: "a b", 2: "z"}


def test_equal_fingerprints_are_verified(monkeypatch):
    """All windows have one fingerprint: words alone decide."""
    monkeypatch.setattr(W, "window_prints", lambda code, length: np.zeros(max(0, len(code) - length + 1), np.uint64))
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    content, sizes = np.frombuffer("".join(texts).encode(), np.uint8), np.array([len(t) for t in texts])
    flags, count = W.resolve_words(content, sizes, np.arange(40) // 3, np.arange(40) % 3 * 50, 4)
    seen, want = set(), []
    for t in texts:
        w = t.split(" ")
        for k in range(len(w) - 3):
            want.append(tuple(w[k : k + 4]) in seen)
            seen.add(tuple(w[k : k + 4]))
    assert flags.tolist() == want and count.sum() == len(want)


def test_report_rows_follow_the_input(spark, small):
    """A shard's rows are at most its hashes, however many buckets there are."""
    rule = W._rule(20, 8, False)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    import pyarrow as pa

    def reported(part, shard):
        table = pa.table({"doc_id": pa.array([i for i, _ in part]), "text": pa.array([t for _, t in part]), "shard": pa.array([shard] * len(part), pa.int32())})
        out = windows._report(rule, 1 << 20)(table)
        assert sum(len(x) // 8 for x in out["hashes"].to_pylist()) >= out.num_rows
        return out.num_rows

    half, whole = reported(rows[::2], 0), reported(rows[::2], 0) + reported(rows[1::2], 1)
    assert 1.5 < whole / half < 2.6


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(values, distance=4):
    n, up = len(values), list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, odd, small):
    for docs, rows in ((odd, odd_rows()), (spark.read.parquet(f"{small}/documents.parquet"), None)):
        rows = rows or [(r.doc_id, r.text) for r in docs.collect()]
        fps = [fingerprint(t) for _, t in rows]
        root = components_brute(fps)
        least = {}
        for (i, _), r in zip(rows, root, strict=True):
            if i is not None:
                least[r] = min(i, least.get(r, i))
        want = Counter((i, f, least.get(r)) for (i, _), f, r in zip(rows, fps, root, strict=True))
        assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in H.near_duplicates(docs).collect()) == want


@pytest.mark.parametrize("parts", [2, 3])
def test_covering_misses_no_link(spark, parts):
    rng = random.Random(parts)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:60]:
        for _ in range(6):
            x = v
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            values.append(x)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = H.links(spark.createDataFrame([(v,) for v in signed], "fp long"), parts=parts).collect()
    place = {v: i for i, v in enumerate(signed)}
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in found:
        assert (values[place[r.a]] ^ values[place[r.b]]).bit_count() >= 1
        a, b = find(place[r.a]), find(place[r.b])
        up[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(values))] == components_brute(values)


def test_dense_group_gives_a_forest(spark):
    base = 0x0123456789ABCDEF
    values = sorted({base ^ (1 << a) ^ (1 << b) for a in range(63) for b in range(a)})
    found = H.links(spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")).collect()
    assert len(found) < 8 * 4 * len(values)


def test_components_of_a_path(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (100, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
