import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import make, odd_rows

from planeworks.llm import op2_tokens as T
from planeworks.llm import op3_packing as P
from planeworks.llm.text import row_bytes
from planeworks.llm.tokens import END, Encoder, default_path


def plain(text):
    return np.array(Encoder.of(default_path()).library.encode(text or "", add_special_tokens=False).ids + [END], "<u4")


def test_encoder_is_the_library(spark, small):
    texts = [t for _, t in odd_rows()] + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    ids, at = Encoder.of(default_path()).encode(*row_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == plain(t).tolist()


def test_encoder_forgets(monkeypatch):
    import planeworks.llm.tokens as M

    monkeypatch.setattr(M, "REMEMBER", 120)
    e = Encoder(default_path())
    for text in ("aa bb cc", "bb dd ee ff", "aa bb gg hh ii"):
        ids, _ = e.encode(*row_bytes(pa.array([text])))
        assert ids.tolist() == plain(text).tolist()


@pytest.mark.parametrize("n,alphabet,lanes", [(1, 1, 1), (7, 2, 3), (5000, 300, 64), (40000, 30000, 128)])
def test_coder_round_trip_and_checkpoints(n, alphabet, lanes):
    ids = np.random.default_rng(n).zipf(1.3, n) % alphabet
    coder = T.Coder(*T.table_of(np.bincount(ids)))
    words, state, points = coder.encode(ids, lanes, every=16)
    assert coder.decode(words, state, n).tolist() == ids.tolist()
    marks = T.checkpoint_states(points, lanes)
    assert len(marks) == (-(-n // lanes) - 1) // 16
    assert coder.decode(words, state, n, points, 16).tolist() == ids.tolist()  # all stretches at once
    for k, (position, states) in enumerate(marks):  # and from each checkpoint on
        step = 16 * (k + 1)
        assert coder.decode(words[position:], states, n - step * lanes).tolist() == ids[step * lanes :].tolist()


def test_table_fills_its_scale():
    for counts in (np.array([1]), np.array([0, 5, 0, 1, 10**9]), np.ones(49408, int)):
        symbols, freqs = T.table_of(counts)
        assert freqs.sum() == 1 << T.SCALE and freqs.min() >= 1 and len(symbols) == (counts > 0).sum()


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_container(spark, odd, tmp_path, broadcast_rows):
    T.write_tokens(odd, str(tmp_path / "c"), block_tokens=500, shard_bytes=400)
    got = [tuple(r) for r in T.read_tokens(spark, str(tmp_path / "c"), broadcast_rows=broadcast_rows).collect()]
    want = sorted(((i is not None, i or 0, plain(t).tobytes()) for i, t in odd_rows()), key=lambda x: x[:2])
    assert sorted((i is not None, i or 0, bytes(b)) for i, _, _, b in got) == sorted(want)
    at, order = 0, sorted(got, key=lambda r: r[1])
    for _, start, n, b in order:
        assert start == at and len(b) == 4 * n
        at += n
    assert [r[0] or -1 for r in order] == sorted(r[0] or -1 for r in order)
    digests = T.read_tokens(spark, str(tmp_path / "c"), digests=True).collect()
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in digests) == sorted((s, n, zlib.crc32(b)) for _, s, n, b in got)


def test_other_tokenizers(spark, odd, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    T.write_tokens(odd, str(tmp_path / "c"), path=path)
    got = [(r.doc_id or -1, bytes(r.ids)) for r in T.read_tokens(spark, str(tmp_path / "c")).collect()]
    assert sorted(got) == sorted((i or -1, np.array(whole.encode(t or "", add_special_tokens=False).ids + [END], "<u4").tobytes()) for i, t in odd_rows())


def test_very_long_text(spark, tmp_path):
    text = " ".join(t for _, t in odd_rows() if t and "<|" not in t) * 180  # some 10 MB
    assert len(text) > 9_000_000
    docs = make(spark, [(1, "a"), (2, text), (3, "b")])
    got = {r.doc_id: r for r in T.read_tokens(spark, T.write_tokens(docs, str(tmp_path / "c")), digests=True).collect()}
    want = plain(text)
    assert got[2].n_tokens == len(want) and got[2].ids_crc32 == zlib.crc32(want.tobytes()) and got[3].start == 2 + len(want)


def test_damage_is_noticed(spark, odd, tmp_path):
    from pyspark.sql import functions as F

    T.write_tokens(odd, str(tmp_path / "good"))
    rows = spark.read.parquet(str(tmp_path / "good" / "data"))
    worse = F.transform("blocks", lambda b: b.withField("payload", F.concat(F.lit(b"xxxx"), F.substring(b["payload"], 5, 1 << 30))))
    rows.withColumn("blocks", worse).write.parquet(str(tmp_path / "bad" / "data"))
    spark.read.parquet(str(tmp_path / "good" / "starts")).write.parquet(str(tmp_path / "bad" / "starts"))
    with pytest.raises(Exception, match="checksum"):
        T.read_tokens(spark, str(tmp_path / "bad")).collect()


def test_empty_container(spark, none, tmp_path):
    assert T.read_tokens(spark, T.write_tokens(none, str(tmp_path / "e"))).count() == 0


def check_packing(rows, texts, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append(plain(t))
    for i, every in want.items():
        total = sum(map(len, every))
        assert sum(r.length for r in by_doc[i]) == total
        for r in by_doc[i]:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == zlib.crc32(bytes(r.ids)) for x in every)
    return len(by_sequence)


def test_packing(odd, none):
    check_packing(P.pack_documents(odd, capacity=256, group_windows=8).collect(), odd_rows(), 256)
    assert P.pack_documents(none).count() == 0


def test_packing_is_dense(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").coalesce(1)
    n = check_packing(P.pack_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)
    total = sum(len(plain(r.text)) for r in docs.collect())
    assert total / (2048 * n) > 0.95


@pytest.mark.parametrize("m", [1, 2, 3, 7])
def test_differencing_keeps_every_piece(m):
    sizes = np.random.default_rng(m).integers(1, 900, 40)
    windows = P.differencing(sizes, m)
    assert sorted(i for w in windows for i in w) == list(range(40)) and len(windows) == m
    sums = [int(sizes[w].sum()) for w in windows]
    assert max(sums) - min(sums) <= sizes.max()


@pytest.mark.parametrize("m", [1, 2, 5])
def test_differencing_merges_the_largest_spreads(m):
    """Against dense partial partitions, merged one pair at a time."""
    for seed in range(30):
        rng = np.random.default_rng(seed)
        sizes = rng.choice(10**6, rng.integers(1, 40), replace=False) + 1  # no two alike, so that nothing is tied at first
        rows = [sorted([int(s)] + [0] * (m - 1), reverse=True) for s in sizes]
        while len(rows) > 1:
            rows.sort(key=lambda r: r[0] - r[-1], reverse=True)
            a, b = rows[0], rows[1]
            both = sorted((x + y for x, y in zip(a, b[::-1], strict=True)), reverse=True)
            rows = [[x - both[-1] for x in both], *rows[2:]]
        sums = sorted((int(sizes[w].sum()) for w in P.differencing(sizes, m)), reverse=True)
        assert sums[0] - sums[-1] == rows[0][0] - rows[0][-1]


def test_very_many_empty_texts():
    import tracemalloc

    tracemalloc.start()
    pieces, window = P.pack(np.ones(300_000, np.int64))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(pieces) == 300_000 and np.bincount(window).max() <= 2048 and window[-1] + 1 <= 149
    assert peak < 250_000_000  # in proportion to the pieces; a sum a window for each would be 700 MB


def test_make(spark):
    assert make(spark, [(1, "a")]).count() == 1
