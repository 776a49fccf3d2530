import zlib
from collections import Counter

import corpus_pipeline
from llm_rows import odd_rows
from test_dedup import components_brute, fingerprint
from test_scans import leak_brute, mask_brute, secret_brute
from test_tokens import plain

from planeworks.llm import op3_packing, op9_secrets, op10_toxicity


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "near_duplicates", "decontaminate", "secrets", "packing"]

    clean = steps["toxicity"](spark, docs, small)
    model = op10_toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    toxic = {r.doc_id for r in op10_toxicity.score(docs, model).collect() if r.toxic}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(rows) - toxic

    ids = sorted(rows)
    root = components_brute([fingerprint(rows[i]) for i in ids])
    one = steps["near_duplicates"](spark, docs, small)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {ids[r] for r in root}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    free = steps["decontaminate"](spark, docs, small)
    hit = {i for (i, _, n, _, _) in leak_brute(list(rows.items()), items) if n}
    assert hit and free.columns == docs.columns and {r.doc_id for r in free.collect()} == set(rows) - hit

    masked = steps["secrets"](spark, docs, small)
    assert masked.columns == docs.columns
    for r in masked.collect():
        found = secret_brute(rows[r.doc_id])
        assert (r.text == rows[r.doc_id]) if not found else all(rows[r.doc_id][a:b] not in r.text for a, _, b in found)
        assert r.n_chars == len(r.text)

    pieces = steps["packing"](spark, docs, small)
    assert Counter(r.doc_id for r in pieces.select("doc_id").distinct().collect()) == Counter(ids)


def test_run(spark, small):
    """The whole pipeline against its stages in plain Python, down to the checksums of the packed pieces."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = op10_toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    for r in op10_toxicity.score(docs, model).where("toxic").collect():
        del rows[r.doc_id]
    ids = sorted(rows)
    kept = [ids[k] for k in sorted(components_brute([fingerprint(rows[i]) for i in ids]))]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    hit = {i for (i, _, n, _, _) in leak_brute([(i, rows[i]) for i in kept], items) if n}
    left = {i: rows[i] for i in kept if i not in hit}
    spans = {r.doc_id: [(x.start, x.kind, x.end) for x in r.spans] for r in op9_secrets.scan_secrets(docs.where(docs.doc_id.isin(list(left)))).collect()}
    want = {i: plain(mask_brute(t or "", spans[i])) for i, t in left.items()}

    found = corpus_pipeline.run(spark, small)
    assert found.columns == op3_packing.digests(op3_packing.pack_documents(docs)).columns
    pieces, windows = {}, Counter()
    for r in found.collect():
        pieces.setdefault(r.doc_id, []).append(r)
        windows[r.sequence_id] += r.length
    assert set(pieces) == set(want) and max(windows.values()) <= 2048
    for i, own in pieces.items():
        assert sum(r.length for r in own) == len(want[i]) and {r.doc_tokens for r in own} == {len(want[i])}
        assert all(zlib.crc32(want[i][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)


def test_empty_table_passes_every_stage(spark, none, small):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def test_odd_rows_pass_every_stage(spark, odd, small):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() > 0 and len(odd_rows()) > 0
