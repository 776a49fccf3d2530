import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from planeworks import registry
from planeworks.operators import geometry as G
from planeworks.operators import session as S
from planeworks.sources import sinks

SESSIONS = "session long, file_sha256 string, pixel_sha256 string, width long, height long, budget int, window_low int, window_high int"


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([(1, "f1", "p1", 173, 161, 3, 0, 100), (2, "f2", "p2", 50, 40, 2, 0, 9), (3, "f3", "p3", 9, 9, 99, 0, 9)], SESSIONS)


def test_lifecycle(spark, sessions):
    opened = S.create(sessions)
    assert {(r.session, r.x1, r.y1, r.step) for r in opened.collect()} == {(1, 173, 161, 1), (2, 50, 40, 1)}
    asked = [(1, 1, 1, "detail", 10, 20, 80, 90), (1, 1, 2, "detail", 10, 20, 80, 90), (1, 1, 3, "detail", 0, 0, 5, 5), (1, 2, 4, "detail", 0, 0, 999, 5), (1, 3, 5, "preview", 0, 0, 9, 9), (1, 4, 6, "detail", 0, 0, 9, 9), (2, 1, 1, "detail", 0, 0, 5, 5), (9, 1, 1, "detail", 0, 0, 5, 5)]
    requests = spark.createDataFrame(asked, "session long, request_id long, seq long, kind string, x0 long, y0 long, x1 long, y1 long")
    sealed = spark.createDataFrame([(2,)], "session long")
    got = {(r.session, r.seq): (r.status, r.view_id) for r in S.request_views(requests, sessions, sealed).collect()}
    assert got == {(1, 1): ("committed", "view-001"), (1, 2): ("replayed", "view-001"), (1, 3): ("conflict", None), (1, 4): ("bad_box", None), (1, 5): ("committed", "view-002"), (1, 6): ("over_budget", None), (2, 1): ("sealed", None), (9, 1): ("no_session", None)}


def test_report_audit_packet(spark, sessions):
    views = spark.createDataFrame([(1, "view-000", None, None, 0, 0, 173, 161, 1), (1, "view-001", "a.tif", "aa", 10, 20, 80, 90, 1), (2, "view-000", "b.tif", "bb", 0, 0, 50, 40, 1)], "session long, view_id string, native_path string, native_sha256 string, x0 long, y0 long, x1 long, y1 long, step int")
    box = F.struct(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    findings = spark.createDataFrame([(1, 1, 20, 30, 30, 40, ["view-001"], "seen", "low"), (1, 2, 0, 0, 30, 40, ["view-001"], "seen", "low"), (1, 3, 20, 30, 30, 40, ["view-009"], " ", "certain"), (2, 1, 0, 0, 3, 3, ["view-000"], "x", "high")], "session long, finding_id long, x0 long, y0 long, x1 long, y1 long, evidence array<string>, observation string, certainty string").withColumn("box", box)
    bad = S.report_violations(findings, views)
    assert {(r.session, r.finding_id, r.violation) for r in bad.collect()} == {(1, 2, "not_in_view"), (1, 3, "missing_view"), (1, 3, "not_in_view"), (1, 3, "certainty"), (1, 3, "observation")}
    sealed = S.seal(findings, bad)
    assert [r.session for r in sealed.collect()] == [2]
    files = spark.createDataFrame([(1, "a.tif", "zz"), (1, "lost.tif", "q")], "session long, native_path string, sha256 string")
    got = {r.session: (r.views, r.missing_files, r.changed_files, r.orphans, r.state) for r in S.audit(sessions, views, files, sealed).collect()}
    assert got == {1: (2, 0, 1, 1, "pending"), 2: (1, 1, 0, 0, "sealed"), 3: (0, 0, 0, 0, "active")}
    records = spark.createDataFrame([(1, "p1", "f1", 173, 161), (2, "p2", "xx", 51, 40), (3, "none", "f", 1, 1)], "record_id long, pixel_sha256 string, file_sha256 string, width long, height long")
    rows = {r.record_id: r for r in S.packets(records, sessions, views).collect()}
    assert rows[1].violations == [] and rows[1].native_area == 70 * 70 and rows[1].full_area == 173 * 161
    assert rows[2].violations == ["file_sha256", "width"] and rows[3].violations == ["missing"] and rows[1].quality_decision is None


def test_region_is_exact(spark):
    parent = spark.range(600).select((F.col("id") / 30).cast("int").alias("y"), (F.col("id") % 30).cast("int").alias("x"), (F.col("id") % 7).alias("v"))
    child = parent.where("x between 5 and 9 and y between 3 and 8").select((F.col("y") - 3).alias("y"), (F.col("x") - 5).alias("x"), "v")
    x1, y1 = (5 + child.agg(F.max("x")).first()[0] + 1), (3 + child.agg(F.max("y")).first()[0] + 1)
    assert S.verify_region(parent, child, 5, 3, x1, y1).count() == 0
    changed = S.verify_region(parent, child.withColumn("v", F.col("v") + (F.col("x") == 0).cast("int")), 5, 3, x1, y1)
    assert {r.side: r["count"] for r in changed.groupBy("side").count().collect()} == {"crop": 6, "missing": 6}
    lacking = S.verify_region(parent, child.where("x <> 0"), 5, 3, x1, y1).collect()
    assert {(r.side, r.x) for r in lacking} == {("missing", 5)} and len(lacking) == 6


def test_interpolation_is_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = np.sort(rng.random(20)) * 10, rng.random(20)
    at = np.concatenate([rng.random(40) * 14 - 2, x[:3]])
    points = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, x double, y double")
    asked = spark.createDataFrame([(1, float(a)) for a in at], "k int, x double")
    got = {r.x: r.value for r in G.interpolate(points, asked, "k").collect()}
    assert np.allclose([got[float(a)] for a in at], np.interp(at, x, y))


def test_clip_line(spark):
    f = [F.lit(float(v)) for v in (0, 0, 1, 2, -1, -1, 5, 4)]
    a, b = G.clip_line(*f)
    flat = G.clip_line(*[F.lit(float(v)) for v in (0, 9, 1, 0, -1, -1, 5, 4)])
    r = spark.range(1).select(a.alias("a"), b.alias("b"), flat[0].alias("c")).first()
    assert (r.a, r.b, r.c) == (-0.5, 2.0, None)


def test_sinks(spark, tmp_path):
    sinks.write_json(tmp_path / "r.json", {"b": 1, "a": [None]})
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": [None], "b": 1}
    with pytest.raises(ValueError):
        sinks.write_json(tmp_path / "r.json", {"x": float("nan")})
    assert [p.name for p in tmp_path.iterdir()] == ["r.json"]
    assert [(r.b, r["_corrupt"]) for r in sinks.read_records(spark, str(tmp_path), "b long").collect()] == [(1, None)]
    assert sinks.png(np.zeros((3, 4), np.uint8))[:8] == b"\x89PNG\r\n\x1a\n"
    with pytest.raises(FileExistsError):
        sinks.fresh_destination(tmp_path / "r.json", tmp_path.parent / "other")
    with pytest.raises(ValueError):
        sinks.fresh_destination(tmp_path / "new", tmp_path)
    with pytest.raises(ValueError):
        sinks.contained(tmp_path, "../x")
    assert sinks.contained(tmp_path, "r.json") == (tmp_path / "r.json").resolve()


def test_mounts(spark):
    lines = ["1 0 8:1 / / rw - ext4 /dev/a rw", "2 1 8:2 / /data\\040x rw - nfs4 h:/a rw", "3 1 8:3 / /data rw - xfs /dev/b rw"]
    table = sinks.mounts(spark.createDataFrame([(x,) for x in lines], "value string"))
    kind = lambda p: sinks.filesystem_type(table, p).first().fstype
    assert (kind("/data x/y"), kind("/data/y"), kind("/database"), kind("/data")) == ("nfs4", "xfs", "ext4", "xfs")


def test_registry(spark):
    assert registry.methods(spark).where("implemented").count() == 12


def test_profiles(spark):
    from planeworks.functions import profiles as N

    good = {
        "schema": "s", "node_id": 0, "node_count": 2, "paths": {**dict.fromkeys(N.PATHS), "source_root": "/data"}, "execution": {"active_sessions_per_node": 1, "cpu_threads_per_process": 1},
        "review_budget": {"max_views": 16, "max_display_dimension": 1024, "max_raw_crop_pixels": 4194304}, "inference": {**dict.fromkeys(N.TEXTS), "request_timeout_seconds": 120, "max_attempts": 2},
    }
    changes = [({}, []), ({"node_id": 2}, ["node"]), ({"extra": 1}, ["fields"]), ({"paths": {**good["paths"], "local_work_root": "x"}}, ["relative_path"]), ({"paths": {}}, ["path_fields"]), ({"execution": {"active_sessions_per_node": 2, "cpu_threads_per_process": 1}}, ["execution"])]
    changes += [({"review_budget": {**good["review_budget"], "max_views": 65}}, ["budget"]), ({"inference": {**good["inference"], "max_attempts": 4, "prompt_sha256": "zz"}}, ["inference_limits", "prompt_sha256"]), ({"inference": {**good["inference"], "model_id": " "}}, ["inference_text"])]
    rows = spark.createDataFrame([(i, json.dumps({**good, **c})) for i, (c, _) in enumerate(changes)] + [(99, "not json")], "i int, j string")
    got = {r.i: r.why for r in rows.select("i", N.profile_reasons(F.col("j")).alias("why")).collect()}
    assert all(got[i] == want for i, (_, want) in enumerate(changes)) and "fields" in got[99]
    r = spark.range(1).select(N.blockers(F.lit("ext4"), F.lit("nfs4"), F.lit("/a"), F.lit("/a/b")).alias("b"), N.blockers(F.lit("ext4"), F.lit("xfs"), F.lit("/a"), F.lit("/b")).alias("ok")).first()
    assert r.b == ["work_not_local", "nested_paths"] and r.ok == []


def test_preview_coordinates_become_native(spark):
    views = spark.createDataFrame([(1, "view-000", 100, 50, 1000, 703, 4)], "session long, view_id string, x0 long, y0 long, x1 long, y1 long, step int")
    asked = spark.createDataFrame([(1, 1, "view-000", 10, 5, 20, 9), (1, 2, "view-000", 200, 160, 225, 164), (1, 3, "view-000", 0, 0, 226, 1), (1, 4, "view-009", 0, 0, 1, 1), (2, 5, "view-000", 0, 0, 1, 1), (1, 6, "view-000", 5, 5, 5, 6)], "session long, request_id long, parent_view string, px0 long, py0 long, px1 long, py1 long")
    got = {r.request_id: (r.status, r.x0, r.y0, r.x1, r.y1) for r in S.native_requests(asked, views).collect()}
    none = (None,) * 4
    assert got == {1: ("ok", 140, 70, 180, 86), 2: ("ok", 900, 690, 1000, 703), 3: ("outside", *none), 4: ("no_parent", *none), 5: ("no_parent", *none), 6: ("outside", *none)}


def test_assigned_sessions(spark):
    from planeworks.operators import ledger as L

    placed = spark.createDataFrame([("a", 0, []), ("b", 1, []), ("c", None, ["path"])], "asset_id string, node long, reasons array<string>")
    owned = spark.createDataFrame([(k, a, 100, 80, 8, 0, 9) for k, a in enumerate("abcd")], "session long, asset_id string, width int, height int, budget int, window_low int, window_high int")
    made, refused = S.create_assigned(owned, placed, 0)
    assert [r.session for r in made.collect()] == [0]
    assert {r.asset_id: r.status for r in refused.collect()} == {"b": "elsewhere", "c": "rejected", "d": "unknown"}
    support = L.largest_support(spark.createDataFrame([("a", 3), ("a", 7)], "asset_id string, n long"), placed, "asset_id", "n")
    assert {r.asset_id: r.support for r in support.collect()} == {"a": 7, "b": 0, "c": 0}


def test_csv_begins_with_its_mark(spark, tmp_path):
    from planeworks.sources import sinks

    sinks.write_csv(spark.createDataFrame([(1, "é")], "a long, b string"), str(tmp_path / "out"), ("note",))
    files = [p.read_bytes() for p in (tmp_path / "out").glob("part-*.csv")]
    assert files and all(f.startswith(b"\xef\xbb\xbfa,b,note") for f in files if f)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns[1:] == ["b", "note"]
