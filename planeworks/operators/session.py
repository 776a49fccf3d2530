"""Inspection sessions as tables: creation, views, sealing, audit, and the evidence packet that binds them to records.

A session is append-only rows: `sessions` (session, file_sha256, pixel_sha256, width, height, budget, window_low,
window_high), `views` (session, view_id, request_id, kind, purpose, x0, y0, x1, y1, step, native_path), `reports`
(session, findings). Nothing is changed in place; state is derived, and every check is a table of violations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planeworks.functions.boxes import contains, is_valid
from planeworks.operators import ledger as L
from planeworks.operators.spatial import coverage

#: Limits of a session.
VIEWS, DISPLAY, CROP = (2, 64), (64, 2048), 16_777_216


def create(sessions: DataFrame) -> DataFrame:
    """Sessions with their overview view; a budget out of range is a violation, not a session."""
    ok = F.col("budget").between(*VIEWS) & (F.col("window_low") < F.col("window_high")) & (F.col("width") > 0) & (F.col("height") > 0)
    zero = F.lit(0).cast("long")
    return sessions.where(ok).select(
        "session", F.lit("view-000").alias("view_id"), F.lit("overview").alias("kind"), zero.alias("x0"), zero.alias("y0"), F.col("width").cast("long").alias("x1"), F.col("height").cast("long").alias("y1"),
        F.greatest(F.lit(1), F.ceil(F.greatest("width", "height") / 1024)).cast("int").alias("step"),
    )


def request_views(requests: DataFrame, sessions: DataFrame, sealed: DataFrame) -> DataFrame:
    """Requests (session, request_id, seq, kind, x0, y0, x1, y1) with status and, for committed ones, view_id. Order of
    checks: sealed session, box, crop size, then idempotency and budget (a retry costs nothing)."""
    box = F.struct("x0", "y0", "x1", "y1")
    known = requests.join(sessions.select("session", "width", "height", "budget"), "session", "left").join(sealed.select("session", F.lit(True).alias("sealed")).distinct(), "session", "left")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    refused = F.when(F.col("width").isNull(), "no_session").when(F.col("sealed"), "sealed").when(~F.coalesce(is_valid(box, F.col("width"), F.col("height")), F.lit(False)), "bad_box").when(F.col("kind").isin("detail", "control") & (area > CROP), "crop_too_large")
    checked = known.withColumn("refused", refused)
    args = F.concat_ws(":", "kind", "x0", "y0", "x1", "y1")
    good = checked.where("refused is null").withColumn("args", args)
    # the budget differs by session: settle at the widest and cut each session at its own, less the overview
    settled = L.settle_requests(good.select("session", "request_id", "args", "seq"), VIEWS[1])
    budgets = good.select("session", (F.col("budget") - 1).alias("room")).distinct()
    first = F.min("seq").over(Window.partitionBy("session", "request_id"))
    placed = settled.withColumn("first", first).join(budgets, "session")
    rank = F.dense_rank().over(Window.partitionBy("session").orderBy("first"))
    out = placed.withColumn("rank", rank).withColumn("status", F.when(F.col("rank") > F.col("room"), "over_budget").otherwise(F.col("status")))
    named = out.withColumn("view_id", F.when(F.col("status").isin("committed", "replayed"), F.concat(F.lit("view-"), F.lpad(F.col("rank").cast("string"), 3, "0"))))
    bad = checked.where("refused is not null").select("session", "request_id", "seq", F.col("refused").alias("status"), F.lit(None).cast("string").alias("view_id"))
    return named.select("session", "request_id", "seq", "status", "view_id").unionByName(bad)


def native_requests(requests: DataFrame, views: DataFrame) -> DataFrame:
    """Requests in preview coordinates of an earlier view (session, request_id, parent_view, px0, py0, px1, py1) with the
    box in the plane's own samples that they mean (x0, y0, x1, y1), and status: `ok`, `no_parent` (the session has no such
    view) or `outside` (not a box within the view's preview). views: session, view_id, x0, y0, x1, y1, step."""
    owned = views.select("session", F.col("view_id").alias("parent_view"), *[F.col(c).cast("long").alias(f"v{c}") for c in ("x0", "y0", "x1", "y1")], F.col("step").cast("long"))
    met = requests.join(owned, ["session", "parent_view"], "left")
    shown = lambda a, b: F.ceil((F.col(b) - F.col(a)) / F.col("step"))
    inside = (F.col("px0") >= 0) & (F.col("py0") >= 0) & (F.col("px0") < F.col("px1")) & (F.col("py0") < F.col("py1")) & (F.col("px1") <= shown("vx0", "vx1")) & (F.col("py1") <= shown("vy0", "vy1"))
    status = F.when(F.col("step").isNull(), "no_parent").when(F.coalesce(inside, F.lit(False)), "ok").otherwise("outside")
    place = lambda p, lo, hi: F.when(status == "ok", F.least(F.col(lo) + F.col(p) * F.col("step"), F.col(hi)))
    out = met.withColumns({"x0": place("px0", "vx0", "vx1"), "y0": place("py0", "vy0", "vy1"), "x1": place("px1", "vx0", "vx1"), "y1": place("py1", "vy0", "vy1"), "status": status})
    return out.select("session", "request_id", "parent_view", "x0", "y0", "x1", "y1", "status")


def create_assigned(sessions: DataFrame, placed: DataFrame, node: int) -> tuple[DataFrame, DataFrame]:
    """(overview views of the sessions whose asset (asset_id) the plan places on this node, the others with why not)."""
    told = sessions.join(L.jobs_of(placed, sessions.select("asset_id").distinct(), node).select("asset_id", "status"), "asset_id")
    return create(told.where("status = 'assigned'").drop("status")), told.where("status <> 'assigned'").select("session", "asset_id", "status")


def report_violations(findings: DataFrame, views: DataFrame) -> DataFrame:
    """session, finding_id, violation for findings (session, finding_id, box, evidence, observation, certainty) that name
    missing views, lie in none of them, or claim a verdict."""
    named = findings.select("session", "finding_id", "box", F.explode_outer("evidence").alias("view_id"))
    met = named.join(views.select("session", "view_id", F.struct("x0", "y0", "x1", "y1").alias("view_box")), ["session", "view_id"], "left")
    held = met.groupBy("session", "finding_id").agg(F.max(F.col("view_box").isNull()).alias("missing"), F.coalesce(F.max(contains(F.col("view_box"), F.col("box"))), F.lit(False)).alias("held"))
    text = findings.select("session", "finding_id", (~F.coalesce(F.col("certainty").isin("low", "medium", "high"), F.lit(False))).alias("bad_certainty"), (F.length(F.trim(F.coalesce("observation", F.lit("")))) == 0).alias("no_observation"))
    rules = F.array(*[F.when(F.col(c) if c != "held" else ~F.col("held"), F.lit(n)) for c, n in (("missing", "missing_view"), ("held", "not_in_view"), ("bad_certainty", "certainty"), ("no_observation", "observation"))])
    return held.join(text, ["session", "finding_id"]).select("session", "finding_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("violation"))


def seal(reports: DataFrame, violations: DataFrame) -> DataFrame:
    """Sessions whose report has no violation."""
    return reports.select("session").distinct().join(violations.select("session").distinct(), "session", "left_anti")


def audit(sessions: DataFrame, views: DataFrame, files: DataFrame, sealed: DataFrame) -> DataFrame:
    """session, views, missing_files, changed_files, orphans, state. files: session, native_path, sha256; views carry
    native_path and native_sha256 where a crop was written."""
    crops = views.where("native_path is not null").select("session", "native_path", "native_sha256")
    met = crops.join(files.withColumnRenamed("sha256", "found"), ["session", "native_path"], "left")
    checked = met.groupBy("session").agg(F.sum(F.col("found").isNull().cast("int")).alias("missing_files"), F.sum((F.col("found") != F.col("native_sha256")).cast("int")).alias("changed_files"))
    lost = files.join(crops.select("session", "native_path"), ["session", "native_path"], "left_anti").groupBy("session").agg(F.count(F.lit(1)).alias("orphans"))
    n = views.groupBy("session").agg(F.count(F.lit(1)).alias("views"))
    out = sessions.select("session").join(n, "session", "left").join(checked, "session", "left").join(lost, "session", "left").join(sealed.select("session", F.lit(True).alias("sealed")).distinct(), "session", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("views", "missing_files", "changed_files", "orphans")})
    return out.withColumn("state", L.session_state(F.coalesce("sealed", F.lit(False)), F.col("orphans"))).drop("sealed")


def packets(records: DataFrame, sessions: DataFrame, views: DataFrame) -> DataFrame:
    """One row a record: the session it binds to by pixel hash, violations of the binding, coverage of its views.
    records: record_id, pixel_sha256, file_sha256, width, height."""
    bound = L.bind(records, sessions, "pixel_sha256", ["file_sha256", "width", "height"])
    owner = sessions.select("pixel_sha256", "session", F.struct(F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), F.col("width").cast("long").alias("x1"), F.col("height").cast("long").alias("y1")).alias("target"))
    seen = views.withColumn("native", F.col("native_path").isNotNull()).join(owner.select("session", "target"), "session")
    cover = coverage(seen, F.col("target"), "session")
    return bound.join(owner.drop("target"), "pixel_sha256", "left").join(cover, "session", "left").withColumn("quality_decision", F.lit(None).cast("string"))


def verify_region(parent: DataFrame, child: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """side, y, x, v: samples of the crop that aren't the parent's (`crop`), and samples of the parent's box that the crop
    lacks or has otherwise (`missing`), by the parent's places. Empty if and only if the crop is exact."""
    placed = child.select((F.col("y") + y0).alias("y"), (F.col("x") + x0).alias("x"), "v")
    box = parent.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)).select("y", "x", "v")
    return L.differences(box, placed).select(F.when(F.col("side") == "left", "missing").otherwise("crop").alias("side"), "y", "x", "v")
