"""An append-only ledger of view requests: idempotency, budgets, audits, binding of evidence; placement of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeworks.functions.boxes import contains
from planeworks.functions.policy import hash_mod, job_reasons


def settle_requests(requests: DataFrame, budget: int) -> DataFrame:
    """Requests (session, request_id, args, seq) with status, in order of seq:

    * `committed`: the first of its request_id, within the session's budget;
    * `replayed`: a repeat with the same arguments (it never costs budget);
    * `conflict`: a repeat with other arguments;
    * `over_budget`: the first of its request_id, beyond the budget.

    One window by (session, request_id) and one by session over first requests only."""
    same = Window.partitionBy("session", "request_id").orderBy("seq")
    marked = requests.withColumn("first", F.row_number().over(same) == 1).withColumn("first_args", F.first("args").over(same))
    place = F.sum(F.col("first").cast("int")).over(Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = marked.withColumn("place", place)
    owner = F.max(F.when(F.col("first"), F.col("place"))).over(Window.partitionBy("session", "request_id"))
    status = (
        F.when(F.col("first"), F.when(F.col("place") <= budget, "committed").otherwise("over_budget"))
        .when(F.col("owner") > budget, "over_budget")
        .when(F.col("args").eqNullSafe(F.col("first_args")), "replayed")
        .otherwise("conflict")
    )
    return placed.withColumn("owner", owner).withColumn("status", status).select("session", "request_id", "args", "seq", "status")


def budget_state(settled: DataFrame, budget: int) -> DataFrame:
    """session, used, left, refused, conflicts."""
    n = lambda s: F.sum((F.col("status") == s).cast("int"))
    return settled.groupBy("session").agg(n("committed").alias("used"), n("over_budget").alias("refused"), n("conflict").alias("conflicts")).select("session", "used", (F.lit(budget) - F.col("used")).alias("left"), "refused", "conflicts")


def orphans(files: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Files that no ledger row names."""
    return files.join(ledger.select(key).distinct(), key, "left_anti")


def session_state(sealed: Column, pending: Column) -> Column:
    return F.when(sealed, "sealed").when(pending > 0, "pending").otherwise("active")


def bind(records: DataFrame, sessions: DataFrame, on: str, checks: list[str]) -> DataFrame:
    """Every record with its session and the names of the columns that disagree; no session: reason `missing`."""
    right = sessions.select(F.col(on), *[F.col(c).alias(f"session_{c}") for c in checks], F.lit(True).alias("found"))
    joined = records.join(right, on, "left")
    rules = [F.when(~F.col(c).eqNullSafe(F.col(f"session_{c}")), F.lit(c)) for c in checks]
    differs = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return joined.withColumn("violations", F.when(F.col("found").isNull(), F.array(F.lit("missing"))).otherwise(differs)).drop("found", *[f"session_{c}" for c in checks])


def check_findings(findings: DataFrame, views: DataFrame) -> DataFrame:
    """finding_id, missing (evidence views that don't exist), supported (one of them contains the finding's box).
    findings: finding_id, box, evidence (array of view ids); views: view_id, view_box."""
    named = findings.select("finding_id", "box", F.explode_outer("evidence").alias("view_id"))
    met = named.join(views, "view_id", "left")
    missing = F.sum((F.col("view_id").isNotNull() & F.col("view_box").isNull()).cast("int"))
    return met.groupBy("finding_id").agg(missing.alias("missing"), F.coalesce(F.max(contains(F.col("view_box"), F.col("box"))), F.lit(False)).alias("supported"))


def place_jobs(jobs: DataFrame, nodes: int) -> DataFrame:
    """jobs with node (sha256 of the id, modulo nodes) and reasons (why a row is rejected). Each row on its own, so a
    job's node doesn't change as the manifest grows."""
    if not 1 <= nodes <= 64:
        raise ValueError("1 to 64 nodes")
    why = job_reasons(F.col("asset_id"), F.col("relative_path"), F.col("source_file_sha256"), F.col("size_bytes"))
    return jobs.withColumn("reasons", why).withColumn("node", F.when(F.size(why) == 0, hash_mod(F.col("asset_id"), F.lit(nodes).cast("long"))))


def node_totals(placed: DataFrame) -> DataFrame:
    return placed.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("jobs"), F.sum("size_bytes").alias("bytes"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, rows that only one side has (as a multiset): empty if and only if the two are equal."""
    cols = a.columns
    return a.exceptAll(b.select(*cols)).withColumn("side", F.lit("left")).unionByName(b.select(*cols).exceptAll(a).withColumn("side", F.lit("right")))


def jobs_of(placed: DataFrame, assets: DataFrame, node: int) -> DataFrame:
    """assets (asset_id) with status: `assigned` where the plan places them on this node, `elsewhere` (with the node that
    has them), `rejected` (with the reasons), or `unknown`. placed: as place_jobs gives it."""
    met = assets.select("asset_id").join(placed.select("asset_id", "node", "reasons"), "asset_id", "left")
    status = F.when(F.col("reasons").isNull(), "unknown").when(F.size("reasons") > 0, "rejected").when(F.col("node") == node, "assigned").otherwise("elsewhere")
    return met.withColumn("status", status)


def largest_support(rows: DataFrame, owners: DataFrame, key: str, value: str) -> DataFrame:
    """key, support: the greatest value of each owner's rows, 0 where it has none."""
    best = rows.groupBy(key).agg(F.max(value).alias("support"))
    return owners.select(key).distinct().join(best, key, "left").select(key, F.coalesce("support", F.lit(0)).alias("support"))
