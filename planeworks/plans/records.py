"""Queries on the ledger, evidence, placement and policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeworks.functions import policy
from planeworks.functions.boxes import box
from planeworks.operators import ledger as L
from planeworks.plans.pixels import E
from planeworks.sources import planes as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 420000)")
def orphan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, their large orders as the records that name them."""
    files = P.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return L.orphans(files, P.table(spark, sf_dir, "orders").where("o_totalprice > 420000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT o_orderkey, array_to_string(CASE WHEN c_custkey IS NULL THEN ['missing'] ELSE list_filter([CASE WHEN s.c_nationkey IS DISTINCT FROM CAST(o_orderkey % 25 AS INTEGER) THEN 'c_nationkey' END, CASE WHEN s.c_mktsegment IS DISTINCT FROM (CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END) THEN 'c_mktsegment' END], lambda x: x IS NOT NULL) END, ',') AS violations
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) s ON s.c_custkey = o_custkey""")
def evidence_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    records = P.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (key % 25).cast("int").alias("c_nationkey"), F.when(key % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("c_mktsegment"))
    sessions = P.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    return L.bind(records, sessions, "c_custkey", ["c_nationkey", "c_mktsegment"]).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@query("""WITH f AS (SELECT o_orderkey AS finding_id, o_orderkey % 50 AS x0, o_orderkey % 30 AS y0, [o_orderkey % 400, o_custkey % 400 + 100, o_custkey % 7] AS ev FROM orders), n AS (SELECT finding_id, x0, y0, unnest(ev) AS view_id FROM f),
v AS (SELECT s_suppkey AS view_id, s_suppkey % 20 AS x0, s_suppkey % 10 AS y0, s_suppkey % 20 + 60 AS x1, s_suppkey % 10 + 40 AS y1 FROM supplier)
SELECT finding_id, count(*) FILTER (v.view_id IS NULL) AS missing, coalesce(bool_or(v.x0 <= n.x0 AND v.y0 <= n.y0 AND v.x1 >= n.x0 + 5 AND v.y1 >= n.y0 + 5), false) AS supported FROM n LEFT JOIN v USING (view_id) GROUP BY 1""")
def finding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    findings = P.table(spark, sf_dir, "orders").select(k.alias("finding_id"), box(k % 50, k % 30, k % 50 + 5, k % 30 + 5).alias("box"), F.array(k % 400, c % 400 + 100, c % 7).alias("evidence"))
    s = F.col("s_suppkey")
    views = P.table(spark, sf_dir, "supplier").select(s.alias("view_id"), box(s % 20, s % 10, s % 20 + 60, s % 10 + 40).alias("view_box"))
    return L.check_findings(findings, views)


_SETTLED = """WITH r AS (SELECT user_id AS session, event_id % 5 AS request_id, event_type AS args, event_id AS seq FROM events),
a AS (SELECT *, row_number() OVER w = 1 AS f, first_value(args) OVER w AS fa FROM r WINDOW w AS (PARTITION BY session, request_id ORDER BY seq)),
p AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS place FROM a), o AS (SELECT *, max(CASE WHEN f THEN place END) OVER (PARTITION BY session, request_id) AS own FROM p),
s AS (SELECT session, request_id, args, seq, CASE WHEN own > 3 THEN 'over_budget' WHEN f THEN 'committed' WHEN args IS NOT DISTINCT FROM fa THEN 'replayed' ELSE 'conflict' END AS status FROM o)"""


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = P.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 5).alias("request_id"), F.col("event_type").alias("args"), F.col("event_id").alias("seq"))
    return L.settle_requests(requests, 3)


@query(_SETTLED + " SELECT * FROM s")
def idempotent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, sf_dir)


@query(_SETTLED + " SELECT session, count(*) FILTER (status = 'committed') AS used, 3 - count(*) FILTER (status = 'committed') AS \"left\", count(*) FILTER (status = 'over_budget') AS refused, count(*) FILTER (status = 'conflict') AS conflicts FROM s GROUP BY session")
def budget_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.budget_state(_settled(spark, sf_dir), 3)


_JOBS = """jb AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN '-' || c_name ELSE replace(c_name, '#', '-') END AS asset_id, CASE WHEN c_custkey % 13 = 0 THEN '../' || c_name WHEN c_custkey % 17 = 0 THEN '/' || c_name ELSE 'planes/' || c_name END AS relative_path,
  CASE WHEN c_custkey % 19 = 0 THEN upper(sha256(c_name)) ELSE sha256(c_name) END AS source_file_sha256, CASE WHEN c_custkey % 23 = 0 THEN 0 ELSE c_custkey * 512 END AS size_bytes FROM customer)"""
_PLACED = f"""WITH {_JOBS}, w AS (SELECT *, list_filter([CASE WHEN NOT regexp_full_match(asset_id, '[A-Za-z0-9][A-Za-z0-9._-]{{0,127}}') THEN 'bad_asset_id' END, CASE WHEN relative_path LIKE '/%' OR relative_path LIKE '../%' THEN 'bad_relative_path' END, CASE WHEN NOT regexp_full_match(source_file_sha256, '[0-9a-f]{{64}}') THEN 'bad_sha256' END, CASE WHEN size_bytes <= 0 THEN 'bad_size' END], lambda x: x IS NOT NULL) AS reasons FROM jb),
q AS (SELECT *, CASE WHEN len(reasons) = 0 THEN list_reduce([CAST(0 AS BIGINT)] || [CAST(instr('0123456789abcdef', substr(sha256(asset_id), i, 1)) - 1 AS BIGINT) FOR i IN range(1, 65)], lambda acc, d: (acc * 16 + d) % 7) END AS node FROM w)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    jobs = P.table(spark, sf_dir, "customer").select(
        F.when(k % 11 == 0, F.concat(F.lit("-"), name)).otherwise(F.replace(name, F.lit("#"), F.lit("-"))).alias("asset_id"),
        F.when(k % 13 == 0, F.concat(F.lit("../"), name)).when(k % 17 == 0, F.concat(F.lit("/"), name)).otherwise(F.concat(F.lit("planes/"), name)).alias("relative_path"),
        F.when(k % 19 == 0, F.upper(F.sha2(name, 256))).otherwise(F.sha2(name, 256)).alias("source_file_sha256"), F.when(k % 23 == 0, 0).otherwise(k * 512).alias("size_bytes"),
    )
    return L.place_jobs(jobs, 7)


@query(_PLACED + " SELECT asset_id, relative_path, node FROM q WHERE len(reasons) = 0")
def sha_mod_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).where(F.size("reasons") == 0).select("asset_id", "relative_path", "node")


@query(_PLACED + " SELECT node, count(*) AS jobs, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM q WHERE node IS NOT NULL GROUP BY node")
def node_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.node_totals(_placed(spark, sf_dir))


@query(_PLACED + " SELECT asset_id, array_to_string(reasons, ',') AS reasons FROM q WHERE len(reasons) > 0")
def manifest_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).where(F.size("reasons") > 0).select("asset_id", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS sha FROM customer""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = policy.canonical_json(["c_name", "c_custkey", "c_nationkey", "c_mktsegment"])
    return P.table(spark, sf_dir, "customer").select("c_custkey", F.sha2(text, 256).alias("sha"))


@query("""WITH f AS (SELECT doc_id, toxic, quality, n_chars FROM labels JOIN documents USING (doc_id)), r AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN toxic = 1 THEN 'pattern_candidate' END, CASE WHEN quality = 0 THEN 'low_support' END, CASE WHEN n_chars > 5000 THEN 'budget_omissions' END, CASE WHEN n_chars < 100 THEN 'unassessed' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f)
SELECT doc_id, reasons, CASE WHEN reasons = '' THEN 'routine' ELSE 'review' END AS route, CAST(NULL AS VARCHAR) AS quality_decision FROM r""")
def triage_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = P.table(spark, sf_dir, "labels").join(P.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    why = policy.reasons((F.col("toxic") == 1, "pattern_candidate"), (F.col("quality") == 0, "low_support"), (F.col("n_chars") > 5000, "budget_omissions"), (F.col("n_chars") < 100, "unassessed"))
    return facts.select("doc_id", F.array_join(why, ",").alias("reasons"), F.when(F.size(why) == 0, "routine").otherwise("review").alias("route"), F.lit(None).cast("string").alias("quality_decision"))


@query(f"WITH {E} SELECT 2 * count(*) FILTER (y % 97 = 0 AND x = 3) AS different, count(*) AS compared FROM e")
def equality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane against a copy with some samples changed: each differs on both sides."""
    a = P.embedding_plane(spark, sf_dir)
    b = a.withColumn("v", F.col("v") + F.when((F.col("y") % 97 == 0) & (F.col("x") == 3), 1).otherwise(0))
    n = L.differences(a, b).agg(F.count(F.lit(1)).alias("different"))
    return n.join(a.agg(F.count(F.lit(1)).alias("compared")))


@query("SELECT c_name, count(*) AS cnt FROM (SELECT substr(c_name, 1, 17) AS c_name FROM customer) GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.repeated(P.table(spark, sf_dir, "customer").select(F.substring("c_name", 1, 17).alias("c_name")), "c_name")
