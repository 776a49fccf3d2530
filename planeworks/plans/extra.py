"""Queries on sessions, geometry, subsampling and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planeworks import registry
from planeworks.functions import boxes as B
from planeworks.operators import geometry as G
from planeworks.operators import ledger as L
from planeworks.operators import selection as S
from planeworks.operators import session
from planeworks.operators import supporting as U
from planeworks.operators import windows as W
from planeworks.plans.boxes import BX
from planeworks.plans.pixels import E, rounded
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


_KNOTS = "k AS (SELECT user_id, CAST(epoch(ts) AS DOUBLE) AS x, avg(value) AS y FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2), a AS (SELECT DISTINCT user_id, CAST(epoch(ts) AS DOUBLE) AS x FROM events WHERE event_id % 3 = 0)"


@query(f"""WITH {_KNOTS}, p AS (SELECT a.user_id, a.x, max(k.x) AS px FROM a LEFT JOIN k ON k.user_id = a.user_id AND k.x <= a.x GROUP BY 1, 2), q AS (SELECT a.user_id, a.x, min(k.x) AS qx FROM a LEFT JOIN k ON k.user_id = a.user_id AND k.x >= a.x GROUP BY 1, 2)
SELECT p.user_id, p.x, round(CASE WHEN px IS NULL THEN kq.y WHEN qx IS NULL THEN kp.y WHEN qx = px THEN kp.y ELSE kp.y + (kq.y - kp.y) / (qx - px) * (p.x - px) END, 4) AS value
FROM p JOIN q ON p.user_id = q.user_id AND p.x = q.x LEFT JOIN k kp ON kp.user_id = p.user_id AND kp.x = px LEFT JOIN k kq ON kq.user_id = p.user_id AND kq.x = qx""")
def interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("x"), "value")
    knots = events.where("event_id % 3 <> 0").groupBy("user_id", "x").agg(F.avg("value").alias("y"))
    asked = events.where("event_id % 3 = 0").select("user_id", "x").distinct()
    return rounded(G.interpolate(knots, asked, "user_id"), "value", digits=4)


@query(f"WITH {BX}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY box_id, x0, x1) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM bx) SELECT grp, i, n FROM r WHERE n <= 12 OR list_contains([j * (n - 1) // 11 FOR j IN range(12)], i)")
def even_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.even_samples(_numbered(spark, sf_dir), "i", F.col("n")).select("grp", "i", "n")


@query(f"WITH {BX}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY box_id, x0, x1) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM bx) SELECT grp, i, n FROM r WHERE n <= 50 OR list_contains([j * n // 50 FOR j IN range(50)], i)")
def uniform_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.uniform_subsample(_numbered(spark, sf_dir), "i", F.col("n"), 50).select("grp", "i", "n")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("grp")
    return P.boxes(spark, sf_dir).withColumn("i", (F.row_number().over(own.orderBy("box_id", "x0", "x1")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(own))


@query(f"WITH {BX}, m AS (SELECT grp, box_id AS id, (x1 - x0) AS score, CASE WHEN box_id % 2 = 0 THEN 0 ELSE 1 END AS k FROM bx), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, k, id) AS rank FROM m) SELECT grp, id, score, CAST(k AS INTEGER) AS kind_order, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def merged_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = P.boxes(spark, sf_dir).select("grp", F.col("box_id").alias("id"), (F.col("x1") - F.col("x0")).alias("score"))
    return S.merge_topk([sized.where("id % 2 = 0"), sized.where("id % 2 <> 0")], 5, "score", "grp").select("grp", "id", "score", "kind_order", "rank")


@query(f"""WITH {E} SELECT y, x, x >= 8 AND y >= 8 AND x <= 56 AND y <= h - 8 AND pow((x - 32) / 32.0, 2) + pow((y - h / 2.0) / (h / 2.0), 2) <= 0.7 * 0.7::DOUBLE AS central, round(10 + x * cos(radians(30)) - y * sin(radians(30)), 4) AS rx, round(20 + x * sin(radians(30)) + y * cos(radians(30)), 4) AS ry FROM e, (SELECT max(y) + 1 AS h FROM e)""")
def frame_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    rx, ry = G.rotate_point(x, y, F.lit(30.0), F.lit(10), F.lit(20))
    e = P.embedding_plane(spark, sf_dir)
    framed = e.join(F.broadcast(e.agg((F.max("y") + 1).alias("h"))))  # one row
    out = framed.select("y", "x", B.in_central_ellipse(x, y, F.lit(64), F.col("h"), 8).alias("central"), rx.alias("rx"), ry.alias("ry"))
    return rounded(out, "rx", "ry", digits=4)


@query(f"""WITH {E}, b AS (SELECT y, x, (coalesce(lag(v) OVER c, lead(v) OVER c, v) + v + coalesce(lead(v) OVER c, lag(v) OVER c, v)) / 3.0 AS m FROM e WINDOW c AS (PARTITION BY x ORDER BY y)), d AS (SELECT y, x, m - lag(m) OVER (PARTITION BY y ORDER BY x) AS jump FROM b)
SELECT y, round(max(abs(jump)), 4) AS jump, count(*) FILTER (abs(jump) > 3000) AS transitions FROM d GROUP BY y""")
def row_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    along = Window.partitionBy("y").orderBy("x")
    jumps = W.three_rows(P.embedding_plane(spark, sf_dir)).withColumn("jump", F.abs(F.col("m") - F.lag("m").over(along)))
    return rounded(jumps.groupBy("y").agg(F.max("jump").alias("jump"), F.count(F.when(F.col("jump") > 3000, 1)).alias("transitions")), "jump", digits=4)


@query("""WITH o AS (SELECT o_orderkey % 40 AS session, o_orderkey % 9 AS request_id, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'detail' ELSE 'preview' END AS kind, o_custkey % 90 AS x0, o_custkey % 50 AS y0, o_custkey % 90 + 1 + o_orderkey % 30 AS x1, o_custkey % 50 + 10 AS y1 FROM orders),
c AS (SELECT *, CASE WHEN session >= 35 THEN 'no_session' WHEN session % 10 = 3 THEN 'sealed' WHEN x1 > 100 OR y1 > 100 THEN 'bad_box' END AS refused, concat_ws(':', kind, x0, y0, x1, y1) AS args, 2 + session % 5 - 1 AS room FROM o),
g AS (SELECT *, min(seq) OVER (PARTITION BY session, request_id) AS first, first_value(args) OVER (PARTITION BY session, request_id ORDER BY seq) AS fa FROM c WHERE refused IS NULL), k AS (SELECT *, dense_rank() OVER (PARTITION BY session ORDER BY first) AS rank FROM g),
s AS (SELECT *, CASE WHEN rank > room THEN 'over_budget' WHEN seq = first THEN 'committed' WHEN args = fa THEN 'replayed' ELSE 'conflict' END AS status FROM k)
SELECT session, request_id, seq, status, CASE WHEN status IN ('committed', 'replayed') THEN 'view-' || lpad(CAST(rank AS VARCHAR), 3, '0') END AS view_id FROM s UNION ALL SELECT session, request_id, seq, refused, NULL FROM c WHERE refused IS NOT NULL""")
def view_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = P.table(spark, sf_dir, "orders").select(
        (k % 40).alias("session"), (k % 9).alias("request_id"), k.alias("seq"), F.when(k % 2 == 0, "detail").otherwise("preview").alias("kind"), (c % 90).alias("x0"), (c % 50).alias("y0"), (c % 90 + 1 + k % 30).alias("x1"), (c % 50 + 10).alias("y1")
    )
    owned = spark.range(35).select(F.col("id").alias("session"), F.lit(100).cast("long").alias("width"), F.lit(100).cast("long").alias("height"), (2 + F.col("id") % 5).cast("int").alias("budget"))
    return session.request_views(asked, owned, owned.where("session % 10 = 3").select("session"))


@query("""WITH v AS (SELECT s_suppkey % 25 AS session, s_suppkey AS native_path, s_suppkey % 4 AS sha FROM supplier), f AS (SELECT s_suppkey % 25 AS session, s_suppkey + CASE WHEN s_suppkey % 6 = 0 THEN 100000 ELSE 0 END AS native_path, s_suppkey % 5 AS sha FROM supplier)
SELECT s.session, (SELECT count(*) FROM v WHERE v.session = s.session) AS views, (SELECT count(*) FROM v WHERE v.session = s.session AND NOT EXISTS (SELECT 1 FROM f WHERE f.session = v.session AND f.native_path = v.native_path)) AS missing_files,
(SELECT count(*) FROM v JOIN f USING (session, native_path) WHERE v.session = s.session AND v.sha <> f.sha) AS changed_files, (SELECT count(*) FROM f WHERE f.session = s.session AND NOT EXISTS (SELECT 1 FROM v WHERE f.session = v.session AND f.native_path = v.native_path)) AS orphans,
CASE WHEN s.session % 5 = 0 THEN 'sealed' WHEN (SELECT count(*) FROM f WHERE f.session = s.session AND NOT EXISTS (SELECT 1 FROM v WHERE f.session = v.session AND f.native_path = v.native_path)) > 0 THEN 'pending' ELSE 'active' END AS state FROM (SELECT CAST(unnest(range(25)) AS BIGINT) AS session) s""")
def session_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    table = P.table(spark, sf_dir, "supplier")
    views = table.select((s % 25).alias("session"), s.cast("string").alias("native_path"), (s % 4).cast("string").alias("native_sha256"))
    files = table.select((s % 25).alias("session"), (s + F.when(s % 6 == 0, 100000).otherwise(0)).cast("string").alias("native_path"), (s % 5).cast("string").alias("sha256"))
    owned = spark.range(25).select(F.col("id").alias("session"))
    return session.audit(owned, views, files, owned.where("session % 5 = 0"))


@query(f"""WITH {E.replace(" AS (", " AS MATERIALIZED (", 1)}, c AS (SELECT y, x, v, v + CASE WHEN x = 9 AND y % 50 = 0 THEN 1 ELSE 0 END AS w FROM e WHERE y >= 7 AND y < 300 AND x >= 5 AND x < 40)
SELECT 'missing' AS side, y, x, v FROM c WHERE w <> v OR (x = 20 AND y % 60 = 0) UNION ALL SELECT 'crop', y, x, w FROM c WHERE w <> v AND NOT (x = 20 AND y % 60 = 0)""")
def region_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop of rows 7 to 299 and columns 5 to 39 in which some samples are changed and some are missing."""
    e = P.embedding_plane(spark, sf_dir)
    changed = F.col("v") + F.when((F.col("x") == 9) & (F.col("y") % 50 == 0), 1).otherwise(0)
    child = e.where("y >= 7 AND y < 300 AND x >= 5 AND x < 40 AND NOT (x = 20 AND y % 60 = 0)").select((F.col("y") - 7).alias("y"), (F.col("x") - 5).alias("x"), changed.alias("v"))
    return session.verify_region(e, child, 5, 7, 40, 300)


@query("WITH o AS (SELECT o_orderkey % 500 AS k, o_orderstatus AS s FROM orders) SELECT 'left' AS side, k, s FROM (SELECT k, s FROM o WHERE k < 300 EXCEPT ALL SELECT k, s FROM o WHERE k >= 5) UNION ALL SELECT 'right', k, s FROM (SELECT k, s FROM o WHERE k >= 5 EXCEPT ALL SELECT k, s FROM o WHERE k < 300)")
def multiset_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 500).alias("k"), F.col("o_orderstatus").alias("s"))
    return L.differences(o.where("k < 300"), o.where("k >= 5"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{s}', {str(i).lower()})" for m, s, i in registry.METHODS) + ") t(method, scope, implemented)")
def method_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.methods(spark)


#: The overview of the embeddings' plane at 128 cells a side, with its closed foreground (fg), for DuckDB.
_FG = f"""{E.replace(" AS (", " AS MATERIALIZED (", 1)}, sz AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w, CAST(greatest(1, ceil(greatest(max(y) + 1, max(x) + 1) / 128)) AS BIGINT) AS step FROM e),
o AS MATERIALIZED (SELECT y // step AS cy, x // step AS cx, v, (h + step - 1) // step AS height, (w + step - 1) // step AS width, step FROM e, sz WHERE y % step = 0 AND x % step = 0),
q AS (SELECT quantile_cont(v, 0.01) AS low, quantile_cont(v, 0.995) AS high FROM o), g AS MATERIALIZED (SELECT o.*, low, high, CASE WHEN high > low THEN CAST(floor(least(1.0, greatest(0.0, (v - low) / (high - low))) * 255 + 0.5) AS BIGINT) END AS g FROM o, q),
hi AS (SELECT g, count(*) AS c FROM g WHERE g IS NOT NULL GROUP BY g), ru AS (SELECT g, sum(c) OVER (ORDER BY g) AS a, sum(CAST(g AS DOUBLE) * c) OVER (ORDER BY g) AS m, sum(c) OVER () AS n, sum(CAST(g AS DOUBLE) * c) OVER () AS t FROM hi),
th AS (SELECT g AS threshold FROM ru WHERE a < n ORDER BY round(pow(t / n * (a / n) - m / n, 2) / ((a / n) * (1 - a / n)), 6) DESC, 1 LIMIT 1),
f0 AS (SELECT g.*, (SELECT threshold FROM th) AS threshold, CASE WHEN g > (SELECT threshold FROM th) THEN 1 ELSE 0 END AS f FROM g),
f1 AS (SELECT * EXCLUDE f, max(f) OVER (PARTITION BY cy ORDER BY cx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS f FROM f0), f2 AS (SELECT * EXCLUDE f, max(f) OVER (PARTITION BY cx ORDER BY cy ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS f FROM f1),
f3 AS (SELECT * EXCLUDE f, min(f) OVER (PARTITION BY cy ORDER BY cx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS f FROM f2), fg AS MATERIALIZED (SELECT * EXCLUDE f, min(f) OVER (PARTITION BY cx ORDER BY cy ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS fg FROM f3),
px AS MATERIALIZED (SELECT e.y, e.x, e.v, y // 64 AS py, x // 64 AS px, CASE WHEN fg.fg = 1 THEN e.v END AS own FROM e, sz JOIN fg ON fg.cy = e.y // sz.step AND fg.cx = e.x // sz.step),
lp AS (SELECT *, CAST(lag(own) OVER r + lead(own) OVER r + lag(own) OVER c + lead(own) OVER c - 4 * own AS DOUBLE) AS lap FROM px WINDOW r AS (PARTITION BY py, px, y ORDER BY x), c AS (PARTITION BY py, px, x ORDER BY y)),
pt AS (SELECT py, px, count(*) AS n, count(own) AS fg_n, var_pop(own) AS variance, count(lap) AS support, avg(lap * lap) AS energy, avg(lap * lap) / nullif(var_pop(own), 0) AS detail FROM lp GROUP BY 1, 2),
bc AS (SELECT cy, cx, v, fg, low, high, cy * least(8, height) // height AS iy, cx * least(8, width) // width AS ix, height, width FROM fg),
bd AS (SELECT iy + CASE WHEN (iy + 1) * height // least(8, height) <= cy THEN 1 ELSE 0 END AS ky, ix + CASE WHEN (ix + 1) * width // least(8, width) <= cx THEN 1 ELSE 0 END AS kx, v, fg, low, high FROM bc),
be AS (SELECT ky, kx, CASE WHEN count(*) FILTER (fg = 0) >= 32 AND count(*) FILTER (fg = 0) / count(*) >= 0.8 THEN quantile_cont(v, 0.5) FILTER (fg = 0) END AS median, any_value(low) AS low, any_value(high) AS high FROM bd GROUP BY 1, 2),
bs AS (SELECT count(*) AS background_cells, count(median) AS eligible_cells, quantile_cont(median, 0.1) AS p10, quantile_cont(median, 0.9) AS p90, any_value(high - low) AS range FROM be)"""


def _plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.embedding_plane(spark, sf_dir).withColumn("plane_id", F.lit("embeddings"))


@query(f"WITH {_FG} SELECT py, px, n, fg_n, round(fg_n / n, 6) AS fg_share, round(variance, 3) AS variance, support, round(energy, 3) AS energy, round(detail, 6) AS detail FROM pt")
def foreground_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _plane(spark, sf_dir)
    out = U.patch_detail(pixels, U.foreground(U.overview(pixels, 128)), 64).select("py", "px", "n", "fg_n", "fg_share", "variance", "support", "energy", "detail")
    return rounded(rounded(out, "fg_share", "detail"), "variance", "energy", digits=3)


@query(f"""WITH {_FG} SELECT (SELECT count(*) FROM e) AS n, (SELECT count(*) FROM pt) AS patches, (SELECT count(detail) FROM pt) AS valid_patches, (SELECT round(quantile_cont(detail, 0.5), 6) FROM pt) AS median_detail,
(SELECT CAST(sum(fg_n) AS BIGINT) FROM pt) AS foreground, (SELECT round(sum(fg_n) / sum(n), 6) FROM pt) AS foreground_share, (SELECT step FROM sz) AS step, (SELECT threshold FROM th) AS threshold, background_cells, eligible_cells,
CASE WHEN eligible_cells >= 4 THEN round(p10, 4) END AS p10_median, CASE WHEN eligible_cells >= 4 THEN round(p90, 4) END AS p90_median, CASE WHEN eligible_cells >= 4 THEN round(p90 - p10, 4) END AS span, CASE WHEN eligible_cells >= 4 THEN round((p90 - p10) / nullif(range, 0), 4) END AS span_share FROM bs""")
def supporting_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.supporting_metrics(_plane(spark, sf_dir), 64, 128)
    named = out.select("n", "patches", "valid_patches", "median_detail", "foreground", "foreground_share", "step", "threshold", "background_cells", "eligible_cells", "p10_median", "p90_median", "span", "span_share")
    return rounded(rounded(named, "median_detail", "foreground_share"), "p10_median", "p90_median", "span", "span_share", digits=4)


@query(f"WITH {E} SELECT y // 4 AS cy, x // 4 AS cx, round(avg(CASE WHEN v >= 12000 THEN 1 ELSE 0 END), 6) AS share, avg(CASE WHEN v >= 12000 THEN 1 ELSE 0 END) >= 0.99 AS inside FROM e GROUP BY ALL")
def fraction_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.fraction_mask(P.embedding_plane(spark, sf_dir), F.col("v") >= 12000, 4), "share")
