"""Queries on boxes, tiles, labels and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeworks.functions import boxes as B
from planeworks.operators import aggregates as A
from planeworks.operators import selection as S
from planeworks.operators import spatial as X
from planeworks.plans.pixels import E, rounded
from planeworks.sources import planes as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The boxes of lineitem and a 100 x 130 label grid of cells of 4 samples, for DuckDB.
BX = """bx AS (SELECT l_orderkey * 8 + l_linenumber AS box_id, l_suppkey AS grp, l_partkey % 300 AS x0, l_suppkey % 90 AS y0, l_partkey % 300 + 1 + l_orderkey % 40 AS x1, l_suppkey % 90 + 1 + l_linenumber * 3 AS y1 FROM lineitem)"""
LB = "lb AS (SELECT cy, cx, CAST(CASE WHEN cx < 20 THEN 1 WHEN cx < 35 THEN 2 WHEN cx < 70 THEN 3 WHEN (cx + cy) % 7 = 0 THEN 4 ELSE 0 END AS INTEGER) AS code FROM range(40) a(cy), range(100) b(cx))"
STEP = 4


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def labels(spark: SparkSession) -> DataFrame:
    """cy, cx, code: a synthetic label grid of cells of STEP samples (4000 cells)."""
    cells = spark.range(4000).select(F.expr("id div 100").alias("cy"), (F.col("id") % 100).alias("cx"))
    cx, cy = F.col("cx"), F.col("cy")
    return cells.withColumn("code", F.when(cx < 20, 1).when(cx < 35, 2).when(cx < 70, 3).when((cx + cy) % 7 == 0, 4).otherwise(0))


_SHAPES = "sh AS (SELECT p_partkey, CAST(300 + p_partkey * 37 % 900 AS BIGINT) AS height, CAST(200 + p_partkey * 53 % 1100 AS BIGINT) AS width FROM part)"
_PLAN = f"""WITH {_SHAPES}, n AS (SELECT *, greatest(0, height - 256) AS ly, greatest(0, width - 256) AS lx FROM sh),
g AS (SELECT *, ly // 192 + 1 + CASE WHEN ly % 192 <> 0 THEN 1 ELSE 0 END AS ny, lx // 192 + 1 + CASE WHEN lx % 192 <> 0 THEN 1 ELSE 0 END AS nx FROM n),
y AS (SELECT *, unnest(range(0, ny)) AS iy FROM g), t AS (SELECT *, unnest(range(0, nx)) AS ix FROM y),
plan AS (SELECT p_partkey, iy * nx + ix AS grid_index, least(ix * 192, lx) AS x0, least(iy * 192, ly) AS y0, least(least(ix * 192, lx) + 256, width) AS x1, least(least(iy * 192, ly) + 256, height) AS y1, nx * ny AS total FROM t)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    shapes = P.table(spark, sf_dir, "part").select("p_partkey", (300 + k * 37 % 900).alias("height"), (200 + k * 53 % 1100).alias("width"))
    return X.tile_plan(shapes, 256, 192, "p_partkey")


@query(_PLAN + " SELECT p_partkey, grid_index, x0, y0, x1, y1 FROM plan")
def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(_PLAN + """ SELECT p_partkey, grid_index, x0, y0, x1, y1, total, CASE WHEN total <= 7 OR list_contains([i * total // 7 FOR i IN range(7)], grid_index) THEN 'planned' ELSE 'omitted' END AS status, greatest(0, total - 7) AS omitted FROM plan""")
def tile_plan_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.within_budget(_plan(spark, sf_dir), 7, "p_partkey")


@query(f"""WITH {BX} SELECT box_id, x1 <= 300 AND y1 <= 100 AS valid, x0 >= 50 AND y0 >= 20 AND x1 <= 250 AND y1 <= 80 AS inside,
CASE WHEN greatest(x0, 50) < least(x1, 250) AND greatest(y0, 20) < least(y1, 80) THEN (least(x1, 250) - greatest(x0, 50)) * (least(y1, 80) - greatest(y0, 20)) END AS common,
round(sqrt(pow(greatest(0, x0 - 250, 50 - x1), 2) + pow(greatest(0, y0 - 80, 20 - y1), 2)), 6) AS gap, 11 + x0 * 3 AS nx0, least(11 + x1 * 3, 700) AS nx1, x0 + 7 AS px0, y1 + 9 AS py1, x0 * 8 AS cx0, least(x1 * 8, 2000) AS cx1,
CAST(abs(((x0 - y0 + 90) % 180 + 180) % 180 - 90) AS DOUBLE) AS angle FROM bx""")
def box_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, n = F.struct("x0", "y0", "x1", "y1"), lambda v: F.lit(v).cast("long")
    fixed = B.box(n(50), n(20), n(250), n(80))
    native = B.preview_to_native(b, n(3), B.box(n(11), n(10), n(700), n(700)), B.box(n(11), n(10), n(700), n(700)))
    parent, cells = B.to_parent(b, n(7), n(9)), B.cell_to_native(b, 8, n(2000), n(2000))
    return P.boxes(spark, sf_dir).select(
        "box_id", B.is_valid(b, n(300), n(100)).alias("valid"), B.contains(fixed, b).alias("inside"), B.area(B.intersect(b, fixed)).alias("common"), F.round(B.gap(b, fixed), 6).alias("gap"),
        native["x0"].alias("nx0"), native["x1"].alias("nx1"), parent["x0"].alias("px0"), parent["y1"].alias("py1"), cells["x0"].alias("cx0"), cells["x1"].alias("cx1"),
        F.round(B.angle_distance(F.col("x0"), F.col("y0")).cast("double"), 6).alias("angle"),
    )


def _union_sql(src: str, alias: str) -> str:
    return f"""{alias}_e AS (SELECT grp, x0 AS x FROM {src} UNION SELECT grp, x1 FROM {src}), {alias}_s AS (SELECT * FROM (SELECT grp, x, lead(x) OVER (PARTITION BY grp ORDER BY x) - x AS w FROM {alias}_e) WHERE w IS NOT NULL),
{alias}_t AS (SELECT DISTINCT s.grp, s.x, s.w, b.y0, b.y1 FROM {src} b JOIN {alias}_s s ON b.grp = s.grp AND b.x0 <= s.x AND b.x1 > s.x),
{alias}_f AS (SELECT *, max(y1) OVER (PARTITION BY grp, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {alias}_t),
{alias} AS (SELECT grp, CAST(sum(w * greatest(0, y1 - greatest(y0, coalesce(before, y0)))) AS BIGINT) AS area FROM {alias}_f GROUP BY grp)"""


@query(f"WITH {BX}, {_union_sql('bx', 'u')} SELECT grp, area FROM u")
def union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.union_area(P.boxes(spark, sf_dir).drop("box_id"), "grp")


_CLIP = "c AS (SELECT grp, box_id, greatest(x0, 20) AS x0, greatest(y0, 10) AS y0, least(x1, 280) AS x1, least(y1, 80) AS y1 FROM bx WHERE greatest(x0, 20) < least(x1, 280) AND greatest(y0, 10) < least(y1, 80))"


@query(f"""WITH {BX}, {_CLIP}, nat AS (SELECT * FROM c WHERE box_id % 3 = 0), ful AS (SELECT * FROM c WHERE box_id % 2 = 0), {_union_sql('nat', 'a')}, {_union_sql('ful', 'f')}
SELECT v.grp, v.views, coalesce(a.area, 0) AS native_area, coalesce(f.area, 0) AS full_area FROM (SELECT grp, count(*) AS views FROM bx GROUP BY grp) v LEFT JOIN a USING (grp) LEFT JOIN f USING (grp)""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = P.boxes(spark, sf_dir).withColumn("native", F.col("box_id") % 3 == 0).withColumn("step", F.when(F.col("box_id") % 2 == 0, 1).otherwise(2))
    n = lambda v: F.lit(v).cast("long")
    return X.coverage(views, B.box(n(20), n(10), n(280), n(80)), "grp")


_SHARE = f"""{BX}, {LB}, g AS (SELECT box_id, 0 AS k, x0, y0, x1, y1 FROM bx UNION ALL SELECT box_id, 1, greatest(0, x0 - 6), greatest(0, y0 - 6), least(400, x1 + 6), least(160, y1 + 6) FROM bx),
o AS (SELECT box_id, k, code, sum((least(x1, cx * 4 + 4) - greatest(x0, cx * 4)) * (least(y1, cy * 4 + 4) - greatest(y0, cy * 4))) AS area FROM (SELECT *, unnest(range(y0 // 4, (y1 - 1) // 4 + 1)) AS cy FROM (SELECT *, unnest(range(x0 // 4, (x1 - 1) // 4 + 1)) AS cx FROM g)) JOIN lb USING (cy, cx) GROUP BY ALL),
s AS (SELECT box_id, coalesce(sum(area) FILTER (k = 0 AND code = 1), 0) / sum(area) FILTER (k = 0) AS core, coalesce(sum(area) FILTER (k = 0 AND code = 4), 0) / sum(area) FILTER (k = 0) AS neighbour, coalesce(sum(area) FILTER (k = 0 AND code = 3), 0) / sum(area) FILTER (k = 0) AS background,
  coalesce(sum(area) FILTER (k = 1 AND code = 1), 0) / sum(area) FILTER (k = 1) AS core_context, coalesce(sum(area) FILTER (k = 1 AND code = 4), 0) / sum(area) FILTER (k = 1) AS neighbour_context FROM o GROUP BY box_id),
t AS (SELECT *, CASE WHEN core = 1 AND core_context = 1 THEN 'interior' WHEN core > 0 OR core_context > 0 THEN 'boundary' WHEN neighbour > 0 OR neighbour_context > 0 THEN 'neighbour' WHEN background = 1 THEN 'background' ELSE 'unresolved' END AS scope FROM s)"""


@query(f"WITH {_SHARE} SELECT box_id, code, CAST(area AS BIGINT) AS area FROM o WHERE k = 0")
def label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.label_overlap(P.boxes(spark, sf_dir).drop("grp"), labels(spark), STEP)


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.attribute(P.boxes(spark, sf_dir).drop("grp"), labels(spark), STEP, 6, 400, 160)


@query(f"WITH {_SHARE} SELECT box_id, round(core, 6) AS core, round(neighbour, 6) AS neighbour, round(background, 6) AS background, round(core_context, 6) AS core_context, round(neighbour_context, 6) AS neighbour_context, scope FROM t")
def attribution_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_attributed(spark, sf_dir), "core", "neighbour", "background", "core_context", "neighbour_context")


@query(f"WITH {_SHARE} SELECT n.scope, count(t.box_id) AS cnt FROM (SELECT unnest(['interior', 'boundary', 'neighbour', 'background', 'unresolved']) AS scope) n LEFT JOIN t USING (scope) GROUP BY 1")
def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scope_counts(_attributed(spark, sf_dir))


@query(f"""WITH {E}, l AS (SELECT cy, cx, CAST((cy * 5 + cx * 3) % 5 AS INTEGER) AS code FROM (SELECT unnest(range(0, max(y) // 8 + 1)) AS cy FROM e), range(8) b(cx)), r AS (SELECT unnest([{{'region': 'core', 'code': 1}}, {{'region': 'support', 'code': 1}}, {{'region': 'support', 'code': 2}}, {{'region': 'near', 'code': 3}}, {{'region': 'near', 'code': 4}}], recursive := true))
SELECT region, count(*) AS pixels, CAST(sum(v) AS BIGINT) AS total, count(*) FILTER (v = 0) AS zero_pixels, round(avg(v), 6) AS mean FROM e JOIN l ON y // 8 = cy AND x // 8 = cx JOIN r USING (code) GROUP BY region""")
def region_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.embedding_plane(spark, sf_dir)
    rows = e.agg(F.max("y").alias("last")).select(F.explode(F.expr("sequence(0L, last div 8)")).alias("cy"))  # every cell row of the plane
    cells = rows.withColumn("cx", F.explode(F.expr("sequence(0L, 7L)")))
    grid = cells.withColumn("code", ((F.col("cy") * 5 + F.col("cx") * 3) % 5).cast("int"))
    out = X.region_intensity(e, grid, 8, {"core": [1], "support": [1, 2], "near": [3, 4]})
    return rounded(out, "mean")


@query(f"""WITH {BX}, k AS (SELECT grp, box_id, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY grp ORDER BY (x1 - x0) * (y1 - y0) DESC, box_id) AS rank, count(*) OVER (PARTITION BY grp) AS total FROM bx)
SELECT grp, box_id, area, CAST(rank AS INTEGER) AS rank, total, greatest(0, total - 8) AS omitted FROM k WHERE rank <= 8""")
def topk_per_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = P.boxes(spark, sf_dir).select("grp", "box_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    best, counts = S.topk(sized, 8, [F.desc("area"), F.col("box_id")], "grp")
    return best.join(counts, "grp").select("grp", "box_id", "area", "rank", "total", "omitted")


_BANDS = "bd AS (SELECT l_suppkey AS grp, l_orderkey * 8 + l_linenumber AS id, CAST(l_orderkey % 12 AS DOUBLE) AS angle, l_partkey % 100 AS s0, l_partkey % 100 + 40 + l_linenumber * 4 AS s1, l_orderkey % 2000 AS normal, CAST(l_linenumber AS BIGINT) AS width FROM lineitem)"
_PAIRS = f"""WITH {_BANDS}, pr AS (SELECT a.grp, a.id AS a, b.id AS b, abs(a.normal - b.normal) AS spacing FROM bd a JOIN bd b ON a.grp = b.grp AND a.id < b.id
  WHERE abs(((a.angle - b.angle + 90) % 180 + 180) % 180 - 90) <= 3 AND greatest(0, least(a.s1, b.s1) - greatest(a.s0, b.s0)) / least(a.s1 - a.s0, b.s1 - b.s0) >= 0.5 AND abs(a.normal - b.normal) > a.width + b.width)"""


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col
    return P.table(spark, sf_dir, "lineitem").select(
        n("l_suppkey").alias("grp"), (n("l_orderkey") * 8 + n("l_linenumber")).alias("id"), (n("l_orderkey") % 12).cast("double").alias("angle"), (n("l_partkey") % 100).alias("s0"),
        (n("l_partkey") % 100 + 40 + n("l_linenumber") * 4).alias("s1"), (n("l_orderkey") % 2000).alias("normal"), n("l_linenumber").cast("long").alias("width"),
    )


@query(_PAIRS + " SELECT * FROM pr")
def parallel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.parallel_pairs(_bands(spark, sf_dir), "grp")


@query(_PAIRS + " SELECT * FROM pr WHERE a % 3 <> 0 AND b % 3 <> 0")
def straight_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.straight_pairs(_bands(spark, sf_dir), F.col("id") % 3 != 0, "grp")


_LINES = """l AS (SELECT grp, id, pos, s, e, row_number() OVER (PARTITION BY grp ORDER BY e - s DESC, pos, s, id) AS r FROM (SELECT l_suppkey AS grp, l_orderkey * 8 + l_linenumber AS id, l_partkey % 300 * 2 AS pos, l_suppkey % 90 + l_orderkey % 50 AS s, l_suppkey % 90 + l_orderkey % 50 + 1 + l_linenumber * 3 AS e FROM lineitem)),
g(grp, r, kept, id, hit) AS (SELECT DISTINCT grp, CAST(0 AS BIGINT), CAST([] AS STRUCT(pos BIGINT, k BIGINT, s BIGINT, e BIGINT, id BIGINT)[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM l UNION ALL
  SELECT grp, r, CASE WHEN hit IS NULL THEN list_append(kept, {'pos': CAST(pos AS BIGINT), 'k': CAST(r AS BIGINT), 's': CAST(s AS BIGINT), 'e': CAST(e AS BIGINT), 'id': CAST(id AS BIGINT)}) ELSE kept END, id, hit
  FROM (SELECT l.*, g.kept, list_sort(list_filter(g.kept, lambda q: abs(q.pos - l.pos) <= 3 AND l.s < q.e AND q.s < l.e))[1].id AS hit FROM g JOIN l ON l.grp = g.grp AND l.r = g.r + 1)),
nms AS (SELECT l.grp, l.id, l.pos, l.s AS start, l.e AS "end", g.hit IS NULL AS keep, g.hit AS duplicate_of FROM l JOIN g ON g.grp = l.grp AND g.r = l.r)"""


@query(f"WITH RECURSIVE {_LINES} SELECT * FROM nms")
def greedy_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent suppression: lines of positions two apart whose spans overlap meet."""
    k = F.col("l_orderkey")
    start = F.col("l_suppkey") % 90 + k % 50
    lines = P.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), (k * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 300 * 2).alias("pos"), start.alias("start"), (start + 1 + F.col("l_linenumber") * 3).alias("end"))
    return S.greedy_lines(lines, "grp")


@query(f"WITH RECURSIVE {_LINES} SELECT grp, coalesce(duplicate_of, id) AS id, count(*) AS lines FROM nms GROUP BY ALL")
def unique_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept lines of each group with the number that each stands for."""
    nms = greedy_nms(spark, sf_dir)
    return nms.groupBy("grp", F.coalesce("duplicate_of", "id").alias("id")).agg(F.count(F.lit(1)).alias("lines"))
