"""Queries on planes and signals: aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeworks.functions.display import render, render_gamma
from planeworks.operators import aggregates as A
from planeworks.operators import windows as W
from planeworks.sources import planes as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The plane of the embeddings, and the hourly signal of the events, for DuckDB.
E = "e AS (SELECT vec_id AS y, i - 1 AS x, CAST(round((CAST(embedding[i] AS DOUBLE) + 1) * 20000) AS BIGINT) AS v FROM embeddings, range(1, 65) t(i))"
V = "sig AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS pos, count(*) AS n, avg(value) AS value FROM events GROUP BY 1)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles rounded (with no negative zero), so that the order of sums doesn't show."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


@query(f"WITH {E} SELECT v, count(*) AS cnt FROM e GROUP BY v")
def hist_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(P.embedding_plane(spark, sf_dir))


_STATS = """count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 4) AS std, round(quantile_cont(v, 0.01), 6) AS p1,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.995), 6) AS p995, count(*) FILTER (v = 0) AS zero_count, count(*) FILTER (v = 65535) AS ceiling_count,
  round(count(*) FILTER (v = 0) / count(*), 6) AS zero_fraction, round(count(*) FILTER (v = 65535) / count(*), 6) AS ceiling_fraction"""


def _stats(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "mean", "p1", "median", "p995", "zero_fraction", "ceiling_fraction"), "std", digits=4)


@query(f"WITH {E}, pq AS (SELECT 'embeddings' AS plane, CAST(v AS DOUBLE) AS v FROM e UNION ALL SELECT 'price', round(l_extendedprice) FROM lineitem) SELECT plane, {_STATS} FROM pq GROUP BY plane")
def raw_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.embedding_plane(spark, sf_dir).select(F.lit("embeddings").alias("plane"), F.col("v").cast("double").alias("v"))
    price = P.table(spark, sf_dir, "lineitem").select(F.lit("price").alias("plane"), F.round("l_extendedprice").alias("v"))
    return _stats(A.raw_statistics(A.histogram(e.unionByName(price), "plane"), "plane"))


@query(f"WITH {E} SELECT y // 64 AS py, x // 64 AS px, {_STATS} FROM e GROUP BY 1, 2")
def patch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(A.patch_statistics(P.embedding_plane(spark, sf_dir), 64))


@query(f"WITH {E} SELECT y // 24 AS cy, x // 24 AS cx, CAST(sum(v) AS BIGINT) AS sum, count(*) AS n, round(avg(v), 6) AS mean FROM e GROUP BY 1, 2")
def block_mean_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.block_mean(P.embedding_plane(spark, sf_dir), 24), "mean")


@query(f"WITH {E}, h AS (SELECT max(y) + 1 AS h FROM e) SELECT y // 24 AS cy, x // 24 AS cx, CAST(sum(v) AS BIGINT) AS sum, count(*) AS n, round(avg(v), 6) AS mean FROM e, h WHERE y < h // 24 * 24 AND x < 48 GROUP BY 1, 2")
def block_mean_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.embedding_plane(spark, sf_dir)
    height = e.agg((F.max("y") + 1).alias("h"))  # one row
    return rounded(A.block_mean(e.join(F.broadcast(height)), 24, floor_shape=(F.col("h"), F.lit(64))), "mean")


@query(f"WITH {E} SELECT round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.995), 6) AS p995 FROM e WHERE y % 3 = 0 AND x % 3 = 0")
def point_sample_pctl(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = P.embedding_plane(spark, sf_dir).where("y % 3 = 0 AND x % 3 = 0")
    return rounded(A.raw_statistics(A.histogram(sampled)).select("p1", "median", "p995"), "p1", "median", "p995")


@query(f"""WITH {E}, q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.995) AS hi FROM e),
g AS (SELECT CAST(floor(least(1.0, greatest(0.0, (v - lo) / (hi - lo))) * 255 + 0.5) AS BIGINT) AS g FROM e, q), h AS (SELECT g, count(*) AS c FROM g GROUP BY g),
r AS (SELECT g, sum(c) OVER (ORDER BY g) AS w, sum(CAST(g AS DOUBLE) * c) OVER (ORDER BY g) AS m, sum(c) OVER () AS n, sum(CAST(g AS DOUBLE) * c) OVER () AS t FROM h)
SELECT g AS threshold, round(pow(t / n * (w / n) - m / n, 2) / ((w / n) * (1 - w / n)), 4) AS between FROM r WHERE w < n ORDER BY 2 DESC, 1 LIMIT 1""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = A.histogram(P.embedding_plane(spark, sf_dir))
    ends = A.raw_statistics(hist).select("p1", "p995")
    gray = hist.join(F.broadcast(ends)).groupBy(render(F.col("v"), F.col("p1"), F.col("p995")).alias("g")).agg(F.sum("cnt").alias("cnt"))
    return rounded(A.otsu(gray), "between", digits=4)


@query(f"""WITH {E}, s AS (SELECT max(y) + 1 AS h FROM e),
c AS (SELECT y * 8 // h AS iy, x * 8 // 64 AS ix, v, y, x, h FROM e, s), d AS (SELECT iy + CASE WHEN (iy + 1) * h // 8 <= y THEN 1 ELSE 0 END AS "by", ix AS bx, v FROM c)
SELECT "by", bx, count(*) AS n, round(avg(CASE WHEN v < 22000 THEN 1 ELSE 0 END), 6) AS background_share, count(*) >= 32 AND avg(CASE WHEN v < 22000 THEN 1 ELSE 0 END) >= 0.8 AS eligible,
  CASE WHEN count(*) >= 32 AND avg(CASE WHEN v < 22000 THEN 1 ELSE 0 END) >= 0.8 THEN round(quantile_cont(v, 0.5) FILTER (v < 22000), 6) END AS median FROM d GROUP BY 1, 2""")
def background_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.embedding_plane(spark, sf_dir)
    both = e.join(F.broadcast(e.agg((F.max("y") + 1).alias("h"))))
    return rounded(A.background_cells(both, F.col("v") < 22000, F.col("h"), F.lit(64)), "background_share", "median")


@query(f"""WITH {E}, l AS (SELECT y // 64 AS py, x // 64 AS px, v,
  lag(v) OVER r + lead(v) OVER r + lag(v) OVER c + lead(v) OVER c - 4 * v AS lap FROM e WINDOW r AS (PARTITION BY y // 64, x // 64, y ORDER BY x), c AS (PARTITION BY y // 64, x // 64, x ORDER BY y))
SELECT py, px, count(lap) AS n, round(avg(CAST(lap AS DOUBLE) * lap) / nullif(var_pop(v) FILTER (lap IS NOT NULL), 0), 6) AS detail FROM l GROUP BY 1, 2""")
def laplacian_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.laplacian_detail(P.embedding_plane(spark, sf_dir), 64), "detail")


@query(f"WITH {E}, p AS (SELECT y % 4 AS k, quantile_cont(v, 0.999) AS p FROM e GROUP BY 1) SELECT CAST(0 AS BIGINT) AS low, CAST(greatest(1, ceil(max(p))) AS BIGINT) AS high FROM p")
def display_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.embedding_plane(spark, sf_dir).withColumn("k", F.col("y") % 4)
    return A.display_window(A.histogram(e, "k"), "k")


@query(f"""WITH {E}, g AS (SELECT CAST(floor(least(1.0, greatest(0.0, (v - 15000) / 10000.0)) * 255 + 0.5) AS BIGINT) AS gray, CAST(floor(pow(least(1.0, greatest(0.0, (v - 15000) / 10000.0)), 0.5) * 255) AS BIGINT) AS gamma FROM e)
SELECT gray, gamma, count(*) AS cnt FROM g GROUP BY 1, 2""")
def display_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = A.histogram(P.embedding_plane(spark, sf_dir))
    low, high = F.lit(15000), F.lit(25000)
    return hist.groupBy(render(F.col("v"), low, high).alias("gray"), render_gamma(F.col("v"), low, high).alias("gamma")).agg(F.sum("cnt").alias("cnt"))


@query(f"WITH {E} SELECT round(100.0 * count(*) FILTER (v < 15000) / count(*), 6) AS below_pct, round(100.0 * count(*) FILTER (v > 25000) / count(*), 6) AS above_pct FROM e")
def clipping_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = A.histogram(P.embedding_plane(spark, sf_dir))
    return rounded(hist.agg(*A.clipping(hist, F.lit(15000), F.lit(25000))), "below_pct", "above_pct")


@query(f"""WITH {E} SELECT x AS pos, round(quantile_cont(v, 0.5) FILTER (v >= 20000), 6) AS value, round(avg(CASE WHEN v >= 20000 THEN 1 ELSE 0 END), 6) AS share, avg(CASE WHEN v >= 20000 THEN 1 ELSE 0 END) >= 0.15 AS valid FROM e GROUP BY x""")
def axis_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.axis_profile(P.embedding_plane(spark, sf_dir), "x", F.col("v") >= 20000), "value", "share")


@query(f"""WITH {E}, p AS (SELECT x, quantile_cont(v, 0.5) AS m FROM e GROUP BY x) SELECT round(quantile_cont(m, 0.9) - quantile_cont(m, 0.1), 6) AS span, count(*) AS n FROM p""")
def broad_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = A.axis_profile(P.embedding_plane(spark, sf_dir), "x", F.lit(True))
    return rounded(profile.agg((F.percentile("value", F.lit(0.9)) - F.percentile("value", F.lit(0.1))).alias("span"), F.count(F.lit(1)).alias("n")), "span")


@query(f"""WITH {V}, w AS (SELECT pos, n, value, CASE WHEN count(value) OVER l >= 4.8 THEN avg(value) OVER l END AS "left", CASE WHEN count(value) OVER r >= 4.8 THEN avg(value) OVER r END AS "right" FROM sig
  WINDOW l AS (ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), r AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
SELECT pos, n, round(value, 6) AS value, round("left", 6) AS "left", round("right", 6) AS "right", round("right" - "left", 6) AS contrast FROM w""")
def two_side_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.two_sided(P.hourly(spark, sf_dir), 6), "value", "left", "right", "contrast")


def _folded(spark: SparkSession, sf_dir: str, *hours: int) -> DataFrame:
    signal = P.hourly(spark, sf_dir).withColumn("period", F.explode(F.array(*[F.lit(h) for h in hours])))
    return signal.select("period", F.floor(F.col("pos") / F.col("period")).alias("cycle"), (F.col("pos") % F.col("period")).alias("phase"), F.round("value", 6).alias("v"))


def _fold_sql(hours: str) -> str:
    return f"""WITH {V}, f AS (SELECT period, pos // period AS cycle, pos % period AS phase, round(value, 6) AS v FROM sig, (SELECT unnest([{hours}]) AS period)),
p AS (SELECT period, cycle, phase, sum(v) AS s, count(*) AS n FROM f GROUP BY ALL),
q AS (SELECT *, sum(s) OVER a - s AS sp, sum(n) OVER a - n AS np, sum(s) OVER t AS st, sum(n) OVER t AS nt, sum(s) OVER c AS sc, sum(n) OVER c AS nc FROM p
  WINDOW a AS (PARTITION BY period, phase), t AS (PARTITION BY period), c AS (PARTITION BY period, cycle)),
k AS (SELECT period, cycle, phase, (st - sc) / nullif(nt - nc, 0) AS m, CASE WHEN np > 0 THEN sp / np ELSE (st - sc) / nullif(nt - nc, 0) END AS pr FROM q),
r AS (SELECT f.period, sum(pow(v - pr, 2)) AS sse, sum(pow(v - m, 2)) AS sst FROM f JOIN k USING (period, cycle, phase) WHERE m IS NOT NULL GROUP BY 1),
a AS (SELECT period, max(mean) - min(mean) AS amplitude, count(*) AS phases FROM (SELECT period, phase, sum(s) / sum(n) AS mean FROM p GROUP BY 1, 2) GROUP BY 1)"""


@query(_fold_sql("24") + " SELECT period, round(amplitude, 6) AS amplitude, phases FROM a")
def phase_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.fold(_folded(spark, sf_dir, 24), "period").select("period", "amplitude", "phases"), "amplitude")


@query(_fold_sql("24") + " SELECT period, CASE WHEN sst > 1e-10 THEN round(1 - sse / sst, 6) END AS r2 FROM r")
def loco_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.fold(_folded(spark, sf_dir, 24), "period").select("period", "r2"), "r2")


@query(_fold_sql("24, 18, 21, 28, 32") + """, j AS (SELECT period, amplitude, CASE WHEN sst > 1e-10 THEN 1 - sse / sst END AS r2 FROM a LEFT JOIN r USING (period))
SELECT round(max(r2) FILTER (period = 24), 6) AS r2, round(max(r2) FILTER (period <> 24), 6) AS best_control_r2, round(max(amplitude) FILTER (period = 24), 6) AS amplitude, round(quantile_cont(amplitude, 0.5) FILTER (period <> 24), 6) AS control_amplitude FROM j""")
def control_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = A.fold(_folded(spark, sf_dir, 24, 18, 21, 28, 32), "period")
    own, other = F.col("period") == 24, F.col("period") != 24
    pick = lambda rule, c: F.when(rule, F.col(c))
    out = folded.agg(F.max(pick(own, "r2")).alias("r2"), F.max(pick(other, "r2")).alias("best_control_r2"), F.max(pick(own, "amplitude")).alias("amplitude"), F.percentile(pick(other, "amplitude"), F.lit(0.5)).alias("control_amplitude"))
    return rounded(out, *out.columns)


_HOURS = "m AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS pos FROM events)"


def _user_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("pos")).distinct()


@query(f"""WITH {_HOURS}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM m)
SELECT user_id, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS length FROM i GROUP BY user_id, g""")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.runs(_user_hours(spark, sf_dir), "user_id")


@query(f"""WITH {_HOURS}, b AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) > 13 THEN 1 ELSE 0 END AS nw FROM m), r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM b)
SELECT user_id, CAST(run AS BIGINT) AS run, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM r GROUP BY user_id, run HAVING max(pos) - min(pos) + 1 >= 2 AND count(*) >= 0.2 * (max(pos) - min(pos) + 1)""")
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.gap_runs(_user_hours(spark, sf_dir), 13, "user_id", least=2, cover=0.2)


@query(f"""WITH {V}, k AS (SELECT pos, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS mark FROM sig), d AS (SELECT pos, mark, max(mark) OVER (ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS wide FROM k)
SELECT pos, mark, min(wide) OVER (ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS closed FROM d""")
def closing_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.closing(P.hourly(spark, sf_dir).select("pos", F.when(F.col("value") >= 50, 1).otherwise(0).alias("mark")), 2)


@query(f"""WITH {V} SELECT pos, count(value) OVER w AS k_n, CASE WHEN count(value) OVER w >= 0.8 * 24 THEN round(avg(value) OVER w + 1e-9, 6) END AS k_mean FROM sig WINDOW w AS (ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)""")
def sliding_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.sliding_support(P.hourly(spark, sf_dir), 24).select("pos", "k_n", (F.col("k_mean") + 1e-9).alias("k_mean"))  # off the ties of rounding
    return rounded(out, "k_mean")


@query(f"""WITH {E}, ir AS (SELECT y, x, sum(v) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS i, count(*) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS n, sum(v) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS o FROM e),
b AS (SELECT y, x, sum(i) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS i, sum(n) OVER w AS n, sum(o) OVER w AS o FROM ir WINDOW w AS (PARTITION BY x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
SELECT y AS cy, x AS cx, round(i / 9, 6) AS "inner", round((o - i) / 72, 6) AS ring, round(ln(1 + (o - i) / 72) - ln(1 + i / 9), 6) AS contrast FROM b WHERE n = 81""")
def ring_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.embedding_plane(spark, sf_dir).select(F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("v").cast("double").alias("mean"))
    return rounded(W.ring_contrast(cells, 3, 9), "inner", "ring", "contrast")


@query("""WITH s AS (SELECT y, x AS pos, CAST((CASE WHEN x >= 64 THEN 1000 ELSE 100 END) + y % 3 AS DOUBLE) AS value FROM range(64) a(y), range(128) b(x)),
w AS (SELECT y, pos, CASE WHEN count(*) OVER l >= 3.2 THEN avg(ln(1 + value)) OVER l END AS l, CASE WHEN count(*) OVER r >= 3.2 THEN avg(ln(1 + value)) OVER r END AS r FROM s
  WINDOW l AS (PARTITION BY y ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY y ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT pos, round(quantile_cont(r - l, 0.5), 6) AS contrast, round(avg(CASE WHEN abs(r - l) >= 0.7 THEN 1 ELSE 0 END), 6) AS support FROM w WHERE r - l IS NOT NULL GROUP BY pos""")
def step_contrast_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.step_plane(spark).select("y", F.col("x").alias("pos"), F.log1p("v").alias("value"))
    sides = W.two_sided(rows, 4, "y").where("contrast is not null")
    out = sides.groupBy("pos").agg(F.percentile("contrast", F.lit(0.5)).alias("contrast"), F.avg((F.abs("contrast") >= 0.7).cast("int")).alias("support"))
    return rounded(out, "contrast", "support")


@query(f"WITH {E} SELECT y, x AS pos, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v DESC, x) AS k FROM e) WHERE k = 1")
def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.argmax_first(P.embedding_plane(spark, sf_dir), "y", "x", "v")


@query(f"WITH {E}, a AS (SELECT x FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v DESC, x) AS k FROM e) WHERE k = 1) SELECT x AS pos, count(*) AS cnt FROM a GROUP BY x ORDER BY 2 DESC, 1 LIMIT 1")
def modal_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.mode_first(W.argmax_first(P.embedding_plane(spark, sf_dir), "y", "x", "v"), "pos")


@query("""WITH f AS (SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem GROUP BY 1),
r AS (SELECT l_returnflag, n, slope, intercept, l_extendedprice - slope * l_quantity - intercept AS res FROM lineitem JOIN f USING (l_returnflag)), m AS (SELECT l_returnflag, median(res) AS middle FROM r GROUP BY 1)
SELECT l_returnflag, n, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(quantile_cont(abs(res), 0.9), 4) AS p90_abs, round(quantile_cont(abs(res - middle), 0.5), 4) AS mad FROM r JOIN m USING (l_returnflag) GROUP BY ALL""")
def line_fit_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.line_fit(P.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", "l_returnflag")
    return rounded(out, "slope", "intercept", "p90_abs", "mad", digits=4)


@query(f"WITH {V}, q AS (SELECT ntile(4) OVER (ORDER BY pos) AS quarter, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS mark FROM sig) SELECT CAST(quarter AS INTEGER) AS quarter, count(*) AS n, round(avg(mark), 6) AS support FROM q GROUP BY 1")
def quarter_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.quarter_support(P.hourly(spark, sf_dir), F.col("value") >= 50), "support")
