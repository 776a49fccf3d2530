"""Queries give the whole job: against brute force, and against the registered SQL, which has no cuts."""

import duckdb
import numpy as np
import pytest

from planeworks import plans
from planeworks.operators import aggregates as A
from planeworks.operators import spatial as X
from test_queries import ordered


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("lineitem", "part", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def same_as_whole_sql(spark, duck, small, name, *cuts):
    """The query against the registered SQL, which has none of `cuts`."""
    sql = plans.ORACLES[name]
    for cut in cuts:
        assert cut not in sql
    want = duck.sql(sql)
    got = plans.QUERIES[name](spark, small).select(*want.columns).collect()
    assert ordered(got) == ordered(want.fetchall())


def test_pairs_have_no_upper_spacing(spark):
    schema = "g long, id long, angle double, s0 long, s1 long, normal long, width long"
    far = spark.createDataFrame([(1, 1, 0.0, 0, 900, 100, 16), (1, 2, 0.0, 0, 900, 600, 16), (1, 3, 0.0, 0, 900, 120, 16)], schema)
    assert {(r.a, r.b, r.spacing) for r in X.parallel_pairs(far, "g").collect()} == {(1, 2, 500), (2, 3, 480)}
    rng = np.random.default_rng(11)
    rows = [(int(rng.integers(0, 2)), i, float(rng.choice([0, 1.5, 2.9, 3, 6, 90, 177, 177.5, 179.9, -1, -3])), s := int(rng.integers(0, 60)), s + int(rng.integers(20, 90)), int(rng.integers(0, 4000)), int(rng.integers(1, 9))) for i in range(160)]
    want = {
        (a[1], b[1], abs(a[5] - b[5])) for a in rows for b in rows
        if a[0] == b[0] and a[1] < b[1] and abs((a[2] - b[2] + 90) % 180 - 90) <= 3 and min(a[4], b[4]) - max(a[3], b[3]) >= 0.5 * min(a[4] - a[3], b[4] - b[3]) and abs(a[5] - b[5]) > a[6] + b[6]
    }
    for angle in (3.0, 80.0):
        got = [(r.a, r.b, r.spacing) for r in X.parallel_pairs(spark.createDataFrame(rows, schema), "g", angle).collect()]
        assert len(got) == len(set(got)) and (set(got) == want if angle == 3 else set(got) > want)


def exchanges(spark, df):
    """Exchanges that are not reused, and broadcasts, in the plan without adaptive execution, where reuse shows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return plan.count(" Exchange ") - plan.count("ReusedExchange "), plan.count("Broadcast")


@pytest.mark.parametrize("name", ["parallel_pairs", "straight_pairs"])
def test_bands_cross_one_exchange_and_pairs_none(spark, small, name):
    assert exchanges(spark, plans.QUERIES[name](spark, small)) == (1, 0)


@pytest.mark.parametrize("angle", [1.0, 2.0, 3.0, 7.5, 14.0, 16.0, 29.0])
def test_pairs_meet_once_across_sectors(spark, angle):
    """Bands of the whole turn and around the sectors' ends, for widths of one to thirty sectors."""
    n = max(1, int(180 / (X.SECTOR * angle)))
    edges = [round(k * 180 / n + d, 6) for k in range(-1, n + 1) for d in (-angle, -angle / 2, 0.0, angle / 2, angle, angle + 0.25)]
    rows = [(1, i, float(t), 0, 50, i * 10, 1) for i, t in enumerate(edges[:60] + edges[-60:])]
    got = [(r.a, r.b) for r in X.parallel_pairs(spark.createDataFrame(rows, "g long, id long, angle double, s0 long, s1 long, normal long, width long"), "g", angle).collect()]
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and abs((a[2] - b[2] + 90) % 180 - 90) <= angle}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("name", ["parallel_pairs", "straight_pairs"])
def test_pair_queries_are_whole(spark, duck, small, name):
    same_as_whole_sql(spark, duck, small, name, " AND abs(a.normal - b.normal) <= 100")


@pytest.mark.parametrize("name", ["tile_plan", "tile_plan_budget"])
def test_every_part_is_planned(spark, duck, small, name):
    parts = duck.sql("SELECT count(*) FROM part").fetchall()[0][0]
    assert plans.QUERIES[name](spark, small).select("p_partkey").distinct().count() == parts
    same_as_whole_sql(spark, duck, small, name, " WHERE p_size <= 5")


def test_every_box_is_ranked(spark, duck, small):
    same_as_whole_sql(spark, duck, small, "merged_topk", " WHERE box_id % 3 <> 0", " AND grp % 7 <> 0")


def test_tall_planes_are_whole(spark, tmp_path):
    height = 16013
    spark.range(height).selectExpr("id AS vec_id", "array_repeat(CAST(0.5 AS FLOAT), 64) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    y, x = np.mgrid[:height, :64]
    code = (y // 8 * 5 + x // 8 * 3) % 5
    want = {name: int(np.isin(code, codes).sum()) for name, codes in {"core": [1], "support": [1, 2], "near": [3, 4]}.items()}
    assert {r.region: (r.pixels, r.total) for r in plans.QUERIES["region_intensity"](spark, str(tmp_path)).collect()} == {k: (n, n * 30000) for k, n in want.items()}
    inside = (x >= 8) & (y >= 8) & (x <= 56) & (y <= height - 8) & (((x - 32) / 32) ** 2 + ((y - height / 2) / (height / 2)) ** 2 <= 0.7**2)
    assert plans.QUERIES["frame_points"](spark, str(tmp_path)).where("central").count() == inside.sum()


@pytest.mark.parametrize("missed", [False, True])
def test_residuals_are_ranked_without_holding_a_key(spark, monkeypatch, missed):
    """Percentiles of residuals against numpy, also where the sketch's bracket misses; no aggregate holds a key's values."""
    rng = np.random.default_rng(5)
    x, noise = rng.integers(0, 50, 900).astype(float), np.concatenate([rng.normal(size=500), np.repeat([0.25, 1e6], 200)])
    rows = [("ab"[i % 2], float(u), float(3 * u + e)) for i, (u, e) in enumerate(zip(x, noise))]
    odd = [("one", 1.0, 2.0), ("same", 4.0, 1.0), ("same", 4.0, 9.0), ("nan", 1.0, float("nan")), ("nan", 2.0, 1.0), (None, 1.0, 1.0), ("a", None, 7.0), ("b", 3.0, None)]
    points = spark.createDataFrame(rows + odd, "k string, x double, y double")
    if missed:
        monkeypatch.setattr(A.F, "percentile_approx", lambda c, *_: A.F.array(A.F.min(c), A.F.min(c)))
    out = A.line_fit(points, "x", "y", "k")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
    got = {r.k: r for r in out.collect()}
    assert set(got) == {"a", "b", "one", "same", "nan"} and out.columns == ["k", "n", "slope", "intercept", "p90_abs", "mad"]
    for k in "ab":
        u, v = (np.array([r[j] for r in rows if r[0] == k]) for j in (1, 2))
        slope, intercept = np.polyfit(u, v, 1)
        res = v - slope * u - intercept
        assert got[k].n == len(u) + 1 and np.allclose(got[k][2:], [slope, intercept, np.quantile(abs(res), 0.9), np.median(abs(res - np.median(res)))], rtol=1e-7)
    assert all(got[k].slope is None and got[k].p90_abs is None and got[k].mad is None for k in ("one", "same"))
    assert np.isnan([got["nan"].p90_abs, got["nan"].mad]).all()
