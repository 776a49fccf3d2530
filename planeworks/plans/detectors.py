"""Queries that run the pattern searches on synthetic planes; tests hold them against the planes' known geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeworks.operators import detectors as D
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


def _between(c: str, a: int, b: int):
    return (F.col(c) >= a) & (F.col(c) < b)


@query()
def axial_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = P.synthetic(spark, 800, 800, F.when(F.col("x") >= 400, 1000).otherwise(100), "step")
    return D.axial_screen(D.tiles_of(plane, 256))


@query()
def dark_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = P.synthetic(spark, 512, 512, F.when(_between("y", 200, 280) & _between("x", 180, 260), 0).otherwise(1000), "hole")
    return D.local_scan(D.tiles_of(plane, 256))


@query()
def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = P.synthetic(spark, 1000, 1000, F.when(_between("y", 290, 306) | _between("y", 690, 706), 0).otherwise(4000), "bands")
    return D.band_pairs(D.tiles_of(plane, 512))


@query()
def hysteresis_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    bright = F.pow(F.col("x") - 128, F.lit(2)) + F.pow(F.col("y") - 128, F.lit(2)) < 3600
    return D.hysteresis_mask(D.tiles_of(P.synthetic(spark, 256, 256, F.when(bright, 2000).otherwise(50), "disk"), 128), 64)


@query()
def core_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bright = F.pow(F.col("x") - 256, F.lit(2)) + F.pow(F.col("y") - 256, F.lit(2)) < 16900
    return D.core_proposals(D.tiles_of(P.synthetic(spark, 512, 512, F.when(bright, 1500).otherwise(50), "disk"), 256))


@query("""WITH RECURSIVE m AS (SELECT y, x, y * 32 + x AS id FROM range(32) a(y), range(32) b(x) WHERE (y * 7 + x * 3) % 11 < 4 AND y % 9 < 7),
c(id, y, x, root) AS (SELECT id, y, x, id FROM m UNION SELECT n.id, n.y, n.x, c.root FROM c JOIN m n ON abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1),
r AS (SELECT id, min(root) AS root FROM c GROUP BY id) SELECT 'grid' AS plane_id, CAST(row_number() OVER (ORDER BY root) AS INTEGER) AS label, CAST(count(*) AS INTEGER) AS cells FROM r GROUP BY root""")
def conn_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = ((F.col("y") * 7 + F.col("x") * 3) % 11 < 4) & (F.col("y") % 9 < 7)
    return D.connected(D.tiles_of(P.synthetic(spark, 32, 32, F.when(on, 9).otherwise(0), "grid"), 16), 0)
