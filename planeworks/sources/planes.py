"""Planes as tables: pixels (plane_id, y, x, v), one row a sample; arrays are YX and values unsigned 16-bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, v: row vec_id, 64 columns, components in [-1, 1] mapped to 0..40000."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return cells.select("y", F.col("x").cast("long").alias("x"), F.round((F.col("e").cast("double") + 1) * 20000).cast("long").alias("v"))


def synthetic(spark: SparkSession, height: int, width: int, value: Column, plane_id: str = "plane") -> DataFrame:
    """A plane whose value is an expression of y and x."""
    cells = spark.range(height * width).select(F.expr(f"id div {width}").alias("y"), (F.col("id") % width).alias("x"))
    return cells.select(F.lit(plane_id).alias("plane_id"), "y", "x", value.cast("long").alias("v"))


def step_plane(spark: SparkSession, height: int = 64, width: int = 128, edge: int = 64, low: int = 100, high: int = 1000) -> DataFrame:
    return synthetic(spark, height, width, F.when(F.col("x") >= edge, high).otherwise(low) + F.col("y") % 3, "step")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a signal: pos (hours since the epoch), n, value (mean)."""
    pos = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("pos")
    return table(spark, sf_dir, "events").groupBy(pos).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """box_id, grp, x0, y0, x1, y1 (half open) from lineitem keys; grp is the supplier."""
    n = F.col
    return table(spark, sf_dir, "lineitem").select(
        (n("l_orderkey") * 8 + n("l_linenumber")).alias("box_id"), n("l_suppkey").alias("grp"), (n("l_partkey") % 300).alias("x0"), (n("l_suppkey") % 90).alias("y0"),
        (n("l_partkey") % 300 + 1 + n("l_orderkey") % 40).alias("x1"), (n("l_suppkey") % 90 + 1 + n("l_linenumber") * 3).alias("y1"),
    )
