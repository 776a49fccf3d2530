"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step deals links out by node with a partial minimum first. The least neighbours are cut loose by checkpoint(), in
the cluster's shared folder, before links meet them, so that both sides of that join are plain exchanges and a node with
very many links can be split at run time; lineage is cut after every step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeworks.llm.text import ensure_checkpoint_dir


def _star(links: DataFrame) -> DataFrame:
    """Every link (a, b) with a > b; per node the least of it and its neighbours is the hub of its larger neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).checkpoint()
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m")).checkpoint()
    joined = links.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """links: a long, b long (any order, repeats and loops allowed). Gives node, component (the least node reachable) for
    every node of a link that isn't a loop. An empty table gives an empty table. The steps grow with the logarithm of the
    number of nodes; should they not settle within `most_steps`, that is an error, never a partial answer."""
    ensure_checkpoint_dir(links.sparkSession)
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct().checkpoint()
    before = None
    for _ in range(most_steps):
        now = _small(_star(now).checkpoint()).checkpoint()
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 20))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
