"""Top-k with omission counts, and greedy suppression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk(rows: DataFrame, k: int, order: list[Column], *keys: str) -> tuple[DataFrame, DataFrame]:
    """(the first k rows of each key with their rank, keys with total and omitted counts)."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")).withColumn("omitted", F.greatest(F.lit(0), F.col("total") - k))
    return ranked.where(F.col("rank") <= k), counts


def merge_topk(kinds: list[DataFrame], k: int, score: str, *keys: str) -> DataFrame:
    """Rows of several kinds together, the k of greatest score for each key; ties keep the kinds' order, then id."""
    every = kinds[0].withColumn("kind_order", F.lit(0))
    for i, x in enumerate(kinds[1:], 1):
        every = every.unionByName(x.withColumn("kind_order", F.lit(i)), allowMissingColumns=True)
    return topk(every, k, [F.desc(score), F.col("kind_order"), F.col("id")], *keys)[0]


def uniform_subsample(rows: DataFrame, index: str, total: Column, budget: int) -> DataFrame:
    """Rows whose index is i * total // budget for some i."""
    i = F.ceil(F.col(index) * budget / total)
    return rows.where((total <= budget) | ((i < budget) & (F.floor(i * total / budget) == F.col(index))))


def greedy_lines(lines: DataFrame, *keys: str, near: int = 3) -> DataFrame:
    """lines with keep and duplicate_of: longest first (ties: pos, start, id), a line is dropped if a kept one of its key
    lies within `near` positions and spans overlap. Order-dependent, so one group is one task; the lines of a position
    only concern their neighbourhood, so what must stay together is a cluster of positions at most `near` apart, not a
    whole key; clusters are dealt out by hash."""
    w = Window.partitionBy(*keys).orderBy("pos")
    new = F.coalesce((F.col("pos") - F.lag("pos").over(w) > near).cast("int"), F.lit(0))
    clustered = lines.withColumn("new", new).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("new")

    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = clustered.withColumn("part", F.pmod(F.xxhash64(*keys, "cluster"), F.lit(parts))).drop("cluster")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(length=group["end"] - group["start"]).sort_values(["length", "pos", "start", "id"], ascending=[False, True, True, True])
        kept: dict[tuple, list[tuple]] = {}
        keep, of = [], []
        owners = zip(*[group[k] for k in keys], strict=True) if keys else [()] * len(group)
        for owner, p, start, end, i in zip(owners, group["pos"], group["start"], group["end"], group["id"], strict=True):
            hit = next((q for x in range(p - near, p + near + 1) for q in kept.get((owner, x), ()) if start < q[1] and q[0] < end), None)
            keep.append(hit is None)
            of.append(None if hit is None else hit[2])
            if hit is None:
                kept.setdefault((owner, p), []).append((start, end, i))
        return group.drop(columns=["part", "length"]).assign(keep=keep, duplicate_of=pd.array(of, "Int64"))

    names = [f"{f.name} {f.dataType.simpleString()}" for f in lines.schema]
    return dealt.groupBy("part").applyInPandas(choose, ", ".join([*names, "keep boolean", "duplicate_of long"]))
