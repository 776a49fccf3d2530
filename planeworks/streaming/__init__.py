"""Structured Streaming: files measured as they arrive, view requests settled as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from planeworks.sources.tiff import read_tiles, tile_histogram


def arriving_files(spark: SparkSession, folder: str, glob: str = "*.tif") -> DataFrame:
    """A stream of (path, length, modified, file_sha256, content) of new files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_sha256"), "content")


def arriving_tiles(spark: SparkSession, folder: str, size: int = 1024) -> DataFrame:
    return read_tiles(arriving_files(spark, folder), size)


def arriving_histograms(spark: SparkSession, folder: str) -> DataFrame:
    """Running exact histograms (plane_id, v, cnt); to be written in complete or update mode."""
    return tile_histogram(arriving_tiles(spark, folder).where("status = 'ok'"))


def gap_sessions(events: DataFrame, gap: str, watermark: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """key, start, end, n: runs of events at most `gap` apart, final once the watermark has passed."""
    marked = events.withWatermark(ts, watermark).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return marked.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def settle_stream(requests: DataFrame, budget: int) -> DataFrame:
    """The ledger's rules on a stream of (session, request_id, args, seq): state a session is its committed requests, at
    most `budget` of them. Once they are that many, whatever else is asked for is over budget, so that refused ids need
    not be kept."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, args = (list(x) for x in state.get) if state.exists else ([], [])
        known = dict(zip(ids, args, strict=True))
        for frame in frames:
            out = []
            for r in frame.sort_values("seq").itertuples(index=False):
                if r.request_id in known:
                    out.append("replayed" if known[r.request_id] == r.args else "conflict")
                elif len(known) < budget:
                    known[r.request_id] = r.args
                    out.append("committed")
                else:
                    out.append("over_budget")
            yield frame.sort_values("seq").assign(status=out)[["session", "request_id", "args", "seq", "status"]]
        state.update((list(known), list(known.values())))

    schema = "session long, request_id long, args string, seq long, status string"
    return requests.groupBy("session").applyInPandasWithState(step, schema, "ids array<long>, args array<string>", "append", GroupStateTimeout.NoTimeout)
