"""Tables kept below the folder that driver and executors share, and broadcasts of counted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_dir(spark, name: str) -> str:
    """A fresh folder name below the shared folder named in spark.checkpoint.dir, or set by setCheckpointDir(). Without
    one, a local session takes a folder of this machine; on a cluster that is an error, as machines don't share it."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = made.get() if made.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="planeworks-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(table: DataFrame, name: str) -> DataFrame:
    """The table, written below the shared folder: computed once, the same rows each time they are read."""
    folder = shared_dir(table.sparkSession, name)
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


def ensure_checkpoint_dir(spark) -> None:
    """checkpoint() works from here on."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))


def bounded(table: DataFrame, most: int) -> DataFrame:
    """The table, to be broadcast only if it has been counted to be of `most` rows or fewer."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
