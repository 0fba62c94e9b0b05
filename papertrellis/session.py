"""Session helpers: results kept for later passes, and size-checked broadcasting."""

from __future__ import annotations

import re
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows and bytes up to which a side counts as small; beyond them the planner's own join choice stands.
SMALL_SIDE_ROWS = 200_000
SMALL_SIDE_BYTES = 64 << 20
# Types that Parquet has no column for.
NOT_IN_PARQUET = re.compile(r"\b(void|interval|variant|char\(|varchar\(|time\(|struct<>)")


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that spark.checkpoint.dir names for driver and executors; none is ever invented."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. A local session, which is one machine, may name none; its folder is then under /tmp."""
    folder = shared_folder(spark)
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute once for later passes: in the shared folder, or on the executors' disks where none is named.

    Kept on disk, a lost block is computed anew from its inputs; the shared copy also ends the plan. It is Parquet, which takes a small
    part of a checkpoint's plain rows, and later passes read only their columns of it. Rows that Parquet can't hold are checkpointed.
    """
    if not shared_folder(df.sparkSession):
        return df.persist(StorageLevel.DISK_ONLY)
    names = [c.lower() for c in df.columns]
    if not names or len(set(names)) < len(names) or NOT_IN_PARQUET.search(df.schema.simpleString()):
        return df.checkpoint()
    path = new_folder(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = SMALL_SIDE_ROWS, size: int = SMALL_SIDE_BYTES) -> bool:
    """Whether a side has at most so many rows and so many bytes, counted over no more than ``rows`` + 1 of them."""
    width = F.octet_length(F.to_json(F.struct("*")))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and total <= size


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only after counting that the side is small; the same rows come out either way."""
    return F.broadcast(df) if is_small(df) else df
