"""Intermediate tables in the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _set(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share. Only a local master may have one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master or "").startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="martlens-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under spark.checkpoint.dir that nothing else uses."""
    return f"{_set(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The same rows written out under spark.checkpoint.dir: what reads them several times plans and computes them once, and
    a lost executor costs no recomputation."""
    _set(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, name: str) -> DataFrame:
    """The same rows as Parquet under spark.checkpoint.dir, for a wide table of which readers take a few columns each. Joins
    with it are by shuffle unless the other side is marked for a broadcast: its files say too little of its size."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(folder).hint("merge")


#: Rows that are taken to a large table by a broadcast.
FEW = 1 << 14


def few(written: DataFrame, most: int | None = None) -> DataFrame:
    """A written table, marked for a broadcast if it has no more than ``most`` rows (FEW), else for a join by shuffle."""
    most = FEW if most is None else most
    return F.broadcast(written) if written.limit(most + 1).count() <= most else written.hint("merge")
