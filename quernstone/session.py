"""Table access and session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (one file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark runs locally.

    On a cluster a folder of one machine would lose the checkpoints, so there the setting is required.  Checkpoints are
    removed once their frames are no longer referenced where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set
    for the session; this package never deletes them itself."""
    shared = spark.conf.get(CHECKPOINT_CONF, None)
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all nodes share")
        shared = f"file://{tempfile.mkdtemp(prefix='quernstone-')}"
    context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut through ``checkpoint()`` in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def spread(df: DataFrame, *keys: str, per_core: int = 1) -> DataFrame:
    """``df`` over at least ``per_core`` partitions a core, so that one small file doesn't mean one task.

    A frame that already has as many partitions stays as it is: no shuffle at scale."""
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """``df`` projected to ``schema``: missing columns become their default or a typed null, others are cast."""
    have, defaults = set(df.columns), defaults or {}
    cols = []
    for f in schema.fields:
        if f.name in have:
            c = F.col(f"`{f.name}`").cast(f.dataType)
        else:
            c = F.lit(defaults.get(f.name)).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def file_uri(path: str) -> str:
    """``path`` as a URI that Spark accepts whatever its default file system is."""
    return path if "://" in path else f"file://{os.path.abspath(path)}"
