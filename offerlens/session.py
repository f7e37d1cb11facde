"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

# Settings every job of this library expects.  Sizes follow the cluster: shuffle
# partitions start high and AQE coalesces them, and AQE splits skewed joins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "offerlens", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=None)
def _private_folder(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and hand-over tables.

    The cluster names it in ``spark.checkpoint.dir``.  A private folder is made only where that is
    unset and driver and executors are one process; on several machines each would write its own part.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or _private_folder(spark.sparkContext.applicationId)).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Write ``df`` to the scratch folder once and read it back, which cuts its lineage.

    Columns that hold nothing but an untyped null cannot be written; they are put back after.
    """
    path = scratch_path(df.sparkSession, name)
    untyped = [f.name for f in df.schema if isinstance(f.dataType, NullType)]
    typed = df.drop(*untyped)
    typed.write.parquet(path)
    read = df.sparkSession.read.schema(typed.schema).parquet(path)
    return read.select(*[F.lit(None).alias(c) if c in untyped else F.col(f"`{c}`") for c in df.columns]) if untyped else read


def widen(df):
    """Spread a small written table over all cores before an expensive join.

    Large tables already come back in many partitions and are left alone, so no shuffle is added
    where it would cost anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
