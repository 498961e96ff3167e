"""Session-level helpers: recommended settings, checkpoint folder.

The library never creates a session for the caller; these helpers only read
from (or, for tests and the bench, add defaults to) the session it is given.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster job should run with.  AQE re-plans joins from runtime
# sizes, coalesces small shuffle partitions and splits skewed ones.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def apply_recommended_conf(spark: SparkSession) -> None:
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession, default: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set to shared storage.  Where it is unset,
    ``default`` is installed; without one, a session whose executor is the
    driver itself (master ``local[...]``) gets a new temporary folder, and any
    other session is refused.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if default is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set on this session")
        default = tempfile.mkdtemp(prefix="riskflow-checkpoints-")
    os.makedirs(default, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", default)
    spark.sparkContext.setCheckpointDir(default)
    return default


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: for a
    table that several branches of a job use.  Unlike a cached table it needs no
    release and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
