"""Session settings and the lineage cut used by iterative jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the plans in this package count on. `spark.sql.shuffle.partitions` is left
# to the cluster: AQE coalesces from there.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Where it is unset and Spark runs in this one process, a folder that goes when the process ends."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="gleaner-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by `spark.checkpoint.dir`."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables, under the cluster's shared `spark.checkpoint.dir`."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key in one partition, for tasks that read partitions as streams.

    Dealt by a hash of the key, not by the key: behind a join on the key Spark would leave `repartition(key)` out, and may then
    read that join's shuffle by map task (a broadcast chosen late) or in parts (a skewed key), which splits the key's rows.
    """
    return df.repartition(F.xxhash64(key))
