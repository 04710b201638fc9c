"""Session helpers: sensible defaults, cutting lineage, and shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the submitter's settings hold."""
    base = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(master).appName("lanternfish").config(map=base | conf).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did."""
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def spread(df: DataFrame, least: int = 1 << 20, each: int = 4 << 20) -> DataFrame:
    """``df`` over all cores, if its input is too small to be split for them but not too small to bother.

    A file of one row group is read by one task.  Spark's estimate of the input
    decides: from ``each`` bytes a core on, files are split well enough, and no
    row is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if least <= size < cores * each else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, as the session names it; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="lanternfish-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lanternfish-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back.

    A checkpoint would compute it twice unless it is cached.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []
