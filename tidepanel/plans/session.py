"""Session defaults and lineage control."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", shuffle: int = 8, app: str = "tidepanel") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle))
         .config("spark.driver.memory", os.environ.get("TIDEPANEL_DRIVER_MEMORY", "12g"))
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false"))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder all executors share; only a local
    session without one gets a temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidepanel-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    A lost executor then never costs the steps before it, the plan stays short
    across iterations, and several passes read a small table. (A Dataset
    checkpoint would compute its input twice, once to count and once to write.)
    """
    path = f"{shared_folder(df.sparkSession)}/tidepanel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`cut_lineage` wrote, once nothing reads it any more;
    iterative jobs keep one round on disk this way."""
    path = getattr(df, "_scratch_path", None)
    if path is not None:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, *keys: str, groups: int | None = None) -> DataFrame:
    """Hash-partition by ``keys`` over all shuffle partitions before Python works
    on the groups. It is the shuffle the grouping needs anyway, but AQE does not
    fold it into a few partitions because the rows are small: the work per group
    is, not the bytes. Where the number of ``groups`` is known and smaller, no
    empty tasks are started."""
    return df.repartition(min(_partitions(df), groups or _partitions(df)), *keys)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
