"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a local session may fall back to one of its own, a cluster may not."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "folder" not in LOCAL:
        LOCAL["folder"] = tempfile.mkdtemp(prefix="crestline-staging-")
    return LOCAL["folder"]


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name; what is there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


def staged(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write a table once and read it back: cuts lineage, survives lost executors, keeps Parquet statistics."""
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
