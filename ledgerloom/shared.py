"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of this machine only where Spark runs on this machine alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never handed out twice."""
    return f"{shared_base(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path with Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_ledgerloom_path", None)
    if path:
        delete_path(df.sparkSession, path)


def ship_package(spark: SparkSession) -> None:
    """Put this package on the executors' path, once per application."""
    context = spark.sparkContext
    if getattr(context, "_ledgerloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(here)}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(target)
    context._ledgerloom_shipped = True
