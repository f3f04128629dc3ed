"""Cutting lineage between rounds of an iterative job, safely for lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="pagewright-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession) -> str:
    """A new path below the shared folder; nothing is there yet."""
    return f"{checkpoint_dir(spark)}/pagewright/{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a written folder when the driver ends; results may read it until then."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def materialize(frame: DataFrame) -> DataFrame:
    """Write the frame to the shared folder once and read it back: short lineage, exact statistics.

    The files outlive lost executors, and Spark sizes later joins by what was really written.
    """
    spark = frame.sparkSession
    path = shared_path(spark)
    frame.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def delete_now(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of frames that ``materialize`` gave and nothing reads any more."""
    for frame in frames:
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize_by(frame: DataFrame, *key: str) -> tuple[DataFrame, str]:
    """Like ``materialize``, without duplicate rows and bucketed by ``key``; also gives the table name.

    Joins on the key in every later round need no shuffle of this side. The rows are brought together
    by the same hash first, which makes one file per bucket and serves the duplicate check as well.
    """
    spark = frame.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"pagewright_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/pagewright/{name}"
    writer = frame.repartition(buckets, *key).distinct().write.bucketBy(buckets, *key).sortBy(*key)
    writer.format("parquet").option("path", path).saveAsTable(name)
    delete_at_exit(spark, path)
    return spark.table(name), name


def forget(spark: SparkSession, *names: str) -> None:
    """Remove bucketed tables from the session's catalog; their files stay until the driver ends."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
