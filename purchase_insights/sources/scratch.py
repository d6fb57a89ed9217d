"""Shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_issued: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which every executor can reach.

    That is ``spark.checkpoint.dir`` or the folder set on the Spark context. A
    local session without either uses a temporary folder; a cluster without is
    refused, since files in a machine-local folder are lost with the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="purchase-insights-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _issued.append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    """Hadoop's view of a path, whatever store it is in."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = _file_system(spark, path)
    return files.exists(hadoop)


def remove_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Delete one path that ``scratch_path`` gave out, or all of them.

    Results that are read lazily from such a table, as reports from their book, have
    to be written or collected before.
    """
    for one in [path] if path else list(_issued):
        if one not in _issued:
            raise ValueError(f"{one} is not a scratch path of this session")
        files, hadoop = _file_system(spark, one)
        files.delete(hadoop, True)
        _issued.remove(one)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the optimizer the true
    size, so Spark's own threshold decides whether to broadcast the table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
