"""Tables written once in the shared checkpoint folder and read back.

A staged table cuts lineage and survives the loss of executors. Because it is a
file source, Spark knows its true size: joins against it are broadcast only
below ``spark.sql.autoBroadcastJoinThreshold`` and are shuffled otherwise.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir``, or a temp folder in local mode."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _local_roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as parquet in the staging folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again; they must be as ``stage`` returned them."""
    for table in tables:
        delete(table.sparkSession, table._staged_at)


def drop_staged(spark: SparkSession) -> None:
    """Delete every table this application staged."""
    delete(spark, staging_root(spark))
