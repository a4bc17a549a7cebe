"""Tables written to the shared folder and read again: lineage is cut, and lost executors cost nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder of this application under spark.checkpoint.dir.

    The setting has to name a folder that the driver and all executors see; without it nothing is
    written, as a machine-local folder would lose rows on a cluster.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder shared by the driver and all executors")
        top = spark.conf.get("spark.sql.warehouse.dir") + "/_twinspark"
    return f"{top.rstrip('/')}/twinspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._twinspark_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables; only for those that no later job reads."""
    for t in tables:
        _delete(t.sparkSession, t._twinspark_path)


def cleared(spark: SparkSession) -> None:
    """Deletes every table that this application has written. To be called when its results have been stored."""
    _delete(spark, shared_dir(spark).rsplit("/", 1)[0])
