"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder in the shared place that the cluster names, or in the warehouse where it names none."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", "") or (own.get() if own.isDefined() else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: what follows does not compute it anew, and a lost executor costs a read."""
    df.write.parquet(path := folder(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)
