"""Tables between the steps of a job: written to the folder that all nodes share, never to a local one on a cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only on one machine, where the session names no shared folder.
LOCAL = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
        named = LOCAL
    return named.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table: made once, however often it is read, and there when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/veilframe-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that the JVM puts into one Arrow batch; documents may be long.
ROWS_A_BATCH = 256


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ROWS_A_BATCH`` rows in this session; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_A_BATCH:
        spark.conf.set(name, str(ROWS_A_BATCH))
