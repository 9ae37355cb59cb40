"""A session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, checkpoints: str | None = None) -> SparkSession:
    """AQE with skew joins, UTC, no UI.  On a cluster set ``spark.checkpoint.dir`` to a folder all nodes share.

    ``partitions``: some 2 to 4 a core on small inputs; at scale as many as keep a partition near 128 MB.
    """
    builder = SparkSession.builder.appName("veilframe").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master).config("spark.driver.memory", "16g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
