"""Decoder queries over step tables made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import decoders
from ..sources.tables import table


def q_ctc(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), step.alias("step"), (F.col("event_id") % 7 % 3).cast("int").alias("cls"), (F.col("event_id") % 101).alias("prob"))
    return decoders.ctc_collapse(steps).groupBy("seq").agg(F.count("*").alias("n"), F.sum("prob").alias("prob"), F.sum(F.col("last") - F.col("first") + 1).alias("steps"))


def q_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ["O", "B-a", "I-a", "E-a", "S-a"]
    scores = F.array(*[F.sin(F.col("l_partkey") * (i + 1)).cast("double") for i in range(len(labels))])
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("position"), scores.alias("scores"))
    return decoders.decode_entities(rows, labels)


QUERIES = {"q_ctc": q_ctc, "q_viterbi": q_viterbi}
ORACLE_SQL = {
    "q_ctc": """
        WITH s AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, event_id % 7 % 3 AS cls, event_id % 101 AS prob FROM events),
             b AS (SELECT *, CASE WHEN lag(cls) OVER (PARTITION BY seq ORDER BY step) = cls THEN 0 ELSE 1 END AS b FROM s),
             r AS (SELECT *, sum(b) OVER (PARTITION BY seq ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM b),
             g AS (SELECT seq, run, cls, max(prob) AS prob, count(*) AS steps FROM r GROUP BY 1, 2, 3)
        SELECT seq, count(*) AS n, CAST(sum(prob) AS BIGINT) AS prob, CAST(sum(steps) AS BIGINT) AS steps FROM g WHERE cls <> 0 GROUP BY 1
    """,
}
