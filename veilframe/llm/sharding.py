"""Operator 7, sharding by weighted rendezvous hashing; DataFrame functions only.

Each shard scores a key by ``-weight / ln(u)`` with ``u`` a uniform hash of key and shard, and the highest score
wins.  Scores don't depend on the other shards: when one is added, the keys it wins move to it and no others move.
Slots number the rows of a shard from 0; they are counted in salted cells, so no shard gathers in one task.

Defined results: a null text has no bytes and the CRC of the empty string; a null key is a key like any other;
repeated rows share a shard and get a slot each; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Hashes are taken modulo 2 ** 52, so that they and a half are exact as doubles, and none is the whole unit.
UNIT = float(1 << 52)


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    u = (F.pmod(F.xxhash64(key, F.lit(shard)), F.lit(1 << 52)).cast("double") + 0.5) / UNIT
    return F.lit(-weight) / F.ln(u)


def winner(key: Column, weights: list[float]) -> Column:
    """The winning shard with its score: struct(score, shard), of equal scores the higher shard."""
    return F.array_max(F.array(*[F.struct(score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]))


def shard_documents(docs: DataFrame, weights: list[float], added: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, and grown_shard: the shard once one of weight ``added`` joins."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("best", winner(F.col("doc_id"), weights)).withColumn("shard", F.col("best.shard"))
    rows = rows.withColumn("grown_shard", F.when(score(F.col("doc_id"), len(weights), added) > F.col("best.score"), F.lit(len(weights))).otherwise(F.col("shard"))).drop("best")
    # a table, whose rows keep their places: equal rows go to different cells by them
    rows = written(rows, "sharded")
    salts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    cells = rows.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    cells = cells.select("shard", "salt", (F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("before"))
    in_cell = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32", "size")) - 1
    rows = rows.withColumn("in_cell", in_cell).join(cells, ["shard", "salt"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("in_cell")).alias("slot"), "grown_shard")
