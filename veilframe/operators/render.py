"""Text rendering: the text with replacements in place, and checks that nothing removed is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits_only, match_key


def rebuild(docs: DataFrame, replaced: DataFrame, by: str = "label") -> DataFrame:
    """(doc_id, text) with the spans of ``replaced`` (doc_id, start, end, ``by``; not overlapping) replaced.

    One shuffle; a document's replacements are as many as it has mentions.
    """
    spans = replaced.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col(by).alias("by")))).alias("spans"))
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    built = F.aggregate("spans", start, lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr("text", a["at"] + 1, s["start"] - a["at"]), s["by"]).alias("out")))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(F.col("built.out"), F.substr("text", F.col("built.at") + 1)))
    return joined.withColumn("built", built).select("doc_id", text.alias("text"))


def leaks(removed: DataFrame, output: DataFrame) -> DataFrame:
    """Removed values (doc_id, value) whose key of 4 or more characters, or digits of 6 or more, are left in ``output``."""
    needles = removed.select("doc_id", "value", match_key(F.col("value")).alias("key"), digits_only(F.col("value")).alias("digits")).distinct()
    needles = needles.where((F.length("key") >= 4) | (F.length("digits") >= 6))
    hay = output.select("doc_id", match_key(F.col("text")).alias("all"), digits_only(F.col("text")).alias("runs"))
    joined = needles.join(hay, "doc_id")
    left = ((F.length("key") >= 4) & F.contains("all", "key")) | ((F.length("digits") >= 6) & (F.length("digits") == F.length("key")) & F.contains("runs", "digits"))
    return joined.where(left).select("doc_id", "value")
