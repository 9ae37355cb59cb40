"""Line sources: reader output, pools with comments, seeds, and format sniffing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_tsv(rows: DataFrame) -> DataFrame:
    """(doc_id, word, confidence) of tab-separated reader lines (level, confidence, word): level 5, confidence not negative."""
    lines = rows.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.split("line", "\t").alias("f"))
    fields = lines.where(F.size("f") >= 3).select("doc_id", F.col("f")[0].cast("int").alias("level"), F.col("f")[1].cast("double").alias("confidence"), F.col("f")[2].alias("word"))
    return fields.where("level = 5 AND confidence >= 0 AND word <> ''").drop("level")


def pool(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a word list; blank lines and # comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    return lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(type, value) from a JSON array; the schema is fixed."""
    return spark.read.schema("type string, value string").option("multiLine", True).json(path)


def sniff(content: Column) -> Column:
    """pdf, tiff, png or jpeg by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    pdf = F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0
    return F.when(pdf, "pdf").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff").when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpeg")


def files(spark: SparkSession, path: str, most_bytes: int = 512 << 20) -> DataFrame:
    """(path, content, sha256, format) of files up to ``most_bytes``; larger and empty ones are left to quarantine."""
    rows = spark.read.format("binaryFile").load(path).where((F.col("length") > 0) & (F.col("length") <= most_bytes))
    return rows.select("path", "content", F.sha2("content", 256).alias("sha256"), sniff(F.col("content")).alias("format"))
