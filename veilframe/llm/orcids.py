"""Operator 4, token ids in ORC files.

Documents are dealt by ranges of their ids and sorted, so each file holds one range in ascending order.  A row has
the document's id, its number of tokens, the ids before it in its file and its ids; integers are run-length encoded,
stripes can be read in parallel, and row indexes and Bloom filters on doc_id let a reader skip what it needn't read.
Where a file begins among all ids follows from the sums of its n_tokens column, one number a file.

Defined results: null and empty texts have the end id alone; a null doc_id sorts first; rows of equal id are kept,
in the order of their texts' hashes; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shipped, compiled, documents, map_batches, now_doing, pieces_of, shared_folder, texts_of, without_collection
from .tokenstream import LibraryVocabulary

SCHEMA = "doc_id long, part int, n_tokens long, start_in_file long, ids array<int>"
OPTIONS = {
    "orc.compress": "SNAPPY", "orc.stripe.size": str(16 << 20), "orc.create.index": "true", "orc.row.index.stride": "2000",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}
#: Files whose sums the driver adds up: 8 bytes each.
MOST_FILES = 2_000_000


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode ``docs`` and write them to ``path``, ascending by doc_id.  One shuffle, of the texts."""
    file = Shipped(docs.sparkSession, tokenizer_path)
    rows = documents(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches):
        now_doing(__name__)
        vocabulary = compiled(("library", file.key), lambda: LibraryVocabulary(file.bytes()))
        before = 0
        for batch in pieces_of(batches, 3 << 20):
            with without_collection():
                ids, ends = vocabulary.encode(texts_of(batch.column(2)))
            ends = ends + np.arange(1, len(ends) + 1)
            with_end = np.full(len(ids) + len(ends), end_id, np.int32)
            with_end[np.delete(np.arange(len(with_end)), ends - 1)] = ids
            sizes = np.diff(ends, prepend=0)
            lists = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(with_end))
            yield pa.record_batch([batch.column(1), batch.column(0), pa.array(sizes), pa.array(before + ends - sizes), lists], ["doc_id", "part", "n_tokens", "start_in_file", "ids"])
            before += int(ends[-1])

    rows.mapInArrow(run, SCHEMA).write.options(**OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with ``doc_ids`` only those, where stripes and row groups without them are skipped."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def file_starts(spark: SparkSession, path: str) -> np.ndarray:
    """By part, the ids in all parts before it; reads the part and n_tokens columns only."""
    sums = read_token_files(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).limit(MOST_FILES + 1).collect()
    if len(sums) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files")
    by_part = np.zeros(1 + max((r["part"] for r in sums), default=-1), np.int64)
    for r in sums:
        by_part[r["part"]] = r["n"]
    return np.cumsum(by_part) - by_part


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per row of the files: doc_id, start among all ids, n_tokens, ids_crc32.  No shuffle."""
    starts = spark.sparkContext.broadcast(file_starts(spark, path))  # 8 bytes a file, MOST_FILES at most

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(4)
        ids, offsets = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        start = starts.value[np.asarray(batch.column(1))] + np.asarray(batch.column(3))
        return pa.record_batch([batch.column(0), pa.array(start), batch.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(read_token_files(spark, path), each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """``write_token_files`` to a fresh place in the shared folder, then ``digests`` of the files."""
    path = f"{shared_folder(docs.sparkSession)}/veilframe-tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path, end_id)
    return digests(docs.sparkSession, path)
