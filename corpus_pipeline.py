"""From documents to packed training sequences, in four stages; each takes (spark, docs, sf_dir).

1. toxicity: documents that the model rejects go.  It is fitted on the labelled rows of the stage's own input.
2. near duplicates: of each group of documents linked at 80 % of their five-word shingles one stays, that of the
   smallest doc_id; of rows with one doc_id and one text one stays.
3. repeated strings: bytes covered by a string of ``REPEAT`` bytes that also starts elsewhere in the stage's input go,
   by whole characters.  All documents stay; one whose text goes entirely stays with an empty text.
4. packing: documents are cut into pieces and packed into sequences of at most 2048 tokens.

Nulls: a null text is empty; it is never toxic by its words, never a duplicate, and one piece when packed.  A null
doc_id is kept as an id of its own.  Columns besides doc_id and text pass through unchanged until packing, but for
n_chars, which follows the text; other tables' columns are never joined to them, so names don't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import minhash, packing, suffixes, toxicity
from veilframe.llm.common import shared_folder, written

#: A document is rejected from this calibrated score on: toxic is likelier than not.
REJECT = 0.5
#: The shortest run of 51 words of the given documents has 152 bytes.
REPEAT = 150


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(toxicity.score(text, toxicity.fit(docs, labels), spark) < REJECT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.linked(docs, width=5, percent=80)
    kept = written(found.where("row = first_row").select(F.col("row").alias("kept_row")).distinct(), "kept-rows")
    first = docs.dropDuplicates(["doc_id", "text"])  # whole repeated rows; different texts that share an id are told apart
    rows = first.join(kept, minhash.row_key() == kept["kept_row"], "left_semi")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = suffixes.without_repeats(docs, REPEAT, rest)
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cut.select(*columns.values())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeats),
    ("packing", pack),
]

#: A fitted model, sketches, string matching and tokenisation aren't expressible in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/veilframe-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
