"""Files and their promises: checksums, a registry of models, configurations, refused files, model outputs."""

from __future__ import annotations

import copy
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.boxes import limits
from ..operators.manifest import canonical
from ..operators.readers import word_windows
from ..tables import bounded_batches

#: Settings that don't change results; they aren't part of a configuration's hash.
OPERATIONAL = ("workers", "timeout_s", "log_level", "paths")


def checksums(lines: DataFrame) -> DataFrame:
    """(path, sha256) of lines "digest  path" (value)."""
    rows = lines.select(F.regexp_extract("value", r"^([0-9a-f]{64})[ *]+(.+)$", 1).alias("sha256"), F.regexp_extract("value", r"^([0-9a-f]{64})[ *]+(.+)$", 2).alias("path"))
    return rows.where("sha256 <> ''").select("path", "sha256")


def broken(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) of files (path, sha256) that are missing, differ, or that nobody promised; has to be empty."""
    e, f = expected.select("path", F.col("sha256").alias("wanted")), found.select("path", "sha256")
    rows = e.join(f, "path", "full").withColumn("problem", F.when(F.col("sha256").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("sha256") != F.col("wanted"), "differs"))
    return rows.where("problem is not null").select("path", "problem")


def resolved(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Models (model, file, sha256) of a registry whose files (path, sha256) are all there and as promised."""
    bad = registry.join(files.select(F.col("path").alias("file"), F.col("sha256").alias("found")), "file", "left").where("found is null or found <> sha256").select("model").distinct()
    return registry.select("model").distinct().join(bad, "model", "left_anti")


def refused(files: DataFrame) -> DataFrame:
    """(path, reason) of files (path, length, n_pages, encrypted) that aren't read."""
    return files.select("path", limits(F.col("length"), F.col("n_pages"), F.col("encrypted")).alias("reason")).where("reason is not null")


def merged(*layers: dict) -> dict:
    """Configurations laid over each other: later values win, maps are merged, lists are not."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def override(config: dict, settings: Iterable[str]) -> dict:
    """``config`` with "a.b=value" set; values are JSON, else strings."""
    for setting in settings:
        path, _, text = setting.partition("=")
        try:
            value = json.loads(text)
        except json.JSONDecodeError:
            value = text
        for key in reversed(path.split(".")):
            value = {key: value}
        config = merged(config, value)
    return config


def config_hash(config: dict) -> str:
    """SHA-256 of what of a configuration changes results."""
    return hashlib.sha256(canonical({k: v for k, v in config.items() if k not in OPERATIONAL}).encode()).hexdigest()


def parse_reader_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, word_no, text, confidence, x0, y0, x1, y1) of a reader's tab-separated rows (doc_id, text).

    Columns are level, page, block, paragraph, line, word, left, top, width, height, confidence, text; only words
    (level 5) with a confidence and a size count.  Lines are numbered as they first appear in a page.
    """
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", "at", F.split("line", "\t").alias("f")).where(F.size("f") >= 12)
    n = lambda i: F.try_to_number(F.col("f")[i], F.lit("9999999")).cast("int")
    words = lines.select("doc_id", "at", n(0).alias("level"), n(1).alias("page"), F.struct(n(2), n(3), n(4)).alias("key"), n(6).alias("x0"), n(7).alias("y0"), n(8).alias("w"), n(9).alias("h"), F.expr("try_cast(f[10] AS DOUBLE)").alias("confidence"), F.col("f")[11].alias("text"))
    words = words.where("level = 5 and confidence >= 0 and w > 0 and h > 0 and trim(text) <> ''")
    first = words.groupBy("doc_id", "page", "key").agg(F.min("at").alias("first"))
    numbered = first.withColumn("line_no", F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy("first")) - 1)
    word_no = F.row_number().over(Window.partitionBy("doc_id", "page", "line_no").orderBy("at")) - 1
    joined = words.join(numbered.drop("first"), ["doc_id", "page", "key"])
    return joined.select("doc_id", "page", "line_no", word_no.alias("word_no"), "text", (F.col("confidence") / 100).alias("confidence"), "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))


#: A model: the texts of a batch of windows to lists of (start, end, entity type, score) in each.
Model = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]


def model_candidates(docs: DataFrame, load: Callable[[], Model], name: str, size: int = 300, overlap: int = 50, strong: float = 0.8) -> DataFrame:
    """``docs`` (doc_id, text: a line view) with an array column candidates of what a model finds in windows of words.

    ``load`` is called once a task.  A window's hit counts once, however many windows see it; scores from ``strong`` on
    are strong evidence.  What isn't plausible is dropped where documents are read (``document.allowlist``).
    """
    shape = "array<struct<start: int, end: int, entity_type: string, detector: string, rule: string, strength: int, score: double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        word = re.compile(r"\S+", re.ASCII)
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"] or ""
                spans = [m.span() for m in word.finditer(text)]
                windows = [(spans[w["first"]][0], spans[w["last"] - 1][1]) for w in row["windows"] or () if spans]
                found: dict[tuple[int, int, str], float] = {}
                for (low, high), hits in zip(windows, model([text[a:b] for a, b in windows]) if windows else [], strict=True):
                    for start, end, entity, score in hits:
                        key = (low + start, min(high, low + end), entity)
                        found[key] = max(score, found.get(key, 0.0))
                hits = [{"start": a, "end": b, "entity_type": e, "detector": f"ner.{name}", "rule": f"ner.{name}", "strength": 2 if s >= strong else 1, "score": s} for (a, b, e), s in sorted(found.items())]
                yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"], "text": row["text"], "candidates": hits}], schema=arrow)

    made = f"doc_id long, text string, candidates {shape}"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], made).schema)
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text", word_windows(n, size, overlap).alias("windows")).mapInArrow(run, made)
