"""Persons, labelled values, files and addresses of whole tables: each document is read within a task.

Candidates have the columns of ``detectors.detect``, with places in the text.  No shuffle.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..document.cues import find_files, find_persons
from ..document.labels import LabelReader
from ..document.rules import scan_addresses
from ..document.view import View
from ..tables import bounded_batches

COLUMNS = ("doc_id", "view", "entity_type", "start", "end", "value", "detector", "rule", "strength", "score")
SHAPE = "doc_id long, view string, entity_type string, start int, end int, value string, detector string, rule string, strength int, score double"
ROWS = 128


def _found(docs: DataFrame, detector: str, find: Callable[[View], Iterable]) -> DataFrame:
    """(start, end, entity_type, rule) in the line view, as candidates in the text."""

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64())
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, out = batch.slice(at, ROWS), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    view = View.of_text(text or "")
                    for f in find(view):
                        a, b = view.tokens[bisect.bisect_right(view.starts, f.start) - 1], view.tokens[bisect.bisect_left(view.starts, f.end) - 1]
                        low, high = a.raw_start + f.start - a.start, b.raw_start + f.end - b.start
                        out.append((doc_id, "line", f.entity_type, low, high, text[low:high], detector, f.rule, 2, 1.0))
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(COLUMNS))

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SHAPE)


def detect_persons(docs: DataFrame) -> DataFrame:
    """Names after titles, salutations and closings."""
    return _found(docs, "rules.persons", find_persons)


def detect_labels(docs: DataFrame) -> DataFrame:
    """Values beside, to the right of and below labels."""
    return _found(docs, "rules.labels", lambda view: LabelReader(view).find())


def detect_files(docs: DataFrame) -> DataFrame:
    """Paths and names of files."""
    return _found(docs, "rules.files", find_files)


def detect_addresses(docs: DataFrame) -> DataFrame:
    """Streets; localities with a state and a postcode, from after the last street-type word on; capitals are left."""
    return _found(docs, "rules.address", scan_addresses)
