"""Decoders of model outputs: CTC collapse as windows, and the best well-formed BIOES path of a document.

Both take model outputs as rows, so a model is a provider of a table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ctc_collapse(steps: DataFrame, blank: int = 0) -> DataFrame:
    """(seq, position, cls, prob, first, last): runs of equal classes without blanks, with their best step's probability.

    ``steps``: (seq, step, cls, prob) with the best class of each step.  One shuffle, by sequence.
    """
    order = Window.partitionBy("seq").orderBy("step")
    begins = F.when(F.lag("cls").over(order) == F.col("cls"), 0).otherwise(1)
    runs = steps.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("seq", "run", "cls").agg(F.max("prob").alias("prob"), F.min("step").alias("first"), F.max("step").alias("last")).where(F.col("cls") != blank)
    return runs.select("seq", (F.row_number().over(Window.partitionBy("seq").orderBy("run")) - 1).alias("position"), "cls", "prob", "first", "last")


def allowed(labels: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which labels may begin a path, follow one another, and end it: spans are S, or B, I, ..., E of one category."""
    kind, category = [x[0] for x in labels], [x[2:] for x in labels]
    opens, closes = np.isin(kind, ["O", "B", "S"]), np.isin(kind, ["O", "E", "S"])
    n = len(labels)
    follow = np.zeros((n, n), bool)
    for i, j in itertools.product(range(n), range(n)):
        follow[i, j] = opens[j] if closes[i] else kind[j] in "IE" and category[i] == category[j]
    return opens, follow, closes


def best_path(scores: np.ndarray, labels: list[str], bias: np.ndarray | None = None) -> list[int]:
    """The well-formed path with the largest sum of scores (and ``bias`` of each move); of equal ones the lowest ids."""
    opens, follow, closes = allowed(labels)
    move = np.where(follow, 0.0 if bias is None else bias, -np.inf)
    total, came = np.where(opens, scores[0], -np.inf), []
    for row in scores[1:]:
        through = total[:, None] + move
        came.append(through.argmax(axis=0))
        total = through.max(axis=0) + row
    path = [int(np.where(closes, total, -np.inf).argmax())]
    for back in reversed(came):
        path.append(int(back[path[-1]]))
    return path[::-1]


def spans_of(path: list[int], labels: list[str]) -> list[tuple[int, int, str]]:
    """(first, last, category) of a well-formed path."""
    out, first = [], 0
    for t, label in enumerate(labels[i] for i in path):
        if label[0] in "BS":
            first = t
        if label[0] in "ES":
            out.append((first, t, label[2:]))
    return out


def decode_entities(logits: DataFrame, labels: list[str]) -> DataFrame:
    """(doc_id, first, last, category) from (doc_id, position, scores array<double>), one row a token.

    A document is one path; documents are independent.
    """

    def decode(frames):
        for frame in frames:
            out = [(doc, *x) for doc, steps in zip(frame["doc_id"], frame["steps"], strict=True) for x in spans_of(best_path(np.array([s["scores"] for s in steps]), labels), labels)]
            yield pd.DataFrame(out, columns=["doc_id", "first", "last", "category"])

    rows = logits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "scores"))).alias("steps"))
    return rows.mapInPandas(decode, "doc_id long, first int, last int, category string")


#: Moves between labels that a decoder may favour: staying outside, opening, going on, closing, span after span, single.
BIASES = ("outside_to_outside", "outside_to_span", "begin_to_inside", "inside_to_inside", "inside_to_end", "span_to_span")


def bias_matrix(labels: list[str], biases: dict[str, float]) -> np.ndarray:
    """What is added to each move by its kind; kinds that aren't named add nothing."""
    unknown = set(biases) - set(BIASES)
    if unknown:
        raise ValueError(f"no such bias: {sorted(unknown)}")
    kind = [x[0] for x in labels]
    by = {("O", "O"): "outside_to_outside", ("O", "B"): "outside_to_span", ("O", "S"): "outside_to_span", ("B", "I"): "begin_to_inside", ("B", "E"): "inside_to_end", ("I", "I"): "inside_to_inside", ("I", "E"): "inside_to_end"}
    by |= {(a, b): "span_to_span" for a in "ES" for b in "BS"}
    return np.array([[biases.get(by.get((a, b), ""), 0.0) for b in kind] for a in kind])


def stitched(windows: DataFrame) -> DataFrame:
    """(doc_id, position, scores) of windows (doc_id, first, low, high, scores array<array<double>>): each token's scores
    from the window whose core [low, high) it is in."""
    rows = windows.select("doc_id", "first", "low", "high", F.posexplode("scores").alias("i", "scores"))
    place = (F.col("first") + F.col("i")).cast("int")
    return rows.withColumn("position", place).where("position >= low and position < high").select("doc_id", "position", "scores")
