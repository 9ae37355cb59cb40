"""Propagation: confirmed values are looked for in the whole document, exactly and within an edit budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import match_key
from ..tables import bounded_batches
from .tokens import tokens

MIN_KEY, FLOOR, ROUNDS = 4, 0.88, 4
_WORD, _OTHER = re.compile(r"\S+", re.ASCII), re.compile(r"[^A-Za-z0-9_]+")


def edit_budget(length: Column) -> Column:
    # Edits allowed by key length
    return F.when(length < 6, 0).when(length < 10, 1).when(length < 16, 2).otherwise(3)


def fuzzy_match(found: Column, key: Column, floor: float = FLOOR) -> Column:
    """Not equal, within the budget for the key's length, and similar enough."""
    budget = edit_budget(F.length(key))
    distance = F.levenshtein(found, key, 3)
    similar = 1 - distance / F.greatest(F.length(found), F.length(key)) >= floor
    return (found != key) & (F.abs(F.length(found) - F.length(key)) <= budget) & (distance >= 0) & (distance <= budget) & similar


#: Blocks that the values of a group are dealt into, each to be compared with all of the group's keys.
BLOCKS = 16
#: Values of a block that go down the tree of keys together, and places of theirs in it at a time.
TOGETHER, PLACES = 1024, 1 << 18


def _by_length(values: np.ndarray, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the values as rows of code points in order, and their weights."""
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    out = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        at = at[np.argsort(values[at])]  # by code points
        points = np.frombuffer("".join(values[at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)
        out[n] = points, weights[at]
    return out


class _Tree:
    """Sorted keys of one length as a tree: the nodes of each depth with their letter and their children's range."""

    def __init__(self, points: np.ndarray):
        size, length = points.shape
        new = np.zeros(size, bool)
        new[:1] = True
        self.letters, self.first = [], []
        starts = np.zeros(1, np.int64)
        for i in range(length):
            new[1:] |= points[1:, i] != points[:-1, i]
            below = np.flatnonzero(new)
            self.letters.append(points[below, i])
            self.first.append(np.append(np.searchsorted(below, starts), len(below)))
            starts = below
        self.alphabet = np.unique(points)


def _matched(words: np.ndarray, tree: _Tree, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place in ``words``, place in the tree's keys) of unequal ones that are within ``most`` edits.

    All words go down the tree at once.  A word stays at a node with its band of the table of distances, as long as an
    entry leaves enough edits for what has to be bridged yet: the difference of the lengths, and letters that no key has.
    """
    n, width = words.shape
    depth, side = len(tree.letters), 2 * most + 1
    # letters from each place on that aren't any key's cost an edit each
    foreign = np.zeros((n, width + 1), np.int16)
    foreign[:, :width] = np.cumsum(~np.isin(words, tree.alphabet)[:, ::-1], axis=1)[:, ::-1]
    far = np.int16(most + 1)
    shifts = np.arange(-most, most + 1)

    def alive(word: np.ndarray, band: np.ndarray, i: int) -> np.ndarray:
        keep = np.zeros(len(word), bool)
        for k, shift in enumerate(shifts.tolist()):
            j = i + shift
            if 0 <= j <= width:
                keep |= band[:, k] + np.maximum(foreign[word, j], abs((depth - i) - (width - j))) <= most
        return keep

    word = np.arange(n)
    band = np.tile(np.where(shifts >= 0, shifts, most + 1).astype(np.int16), (n, 1))
    band[:, shifts > width] = far
    keep = alive(word, band, 0)
    stack = [(0, word[keep], np.zeros(int(keep.sum()), np.int64), band[keep])]
    while stack:
        i, word, node, band = stack.pop()
        if not len(word):
            continue
        if i == depth:
            d = band[:, width - depth + most]
            hit = (d > 0) & (d <= most)
            yield word[hit], node[hit]
            continue
        low = tree.first[i][node]
        grown = tree.first[i][node + 1] - low
        total = int(grown.sum())
        if total > PLACES and len(word) > 1:
            half = len(word) // 2
            stack += [(i, word[half:], node[half:], band[half:]), (i, word[:half], node[:half], band[:half])]
            continue
        parent = np.repeat(np.arange(len(word)), grown)
        node = np.arange(total) - np.repeat(np.cumsum(grown) - grown, grown) + low[parent]
        word, letter, old = word[parent], tree.letters[i][node], band[parent]
        new = np.full((total, side), far, np.int16)
        for k, shift in enumerate(shifts.tolist()):
            j = i + 1 + shift  # letters of the word that are gone
            if not 0 <= j <= width:
                continue
            if j == 0:
                new[:, k] = i + 1
                continue
            best = old[:, k] + (words[word, j - 1] != letter)
            if k + 1 < side:
                best = np.minimum(best, old[:, k + 1] + 1)
            if k:
                best = np.minimum(best, new[:, k - 1] + 1)
            new[:, k] = np.minimum(best, far)
        keep = alive(word, new, i + 1)
        stack.append((i + 1, word[keep], node[keep], new[keep]))


def similar_pairs(values: list[str], weights: list[int], keys: list[str], counts: list[int], floor: float = FLOOR) -> int:
    """Pairs of a value and a key that match by ``fuzzy_match``, each counted as often as its weight and count say."""
    n = 0
    as_arrays = lambda v, w: (np.array(v, object), np.array(w, np.int64))
    left, right = _by_length(*as_arrays(values, weights)), _by_length(*as_arrays(keys, counts))
    for length, (points, count) in right.items():
        budget = 0 if length < 6 else 1 if length < 10 else 2 if length < 16 else 3
        tree = None
        for other in range(max(1, length - budget), length + budget + 1):
            most = max((d for d in range(1, budget + 1) if 1 - d / max(length, other) >= floor), default=0)
            if other not in left or most < max(1, abs(length - other)):
                continue
            tree = tree or _Tree(points)
            words, weight = left[other]
            for at in range(0, len(words), TOGETHER):
                for a, b in _matched(words[at : at + TOGETHER], tree, most):
                    n += int((weight[at + a] * count[b]).sum())
    return n


def fuzzy_counts(found: DataFrame, keys: DataFrame, group: str, value: str, key: str, floor: float = FLOOR) -> DataFrame:
    """(group, n): pairs of a row of ``found`` and one of ``keys`` in a group that match by ``fuzzy_match``.

    Equal values are compared once and counted as often as they occur.  A group is compared by many tasks; in each the
    keys are a tree that all values go down together, so only what is still within the edits is met.
    """
    left = found.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("a")).agg(F.count("*").alias("m"))
    right = keys.where(F.col(group).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(group).alias("g"), F.col(key).alias("a")).agg(F.count("*").alias("m"))
    left = left.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(BLOCKS)).cast("int")).repartition(BLOCKS * 8, "g", "block")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).repartition(BLOCKS * 8, "g", "block")
    shape = StructType([StructField(group, found.schema[group].dataType), StructField("n", LongType())])
    arrow = to_arrow_schema(shape)

    def compare(at: tuple, values: pa.Table, others: pa.Table) -> pa.Table:
        n = similar_pairs(*(t[c].to_pylist() for t in (values, others) for c in ("a", "m")), floor)
        return pa.table([pa.array([at[0].as_py()] if n else [], arrow.field(0).type), pa.array([n] if n else [], pa.int64())], schema=arrow)

    pairs = left.groupBy("g", "block").cogroup(right.groupBy("g", "block")).applyInArrow(compare, shape)
    return pairs.groupBy(group).agg(F.sum("n").alias("n"))


def windows(text: DataFrame, longest: Column | int = 4) -> DataFrame:
    """(doc_id, line_no, first, size, start, end, key): runs of 1 to ``longest`` tokens of a line, without a shuffle by size."""
    words = tokens(text)
    per_line = words.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "start", "end", "text"))).alias("w"))
    sized = per_line.select("doc_id", "line_no", "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w")))).alias("size"))
    placed = sized.select("doc_id", "line_no", "w", "size", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("first"))
    run = F.slice("w", F.col("first") + 1, F.col("size"))
    return placed.select("doc_id", "line_no", "first", "size", run[0]["start"].alias("start"), F.element_at(run, -1)["end"].alias("end"), match_key(F.array_join(run["text"], "")).alias("key"))


def targets_of(mentions: DataFrame) -> DataFrame:
    """(doc_id, key, entity_type, size) of values whose key is long enough; the first of equal keys and types counts."""
    keyed = mentions.select("doc_id", "entity_type", match_key(F.col("value")).alias("key"), F.size(F.filter(F.split("value", r"\s+"), lambda w: w != "")).alias("size"))
    return keyed.where(F.length("key") >= MIN_KEY).groupBy("doc_id", "key", "entity_type").agg(F.min("size").alias("size"))


def _edge(word: str) -> int:
    """How many characters stand before the first letter, digit or underscore; none in a word without any."""
    return next((i for i, c in enumerate(word) if c.isalnum() or c == "_"), 0)


def _found(text: str, targets: list[dict]) -> list[tuple]:
    """(entity_type, key, size, start, end, raw_start, raw_end) in one text; sizes follow from the targets."""
    by_key: dict[tuple[int, str], list[dict]] = {}
    for t in targets:
        for size in {max(1, t["size"] - 1), t["size"], t["size"] + 1}:
            by_key.setdefault((size, t["key"]), []).append(t)
    sizes = sorted({size for size, _ in by_key})
    out, raw, view = [], 0, 0
    for line in text.split("\n"):
        words = []
        for m in _WORD.finditer(line):
            words.append((_OTHER.sub("", m[0]).lower(), view, view + len(m[0]), raw + m.start() + _edge(m[0]), raw + m.end() - _edge(m[0][::-1])))
            view += len(m[0]) + 1
        raw += len(line) + 1
        taken: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for size in sizes:
            for i in range(len(words) - size + 1):
                run = words[i : i + size]
                key = "".join(w[0] for w in run)
                for t in by_key.get((size, key), ()):
                    mine = taken.setdefault((t["entity_type"], key), [])
                    if any(i <= s and e <= i + size for s, e in mine) or (size != t["size"] and not all(w[0] for w in run)):
                        continue
                    mine.append((i, i + size))
                    out.append((t["entity_type"], key, size, run[0][1], run[-1][2], run[0][3], run[-1][4]))
    return out


def exact(text: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, entity_type, key, size, start, end, raw_start, raw_end): runs of one token less to one more than a value's
    whose key is the value's; no run that holds a smaller match, and no longer or shorter one with a token of punctuation.

    start and end are in the line view, raw_start and raw_end in the text, without outer punctuation.  One shuffle; sizes are a document's own.
    """
    targets = targets_of(values).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("key", "entity_type", "size"))).alias("targets"))
    rows = text.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(targets, "doc_id")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc, body, wanted = (batch.column(c)[i].as_py() for c in range(3))
                found = _found(body, wanted)
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (doc, *f), strict=True)) for f in found], schema=shape)

    kind = rows.schema["doc_id"].dataType
    columns = StructType([StructField("doc_id", kind)]).add("entity_type", "string").add("key", "string")
    for name in ("size", "start", "end", "raw_start", "raw_end"):
        columns = columns.add(name, "integer")
    names, shape = columns.names, to_arrow_schema(columns)
    bounded_batches(text.sparkSession)
    return rows.mapInArrow(run, columns)


def candidates(text: DataFrame, values: DataFrame) -> DataFrame:
    """The runs that ``exact`` finds as strong candidates, with the columns of ``detectors.detect``."""
    value = F.substr("text", F.col("raw_start") + 1, F.col("raw_end") - F.col("raw_start"))
    return exact(text, values).join(text.select("doc_id", "text"), "doc_id").select(
        "doc_id", F.lit("line").alias("view"), "entity_type", F.col("raw_start").alias("start"), F.col("raw_end").alias("end"), value.alias("value"),
        F.lit("propagate").alias("detector"), F.lit("propagate.exact").alias("rule"), F.lit(2).alias("strength"), F.lit(1.0).alias("score"),
    )
