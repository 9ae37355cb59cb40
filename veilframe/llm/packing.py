"""Operator 2, best-fit packing by exact complements.

Documents are cut into pieces of at most the capacity; packing then only depends on how many pieces there are of
each length, at most ``capacity`` numbers, so the plan is made on the driver from those counts.  Lengths are taken
from the longest: a gap is filled exactly by one, two or three lengths that an index hashed by sum has for the gap and
that are still available; where no combination fits exactly, the longest length that fits goes in and the rest of the gap is tried
again.  A pattern is used as often as the counts allow, so there are few patterns however many pieces there are.
Pieces find their place by their rank among the pieces of their length; ranks are counted in salted cells, so that
no length gathers in one task.

Defined results: null and empty texts are one piece of the end id alone; repeated rows are packed each on its own;
an empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shipped, compiled, documents, map_batches, texts_of, written
from .tokenstream import LibraryVocabulary

CAPACITY, END_ID = 2048, 0


class SumIndex:
    """The lengths, pairs and triples of lengths that have a sum, hashed by it.

    A sum's entry is made when it is first asked for and holds the larger members in ascending order.  Counts only
    fall, so what the remaining pieces can't form any more is taken out for good; what only the pattern in the making
    has used up is passed over.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def _formed(self, free: np.ndarray, a: int, total: int) -> bool:
        return free[a] > 0 and free[total - a] > (2 * a == total)

    def pair(self, total: int, most: int, free: np.ndarray) -> list[int]:
        """The available pair with the largest member up to ``most``."""
        if total < 2:
            return []
        larger = self.pairs.get(total)
        if larger is None:
            a = np.arange((total + 1) // 2, total)
            larger = self.pairs[total] = a[(self.left[a] > 0) & (self.left[total - a] > (2 * a == total))].tolist()
        for i in range(bisect.bisect_right(larger, most) - 1, -1, -1):
            a = larger[i]
            if self._formed(free, a, total):
                return [a, total - a]
            if not self._formed(self.left, a, total):
                del larger[i]
        return []

    def triple(self, total: int, free: np.ndarray) -> list[int]:
        """The available triple with the largest member, then the largest next one."""
        if total < 3:
            return []
        largest = self.triples.get(total)
        if largest is None:
            a = np.arange(-(-total // 3), total - 1)
            largest = self.triples[total] = a[self.left[a] > 0].tolist()
        for i in range(len(largest) - 1, -1, -1):
            a = largest[i]
            if free[a] > 0:
                free[a] -= 1
                rest = self.pair(total - a, a, free)
                free[a] += 1
                if rest:
                    return [a, *rest]
            elif not self.left[a]:
                del largest[i]
        return []

    def complement(self, gap: int, free: np.ndarray) -> list[int]:
        """One, two or three available lengths whose sum is ``gap``, the longest first; [] if there are none."""
        return [gap] if free[gap] else self.pair(gap, gap - 1, free) or self.triple(gap, free)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and how often each is used; every piece is in exactly one."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of length {length} doesn't fit {capacity}")
        left[length] = n
    index, out = SumIndex(left), []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            pattern, free = [longest], left.copy()
            free[longest] -= 1
            gap = capacity - longest
            while gap:
                exact = index.complement(gap, free)
                if exact:
                    pattern += exact
                    break
                fits = np.flatnonzero(free[1 : gap + 1])
                if not len(fits):
                    break
                length = int(fits[-1]) + 1
                pattern.append(length)
                free[length] -= 1
                gap -= length
            uses: dict[int, int] = {}
            for length in pattern:
                uses[length] = uses.get(length, 0) + 1
            times = min(int(left[length]) // n for length, n in uses.items())
            for length, n in uses.items():
                left[length] -= n * times
            out.append((tuple(pattern), times))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: from which rank on, the sequence of that rank, and the offset in it.  Sequences count up with ranks."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, offset))
            taken[length] = rank + times
            offset += length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in out.items()}


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids, of each piece.  No shuffle."""
    file = Shipped(docs.sparkSession, tokenizer_path)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = compiled(("library", file.key), lambda: LibraryVocabulary(file.bytes()))
        ids, ends = vocabulary.encode(texts_of(batch.column(1)))
        rows: list[list] = [[] for _ in range(6)]
        low = 0
        for doc, high in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
            own = np.append(ids[low:high], end_id).astype("<u4")
            low = high
            for piece, start in enumerate(range(0, len(own), capacity)):
                part = own[start : start + capacity]
                for column, value in zip(rows, (doc, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
        return pa.record_batch([pa.array(c, k) for c, k in zip(rows[: 5 + with_ids], kinds, strict=False)], names)

    return map_batches(documents(docs), each, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids, 1 << 20)


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    ``pieces`` is read twice and has to give the same rows both times: a table.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = places(plan(counts, capacity))
    salts = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # rows of a table keep their places: equal pieces go to different cells by them
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    cells = cells.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    in_cell = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(in_cell) - 1).join(cells, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, ranks = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        order = np.argsort(lengths, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            first, begins, at = table[int(lengths[rows[0]])]
            run = np.searchsorted(first, ranks[rows], side="right") - 1
            sequence[rows] = begins[run] + ranks[rows] - first[run]
            offset[rows] = at[run]
        return pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return map_batches(ranked, each, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return assign(written(cut_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, assignment: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed ids: sequence_id, ids, and the pieces' lengths in order.  A sequence has at most ``capacity`` ids."""
    ids = cut_pieces(docs, tokenizer_path, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    parts = assignment.join(ids, ["doc_id", "piece", "ids_crc32"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("lengths"))
