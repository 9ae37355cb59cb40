"""Operator 10, removal of long repeated byte strings with suffix arrays.

A byte goes if some ``window`` bytes that cover it also start anywhere else in the corpus.  To find them without one
array over the corpus, each window is filed under its anchor: the ``window // 2`` bytes within it that have the
smallest hash.  Equal windows have equal anchors at equal offsets, so only windows filed under one anchor need
comparing, and neighbouring windows share theirs.  Anchors that occur once are done with.  Where two occurrences
agree in all their windows, one hash each shows it; what is left are the edges of repeated passages, whose bytes are
dealt by anchor.  There, each batch gets a suffix array of its windows; arrays of a task form a logarithmic family:
a new one is merge-scanned against the existing ones, which finds the windows that occur in both, byte by byte, and
arrays of equal size become one.  Anchors with
more than ``CROWD`` different edges are counted window by window instead, which no single task has to do.

Texts that are equal as a whole, by 128 bits of hash, are one text with a count.  Other hashes are 64 bits on top of the
anchor's 64.

Defined results: null and empty texts have nothing to remove; repeated rows of ``window`` bytes or more are removed
whole, shorter ones are left; a null doc_id is kept as it is; an empty table gives an empty table; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, now_doing, pieces_of, spent, texts_of, written
from .shingles import _BYTE, _powers, mix

WINDOW = 400
#: Different contexts of one anchor that a task compares; anchors with more are counted by window.
CROWD = 150
#: Windows of a crowded anchor that are first counted together.
STRIDE = 8
#: Bytes of contexts that a task gets on average, and of the smallest suffix array of its family.
TASK, BATCH = 512 << 10, 128 << 10
_ODD = np.uint64(0xD1B54A32D192ED03)


class Anchors:
    """The anchors of one text: for each, where it is, the first and last window filed under it, and their hashes."""

    def __init__(self, data: np.ndarray, window: int = WINDOW):
        n, k = len(data), window // 2
        self.window = window
        if n < window:
            self.at = self.low = self.high = np.zeros(0, np.int64)
            self.key = self.context = np.zeros(0, np.uint64)
            return
        power, self._inverse = _powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=self._sums[1:])
        grams = mix((self._sums[k:] - self._sums[:-k]) * self._inverse[: n - k + 1])
        # smallest hash first, of equal ones the leftmost
        ordered = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        span, width = window - k + 1, 1
        least = ordered
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            count = len(ordered) - span + 1
            least = np.minimum(least[:count], least[span - width : span - width + count])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(anchor))
        self.low, self.high = np.append(0, cut + 1), np.append(cut, len(anchor) - 1)
        self.at = anchor[self.low]
        self.key = grams[self.at]
        extent = (self.at - self.low).astype(np.uint64) * _ODD + (self.high - self.low).astype(np.uint64)
        self.context = mix(mix((self._sums[self.high + window] - self._sums[self.low]) * self._inverse[self.low] + extent) + self.key)

    def window_hashes(self, i: int) -> np.ndarray:
        """Hashes of the windows of anchor ``i``; equal windows of an anchor have equal hashes."""
        start = np.arange(self.low[i], self.high[i] + 1)
        plain = (self._sums[start + self.window] - self._sums[start]) * self._inverse[start]
        return mix(mix(plain + (self.at[i] - start).astype(np.uint64) * _ODD) + self.key[i])


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class SuffixArray:
    """The windows of some contexts in lexicographic order, whose they are, and which are equal to another."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, owners: np.ndarray, repeated: np.ndarray, window: int):
        self.data, self.starts, self.owners, self.repeated, self.window = data, starts, owners, repeated, window

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, owners: np.ndarray, window: int) -> SuffixArray:
        """Sorted by doubling; neighbours of equal rank are repeated."""
        rank = _ranks(data, window)[starts]
        order = np.argsort(rank, kind="stable")
        same = rank[order][1:] == rank[order][:-1]
        twin = np.zeros(len(order), bool)
        twin[1:] |= same
        twin[:-1] |= same
        return cls(data, starts[order], owners[order], twin, window)

    def merged(self, other: SuffixArray) -> SuffixArray:
        """Both in one order.  Each window of the smaller array is placed in the larger one; the scan of the places
        marks the windows that stand next to an equal one of the other array."""
        big, small = (self, other) if len(self.starts) >= len(other.starts) else (other, self)
        place, equal = _places(big, small)
        big.repeated[place[equal]] = True  # of several equal ones the others are marked already
        small.repeated[equal] = True
        at = place + np.arange(len(place))
        rest = np.ones(len(big.starts) + len(small.starts), bool)
        rest[at] = False

        def woven(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.empty(len(rest), x.dtype)
            out[rest], out[at] = x, y
            return out

        starts = woven(big.starts, small.starts + len(big.data))
        return SuffixArray(np.concatenate([big.data, small.data]), starts, woven(big.owners, small.owners), woven(big.repeated, small.repeated), self.window)


def _ranks(data: np.ndarray, window: int) -> np.ndarray:
    """Rank of each position by its next ``window`` bytes, by doubling; the end of the data sorts first."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key, width = np.zeros(n, np.uint64), min(7, window)
    for i in range(width):  # 9 bits a byte, so that the end differs from a zero
        key = key << np.uint64(9) | np.where(np.arange(n) + i < n, padded[i : n + i].astype(np.uint64) + np.uint64(1), np.uint64(0))
    rank = _dense(key)
    while width < window:
        step = min(width, window - width)
        after = np.zeros(n, np.uint64)
        after[: n - step] = rank[step:] + np.uint64(1)
        rank = _dense(rank * np.uint64(n + 2) + after)
        width += step
    return rank


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    new = np.empty(len(key), np.uint64)
    new[order] = np.cumsum(np.append(False, np.diff(key[order]) != 0)).astype(np.uint64)
    return new


def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def _places(big: SuffixArray, small: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``small``, how many of ``big`` are smaller, and whether the next one is equal to it.

    All are searched for at once.  How far two windows agree is found by bisection on the hashes of their beginnings;
    windows that agree throughout are compared as bytes.
    """
    window, (a_sums, a_inverse), (b_sums, b_inverse) = big.window, _prefix_sums(big.data), _prefix_sums(small.data)
    q = small.starts
    b_base, b_scale = b_sums[q], b_inverse[q]

    def agreement(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(p), np.int64), np.full(len(p), window)
        a_base, a_scale, mine = a_sums[p], a_inverse[p], q[rows]
        while (low < high).any():
            half = (low + high + 1) // 2
            same = (a_sums[p + half] - a_base) * a_scale == (b_sums[mine + half] - b_base[rows]) * b_scale[rows]
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low

    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(big.starts))
    equal = np.zeros(len(q), bool)
    open_ = np.arange(len(q))
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        p = big.starts[middle]
        agree = agreement(p, open_)
        whole = agree == window
        at = np.where(whole, 0, agree)
        smaller = ~whole & (big.data[p + at] < small.data[q[open_] + at])
        low[open_[smaller]] = middle[smaller] + 1
        high[open_[~smaller]] = middle[~smaller]
        equal[open_[whole]] = True  # the search ends at the first of the equal ones
        open_ = open_[low[open_] < high[open_]]
    found = np.flatnonzero(equal)
    span = np.arange(window)
    for k in range(0, len(found), 4096):
        part = found[k : k + 4096]
        equal[part] = (big.data[big.starts[low[part]][:, None] + span] == small.data[q[part][:, None] + span]).all(axis=1)
    return low, equal


class Family:
    """Suffix arrays whose sizes double: a batch becomes an array, and arrays of a size are merged as counters carry.

    Any two batches meet in exactly one merge, so all windows that occur twice are found once all are merged.
    """

    def __init__(self, window: int):
        self.window = window
        self.levels: list[tuple[int, SuffixArray]] = []

    def add(self, data: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> None:
        level, new = 0, SuffixArray.of(data, starts, owners, self.window)
        while self.levels and self.levels[-1][0] <= level:
            new = self.levels.pop()[1].merged(new)
            level += 1
        self.levels.append((level, new))

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Owners and repeated flags of all windows."""
        while len(self.levels) > 1:
            (_, b), (level, a) = self.levels.pop(), self.levels.pop()
            self.levels.append((level + 1, a.merged(b)))
        if not self.levels:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        return self.levels[0][1].owners, self.levels[0][1].repeated


def _anchor_rows(texts: DataFrame, window: int) -> DataFrame:
    """(key, context, t, many) by text and context of an anchor: ``many`` if the text has it more than once."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]]
        for t, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            a = Anchors(_bytes(text), window)
            if len(a.at):
                context, first, count = np.unique(a.context, return_index=True, return_counts=True)
                for column, x in zip(out, (a.key[first], context, np.full(len(context), t), count > 1), strict=True):
                    column.append(x)
        key, context, t, many = map(np.concatenate, out)
        return pa.record_batch([_signed(key), _signed(context), pa.array(t), pa.array(many)], ["key", "context", "t", "many"])

    return map_batches(texts, each, "key long, context long, t long, many boolean", 2 << 20)


def _contexts(rows: DataFrame, window: int) -> DataFrame:
    """(key, context, t, back, data, kinds) of the wanted contexts of texts (t, text, edges)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for t, text, edges in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            data = _bytes(text)
            a = Anchors(data, window)
            wanted = {e["context"]: e["kinds"] for e in edges}
            mine, first = np.unique(a.context.view(np.int64), return_index=True)
            for i in first[np.isin(mine, list(wanted))].tolist():
                context = int(a.context[i : i + 1].view(np.int64)[0])
                out.append((int(a.key[i : i + 1].view(np.int64)[0]), context, t, int(a.at[i] - a.low[i]), data[a.low[i] : a.high[i] + window].tobytes(), wanted[context]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "context", "t", "back", "data", "kinds"])

    return map_batches(rows, each, "key long, context long, t long, back int, data binary, kinds long", 2 << 20)


def _compare(contexts: DataFrame, window: int) -> DataFrame:
    """(t, context, low, high): runs of repeated windows, counted from the context's first; dealt by anchor."""

    def run(batches):
        now_doing(__name__)
        family, owners, begins, serial = Family(window), [], [], 0
        for batch in pieces_of(batches, BATCH):
            data, starts, whose = [], [], []
            at = 0
            for t, context, blob in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                n = len(blob) - window + 1
                data.append(blob)
                starts.append(np.arange(at, at + n))
                whose.append(np.arange(serial, serial + n))
                owners.append((t, context))
                begins.append(serial)
                at += len(blob)
                serial += n
            family.add(np.frombuffer(b"".join(data), np.uint8), np.concatenate(starts), np.concatenate(whose))
        whose, repeated = family.finish()
        flags = np.zeros(serial + 1, bool)
        flags[whose[repeated]] = True
        edge = np.zeros(serial + 1, bool)
        edge[begins] = True
        low = np.flatnonzero(flags & (edge | ~np.append(False, flags[:-1])))
        stop = np.append(~flags[1:] | edge[1:], True)
        high = np.flatnonzero(flags & stop)
        owner = np.searchsorted(begins, low, side="right") - 1
        base = np.asarray(begins, np.int64)[owner] if len(owner) else owner
        for k in range(0, len(low), 50_000):
            part = slice(k, k + 50_000)
            mine = [owners[i] for i in owner[part].tolist()]
            yield pa.record_batch([pa.array([x[0] for x in mine], pa.int64()), pa.array([x[1] for x in mine], pa.int64()), pa.array((low - base)[part]), pa.array((high - base)[part])], ["t", "context", "low", "high"])

    # a task's arrays take about 60 times the bytes of its contexts; no key has more than CROWD contexts
    size = contexts.agg(F.sum(F.octet_length("data")).alias("n")).first()["n"] or 0
    bounded_batches(contexts.sparkSession)
    return contexts.repartition(max(1, -(-size // TASK)), "key").mapInArrow(run, "t long, context long, low long, high long")


def _hasher(blob: bytes, key: int):
    """Hashes of stretches [low, high) of a context, told apart by a label, within its anchor."""
    data = np.frombuffer(blob, np.uint8)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    anchor = np.array([key], np.int64).view(np.uint64)

    def of(low: np.ndarray, high: np.ndarray, label: np.ndarray) -> np.ndarray:
        return mix(mix((sums[high] - sums[low]) * inverse[low] + label.astype(np.uint64) * _ODD) + anchor)

    return of


def _count_windows(contexts: DataFrame, window: int) -> DataFrame:
    """As ``_compare``, by counting hashes: of ``STRIDE`` neighbouring windows at a time, then of single ones.

    Windows are taken together by their offset from the anchor.  Where what they have in common, their core, occurs
    once, none of them is repeated; where all their bytes occur twice, all are; the rest is counted window by window,
    with one of each kind of the repeated ones to compare with.
    """

    def blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for key, context, t, back, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            of, n = _hasher(blob, key), len(blob) - window + 1
            number = np.arange((back - n + 1) // STRIDE, back // STRIDE + 1)
            last, first = back - STRIDE * number, back - STRIDE * number - STRIDE + 1  # starts of the block's windows
            core = of(last, first + window, 2 * number)
            whole = (first >= 0) & (last < n)
            full = of(np.where(whole, first, 0), np.where(whole, last + window, 0), 2 * number + 1)
            low, high = np.maximum(first, 0), np.minimum(last, n - 1)
            out += zip([t] * len(number), [context] * len(number), core.view(np.int64).tolist(), [x if w else None for x, w in zip(full.view(np.int64).tolist(), whole.tolist(), strict=True)], low.tolist(), high.tolist(), strict=True)
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["t", "context", "core", "full", "low", "high"])

    first = written(map_batches(contexts, blocks, "t long, context long, core long, full long, low long, high long", 2 << 20), "blocks")
    cores = written(first.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "cores")
    live = written(first.join(cores, "core").drop("core"), "live")
    kinds = live.where("full is not null").groupBy("full").agg(F.count("*").alias("n"), F.min(F.struct("t", "context")).alias("one"))
    live = live.join(written(kinds.where("n > 1").select("full", "one"), "block-kinds"), "full", "left")
    live = written(live, "live")
    done = live.where("one is not null").select("t", "context", "low", "high")
    open_ = live.where("one is null or (one.t = t and one.context = context)").groupBy("t", "context").agg(F.collect_list(F.struct("low", "high")).alias("runs"))

    def single(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for key, context, t, back, blob, runs in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            start = np.concatenate([np.arange(r["low"], r["high"] + 1) for r in runs])
            hashes = _hasher(blob, key)(start, start + window, back - start)
            for column, x in zip(out, (hashes, np.full(len(start), t), np.full(len(start), context), start), strict=True):
                column.append(x)
        hashes, t, context, start = map(np.concatenate, out)
        return pa.record_batch([_signed(hashes), pa.array(t), pa.array(context), pa.array(start)], ["hash", "t", "context", "low"])

    asked = contexts.join(written(open_, "open-blocks"), ["t", "context"]).select("key", "context", "t", "back", "data", "runs")
    windows = written(map_batches(asked, single, "hash long, t long, context long, low long", 2 << 20), "windows")
    twice = written(windows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "twice")
    return done.union(windows.join(twice, "hash").select("t", "context", "low", F.col("low").alias("high")))


def _spans(data: np.ndarray, whole: np.ndarray, parts: list[tuple[int, int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal removed runs [low, high) of a text."""
    a = Anchors(data, window)
    mine = a.context.view(np.int64)
    cover = np.zeros(len(data) + 1, np.int64)
    full = np.isin(mine, whole)
    np.add.at(cover, a.low[full], 1)
    np.add.at(cover, a.high[full] + window, -1)
    by: dict[int, list[int]] = {}
    for i, c in enumerate(mine.tolist()):
        by.setdefault(c, []).append(i)
    for context, low, high in parts:
        for i in by.get(context, ()):
            cover[a.low[i] + low] += 1
            cover[a.low[i] + high + window] -= 1
    gone = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    edge = np.flatnonzero(gone[1:] != gone[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def repeated_spans(docs: DataFrame, window: int, finish: Callable[[list[str], list[list[tuple[int, int]]]], list[pa.Array]], columns: str, more: tuple[str, ...] = (), instead: dict[str, Column] | None = None) -> DataFrame:
    """Per row (doc_id, text, rest, t, u, copies, columns) with the ``more`` columns as a struct in rest; the ``columns`` are null where a text has nothing to remove.

    ``finish`` makes the ``columns`` from texts and their removed runs, within the task that finds these; with ``instead``
    rows have these columns of texts and not the texts themselves, which then aren't moved.

    ``t`` and ``u`` are hashes of the text and ``copies`` how many rows have it; a text with several copies is removed
    whole where it has ``window`` bytes.  Texts with very many copies are found by a broadcast, and no rows are moved to
    them: there are at most ``MOST_BROADCAST`` of them.
    """
    if window < 2 * STRIDE:
        raise ValueError(f"windows have {2 * STRIDE} bytes at least")
    rest = F.struct(*[F.col(f"`{c}`") for c in more]) if more else F.lit(None).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    rows = rows.withColumn("t", F.xxhash64("text", F.lit(10))).withColumn("u", F.xxhash64("text", F.lit(11)))
    long_ = rows.where(F.octet_length("text") >= window)
    anchors = written(_anchor_rows(long_.select("t", "text"), window), "anchors")
    mark = F.xxhash64("context", "t")
    keys = anchors.groupBy("key").agg(F.min(mark).alias("low"), F.max(mark).alias("high"), F.max("many").alias("many"))
    keys = written(keys.where("low != high or many").select("key"), "keys")
    # anchors that occur twice, by text
    again = anchors.join(_small(keys), "key").groupBy("key", "context", "t").agg(F.max("many").alias("many"))
    again = written(again, "again")
    spent(anchors, keys)
    contexts = again.groupBy("key", "context").agg((F.count("*") + F.max(F.col("many").cast("int"))).alias("n"), F.min("t").alias("first"))
    contexts = written(contexts, "contexts")
    different = contexts.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    # whole contexts that occur twice; and one of each kind where an anchor has several
    state = contexts.join(different, "key", "left").select("context", "n", "first", F.coalesce("kinds", F.lit(1)).alias("kinds"))
    known = again.join(written(state.where("n > 1 or kinds > 1"), "state"), "context")
    edge = (F.col("kinds") > 1) & ((F.col("n") == 1) | (F.col("t") == F.col("first")))
    # as many as the text has anchors
    info = known.groupBy("t").agg(F.collect_list(F.when(edge, F.struct("context", "kinds"))).alias("edges"), F.collect_list(F.when(F.col("n") > 1, F.col("context"))).alias("whole"))
    info = written(info, "info")
    spent(again, contexts)
    # the texts concerned, each once
    owner = written(rows.groupBy("t", "u").agg(F.count("*").alias("copies")), "owners")
    texts = long_.join(_small(info.select("t")), "t", "left_semi").groupBy("t", "u").agg(F.first("text").alias("text"))
    asked = texts.join(info.join(owner.select("t", "u"), "t"), ["t", "u"]).select("t", "u", "text", "edges", "whole")
    asked = written(asked, "asked")
    spent(info)
    edges = written(_contexts(asked.where(F.size("edges") > 0).select("t", "text", "edges"), window), "edges")
    few, many = edges.where(F.col("kinds") <= CROWD).drop("kinds"), edges.where(F.col("kinds") > CROWD).drop("kinds")
    parts = written(_compare(few, window).union(_count_windows(many, window)), "parts")
    spent(edges)
    parts = written(parts.groupBy("t").agg(F.collect_list(F.struct("context", "low", "high")).alias("parts")), "parts-of")

    names = [c.split()[0] for c in columns.split(", ")]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(2))
        spans = [_spans(_bytes(text), np.array(whole or [], np.int64), [(p["context"], p["low"], p["high"]) for p in part or ()], window)
                 for text, whole, part in zip(texts, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        return pa.record_batch([*batch.columns[:2], *finish(texts, spans)], ["t", "u", *names])

    cut = asked.join(_small(parts), "t", "left").select("t", "u", "text", "whole", "parts")
    removed = written(map_batches(cut, each, f"t long, u long, {columns}", 1 << 20), "removed")
    spent(asked, parts)
    n = owner.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > max(HOT, -(-n // MOST_BROADCAST))
    marked = rows.join(F.broadcast(owner.where(hot).select("t", "u", F.col("copies").alias("many"))), ["t", "u"], "left")
    if instead is not None:
        marked = marked.select("doc_id", "t", "u", "many", *[c.alias(name) for name, c in instead.items()])
    # of a text with copies all goes or, where it is shorter than a window, nothing
    often = marked.where("many is not null").withColumnRenamed("many", "copies")
    rarely = marked.where("many is null").drop("many").join(owner.where(~hot), ["t", "u"]).join(removed, ["t", "u"], "left")
    return rarely.unionByName(often, allowMissingColumns=True)


#: Copies of a text from which on it may count as one with very many.
HOT = 64
#: Rows of a table with a key that is broadcast instead of moving texts or anchors to it; about 16 bytes each, or the runs of a text.
MOST_BROADCAST = 1 << 18


def _small(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if it has at most ``MOST_BROADCAST`` rows."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for low, high in spans:
        kept.append(data[at:low])
        at = high
    return b"".join([*kept, data[at:]])


def _digests(texts: list[str], spans: list[list[tuple[int, int]]]) -> list[pa.Array]:
    gone = [sum(high - low for low, high in s) for s in spans]
    digest = [hashlib.sha256(_cut(t.encode("utf-8", "surrogatepass"), s)).hexdigest() for t, s in zip(texts, spans, strict=True)]
    return [pa.array(gone, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(digest, pa.string())]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes)."""
    rows = repeated_spans(docs, window, _digests, "gone long, spans long, digest string", instead={"n_bytes": F.octet_length("text").cast("long"), "sha": F.sha2("text", 256)})
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    return rows.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("digest", "sha")).alias("kept_sha256"),
    )


def _kept(texts: list[str], spans: list[list[tuple[int, int]]]) -> list[pa.Array]:
    """What remains; a character stays unless all its bytes are removed."""
    out = []
    for text, runs in zip(texts, spans, strict=True):
        data, whole = text.encode("utf-8", "surrogatepass"), []
        for low, high in runs:
            while low < high and data[low] & 0xC0 == 0x80:
                low += 1
            while high > low and high < len(data) and data[high] & 0xC0 == 0x80:
                high -= 1
            whole.append((low, high))
        out.append(_cut(data, whole).decode("utf-8", "surrogatepass"))
    return [pa.array(out, pa.string())]


def without_repeats(docs: DataFrame, window: int = WINDOW, more: list[str] | None = None) -> DataFrame:
    """doc_id, text and ``more`` columns with the remaining texts; a character stays unless all its bytes are removed."""
    rows = repeated_spans(docs, window, _kept, "kept string", tuple(more or ()))
    whole = (F.col("copies") > 1) & (F.octet_length("text") >= window)
    text = F.when(whole, F.lit("")).otherwise(F.coalesce("kept", "text")).alias("text")
    return rows.select("doc_id", text, *(["rest.*"] if more else []))
