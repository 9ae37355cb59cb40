"""Operator 8, near duplicates among vectors by cross-polytope hashing.

A vector is rotated by rounds of random signs and fast Hadamard transforms and hashed to the axis, with its sign,
that it is closest to.  A table's key is the label, the dimension and some such axes; with each key go probes, in which
one axis is replaced by the runner-up.  Vectors meet in a bucket if one's key is the other's key or probe.  Pairs that
meet are compared by cosine in double precision.

How many axes make a key follows from the number of rows: enough that a bucket holds ``LOAD`` rows by chance, so
buckets don't grow with the table.  How many tables there are follows from how often pairs right at the threshold agree
in an axis, which is tried out on ``TRIALS`` random pairs: a pair there shares no bucket with probability ``MISS``.

Equal vectors of a label are one node with a count.  Buckets that share their first node are one group where that makes
fewer pairs than they have one by one: near copies meet in most tables, and are compared once.  Groups are cut into
blocks of at most ``BLOCK`` members, and each pair of blocks is one piece of work: it counts links and gives a spanning
set of them, so that no pairs are listed.  A pair that meets in several groups counts in the first only.

Defined results: vectors that are null, empty or zero or hold null or non-finite components, and vectors without
a label, link with nothing and are their own component; vectors of different dimensions link with nothing; repeated
rows link with each other; a null id is an id like any other; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, now_doing, runs_of, spent, written
from .components import components
from .shingles import mix

ROUNDS = 3
LOAD, MISS, TRIALS = 0.25, 1e-4, 4000
MOST_FUNCTIONS, MOST_TABLES = 6, 256
BLOCK = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _width(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def _axes(plain: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The nearest axis, with its sign, of each rotated vector, and the runner-up."""
    row, x = np.arange(len(plain)), plain
    for _ in range(ROUNDS):
        x = hadamard(x * rng.choice([-1.0, 1.0], plain.shape[1]))
    size = np.abs(x)
    best = size.argmax(axis=1)
    first = 2 * best + (x[row, best] < 0)
    size[row, best] = -1
    second = size.argmax(axis=1)
    return first.astype(np.uint64), (2 * second + (x[row, second] < 0)).astype(np.uint64)


def shape_of(rows: int, dim: int, threshold: float) -> tuple[int, int]:
    """Axes a key and tables for a number of rows: see above."""
    width = _width(dim)
    functions = min(MOST_FUNCTIONS, max(2, math.ceil(math.log(max(2.0, rows / LOAD)) / math.log(2 * width))))
    rng = np.random.default_rng([81, width])
    a, b = rng.normal(size=(2, TRIALS, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b / np.linalg.norm(b, axis=1, keepdims=True)
    both = _axes(np.concatenate([a, b]), rng)
    (a1, b1), (a2, b2) = ((x[:TRIALS], x[TRIALS:]) for x in both)
    same, near = (a1 == b1).mean(), ((a1 == b2) | (b1 == a2)).mean()
    meets = same**functions + functions * same ** (functions - 1) * near
    return functions, min(MOST_TABLES, max(1, math.ceil(math.log(MISS) / math.log(1 - min(meets, 0.999)))))


def table_keys(vectors: np.ndarray, salts: np.ndarray, functions: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (n, tables) and probes (n, tables, functions) of vectors of one dimension; ``salts`` by row tell labels apart."""
    n, dim = vectors.shape
    width = _width(dim)
    plain = np.zeros((n, width))
    plain[:, :dim] = vectors
    rng = np.random.default_rng([8, width])
    keys, probes = np.empty((n, tables), np.uint64), np.empty((n, tables, functions), np.uint64)
    for t in range(tables):
        axes = [_axes(plain, rng) for _ in range(functions)]
        base = mix(salts + np.uint64((t + 1) * 0x9E3779B97F4A7C15 + dim & 0xFFFFFFFFFFFFFFFF))
        for p in range(-1, functions):  # the key itself, then with the p-th axis' runner-up
            out = base
            for f, axis in enumerate(axes):
                out = mix(out + axis[f == p] + np.uint64(1))
            if p < 0:
                keys[:, t] = out
            else:
                probes[:, t, p] = out
    return keys.view(np.int64), probes.view(np.int64)


def _hashed(nodes: DataFrame, functions: int, tables: int) -> DataFrame:
    """(node, keys, probes) of (node, vector)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        salts = np.asarray(batch.column(1)).view(np.uint64)
        vectors = batch.column(2).to_pylist()
        keys, probes = np.zeros((len(vectors), tables), np.int64), np.zeros((len(vectors), tables * functions), np.int64)
        dims = np.array([len(v) for v in vectors])
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            x = np.array([vectors[i] for i in rows])
            k, p = table_keys(x / np.abs(x).max(axis=1, keepdims=True), salts[rows], functions, tables)
            keys[rows], probes[rows] = k, p.reshape(len(rows), -1)
        to_list = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
        return pa.record_batch([batch.column(0), to_list(keys), to_list(probes)], ["node", "keys", "probes"])

    return map_batches(nodes.select("node", "salt", "vector"), each, "node long, keys array<long>, probes array<long>", 1 << 20)


def first_common(groups: list[list[int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of members the smallest group that both are in; a member's groups are ascending."""
    most = max(map(len, groups))
    none = np.iinfo(np.int64).max
    table = np.full((len(groups), most), none)
    for i, g in enumerate(groups):
        table[i, : len(g)] = g
    out = np.full(len(a), none)
    for low in range(0, len(a), 1 << 17):
        x, y = table[a[low : low + (1 << 17)]], table[b[low : low + (1 << 17)]]
        open_ = np.arange(len(x))
        for j in range(most):
            hit = (y[open_] == x[open_, j][:, None]).any(axis=1) & (x[open_, j] != none)
            out[low + open_[hit]] = x[open_[hit], j]
            open_ = open_[~hit]
            if not len(open_):
                break
    return out


def _links_of(group: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one pair of blocks of a group: nodes with links, the vectors they link with, and a spanning set of links."""
    node, block, copies = (np.asarray(group.column(c)) for c in ("node", "block", "copies"))
    vectors = np.array(group.column("vector").to_pylist(), np.float64)
    name, bi, bj = (group.column(c)[0].as_py() for c in ("key", "bi", "bj"))
    left = np.flatnonzero(block == bi)
    right = left if bi == bj else np.flatnonzero(block == bj)
    # scaled first, so that neither large nor small components leave the range of doubles
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    norms = np.sqrt((scaled * scaled).sum(axis=1))
    close = (scaled[left] @ scaled[right].T) / (norms[left][:, None] * norms[right][None, :]) >= threshold
    if bi == bj:
        close &= np.triu(np.ones(close.shape, bool), 1)
    i, j = np.nonzero(close)
    a, b = left[i], right[j]
    if len(a):
        mine = first_common(group.column("groups").to_pylist(), a, b) == name
        a, b = a[mine], b[mine]
    counts = np.zeros(len(node), np.int64)
    np.add.at(counts, a, copies[b])
    np.add.at(counts, b, copies[a])
    # spanning set: each node's smallest neighbour, again and again until nothing changes
    label = np.arange(len(node))
    while len(a):
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (old == label).all():
            break
    at = np.flatnonzero(counts)
    spokes = np.flatnonzero(label != np.arange(len(label)))
    return node[at], counts[at], node[spokes], node[label[spokes]]


def _work(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): link counts where b is null, else links of a spanning set."""

    def run(batches):
        now_doing(__name__)
        for group in runs_of(batches, 3):
            if group.num_rows > 1:
                node, n, a, b = _links_of(group, threshold)
                if len(node):
                    yield pa.record_batch([pa.array(np.append(node, a)), pa.array([None] * len(node) + b.tolist(), pa.int64()), pa.array(n.tolist() + [None] * len(a), pa.int64())], ["a", "b", "links"])

    bounded_batches(rows.sparkSession)
    return rows.select("key", "bi", "bj", "block", "node", "copies", "vector", "groups").mapInArrow(run, "a long, b long, links long")


def _groups(members: DataFrame) -> DataFrame:
    """(key, node) of groups: buckets (key, node, size), or those with one first node together where they hold nearly the
    same nodes and so make fewer pairs."""
    first = members.groupBy("key").agg(F.min("node").alias("first"))
    rows = members.join(first, "key")
    alone = rows.groupBy("first").agg(F.sum(F.col("size").cast("double")).alias("pairs"))  # each member meets its bucket
    union = rows.select("first", "node").distinct().groupBy("first").agg(F.count("*").cast("double").alias("nodes"))
    joins = written(alone.join(union, "first").select("first", (F.col("nodes") * F.col("nodes") < F.col("pairs")).alias("join")), "joins")
    rows = rows.join(joins, "first").withColumn("key", F.when(F.col("join"), F.xxhash64("first")).otherwise(F.col("key")))
    return rows.select("key", "node").distinct()


def near_duplicates(table: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("node", F.when(fit, F.xxhash64("label", "vector")))
    grouped = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("vector").alias("vector"), F.first(F.xxhash64("label")).alias("salt"))
    nodes = written(grouped, "vectors")
    size = nodes.agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("dim")).first()
    functions, tables = shape_of(size["rows"], size["dim"] or 2, threshold)
    hashed = written(_hashed(nodes, functions, tables), "hashed")
    primary = hashed.select("node", F.explode("keys").alias("key"), F.lit(True).alias("primary"))
    keys = primary.union(hashed.select("node", F.explode("probes").alias("key"), F.lit(False).alias("primary")))
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high"), F.max("primary").alias("primary"))
    buckets = written(buckets.where("low != high and primary").select("key", "size"), "buckets")
    members = written(keys.select("key", "node").join(buckets, "key"), "members")
    spent(hashed, buckets)
    members_of = written(_groups(members), "groups")
    spent(members)
    of_node = members_of.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("groups"))  # a key and its probes for each table at most
    vectors = written(nodes.select("node", "copies", "vector").join(of_node, "node"), "members-vectors")
    sizes = members_of.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    parts = members_of.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node")
    work = parts.join(vectors, "node").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "node")
    found = written(_work(work, threshold), "found")
    spent(members_of, vectors)
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(found.where("b is not null").select("a", "b"))
    smallest = labels.join(nodes.select("node", "first"), "node").groupBy("label").agg(F.min("first").alias("component"))
    linked = labels.join(smallest, "label").select("node", "component")
    of_node = nodes.select("node", "copies", "first").join(counts, "node", "left").join(linked, "node", "left")
    of_node = written(of_node.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "first").alias("component")), "of-node")
    out = rows.select("vec_id", "node").join(of_node, "node", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
