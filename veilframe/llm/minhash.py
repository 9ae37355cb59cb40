"""Operator 6, near duplicates by circulant MinHash.

One permutation of the hash space scatters a set's shingles, a second one is shifted circularly by k to give the k-th
signature coordinate.  The second is a table, so the coordinates of a shingle are a run of neighbouring entries and a
signature is the elementwise minimum of such runs.  ``BANDS`` bands of ``ROWS`` coordinates are hashed to buckets:
a pair at similarity 0.8 shares none with probability (1 - 0.8 ** 6) ** 48 = 5e-7.

Equal sets are one node.  In each bucket every node is compared with one of them, the one that meets most others,
and linked where the full sets reach the threshold; links make components.  Buckets whose nodes ended up in
different components are then compared across components: pairs within a component need no further link, so a group
that holds together costs as many comparisons as it has members.  Small buckets list the pairs that sizes and one-bit
sketches of the signatures don't rule out (a false exclusion has a chance below 1e-9); members of crowded ones that are
left a partner by them are compared in blocks within tasks, which only emit links.

Defined results: null texts and texts without words have no shingles and are linked with nothing; repeated rows are
linked with each other; a null doc_id is an id like any other; an empty table gives an empty table; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents, map_batches, now_doing, pieces_of, runs_of, spent, texts_of, written
from .components import components
from .shingles import mix, overlap, set_hash, shingle_sets

BANDS, ROWS = 48, 6
COORDINATES = BANDS * ROWS
#: Places that shingles are scattered over; the shifted permutation's table has COORDINATES more.
UNIVERSE_BITS = 20
SKETCH_WORDS = COORDINATES // 64
#: Nodes that are compared with one other within a task, and keys of texts (16 bytes each) that are broadcast.
STAR_PART, MOST_BROADCAST = 256, 1 << 18
#: Equal sketch bits of a pair at similarity s are binomial with share (1 + s) / 2; this many standard deviations below.
SKETCH_SLACK = 6.5
#: Buckets with more nodes that are still apart are compared in blocks of so many, within tasks.
CROWD, CROWD_BLOCK, SKETCH_BLOCK = 12, 256, 2048

_TABLE: list[np.ndarray] = []


def _windows() -> np.ndarray:
    """Row p: the shifted permutation's values at p, p + 1, ... around the circle."""
    if not _TABLE:
        pi = np.random.default_rng(20240602).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        _TABLE.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: COORDINATES - 1]]), COORDINATES))
    return _TABLE[0]


def signature(own: np.ndarray) -> np.ndarray:
    """All coordinates of a set that isn't empty."""
    windows = _windows()
    place = (mix(own) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    out = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(place), 1024):
        np.minimum(out, windows[place[at : at + 1024]].min(axis=0), out=out)
    return out


_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; keys of different bands don't meet."""
    rows = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
    key = _BAND_SALT.copy()
    for i in range(ROWS):
        key = mix(key + rows[:, i])
    return key.view(np.int64)


def sketch(coordinates: np.ndarray) -> np.ndarray:
    bits = np.packbits((coordinates[: 64 * SKETCH_WORDS] & 1).astype(np.uint8))
    return bits.view(np.int64)


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """What tells rows apart whose ids are equal or null; rows with one id and one text have the same."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, n_shingles, node (hash of the set; null if empty), bands, sketch.  No shuffle."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, node, bands, bits = [], [], [], []
        for own in shingle_sets(texts_of(batch.column(1)), width):
            n.append(len(own))
            whole = signature(own) if len(own) else None
            node.append(set_hash(own) if len(own) else None)
            bands.append(band_keys(whole) if len(own) else None)
            bits.append(sketch(whole) if len(own) else None)
        longs = pa.list_(pa.int64())
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, longs), pa.array(bits, longs)], ["doc_id", "row", "n_shingles", "node", "bands", "sketch"])

    return map_batches(documents(docs).withColumn("row", row_key()), each, "doc_id long, row long, n_shingles long, node long, bands array<long>, sketch array<long>", 1 << 20)


def texts_by_node(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of ``wanted`` (node); ``nodes`` has the key of a row of each, ``texts`` (row, text) some repeatedly."""
    rows = written(nodes.select("node", "row").join(wanted.distinct(), "node"), "wanted")
    few = rows.count() <= MOST_BROADCAST  # then only the texts wanted are moved
    found = texts.join(F.broadcast(rows) if few else rows, "row").select("node", "text")
    found = written(found.groupBy("node").agg(F.first("text").alias("text")), "texts")
    spent(rows)
    return found


def confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b: nodes) those whose full sets reach ``percent``.

    The nodes that are compared with one b are dealt out in parts of about ``STAR_PART``, each with b's text once.
    """
    texts = texts_by_node(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), nodes, texts)
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR_PART).cast("int").alias("parts"))
    parts = written(parts, "stars")
    spokes = pairs.join(parts, "b").select("b", F.pmod(F.xxhash64("a", F.lit(6)), F.col("parts")).cast("int").alias("part"), F.col("a").alias("node"))
    spokes = spokes.join(texts, "node").select("b", "part", F.lit(1).alias("spoke"), "node", "text")
    hubs = parts.join(texts, parts["b"] == texts["node"]).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("spoke"), "node", "text")
    rows = hubs.union(spokes).repartition("b", "part").sortWithinPartitions("b", "part", "spoke")

    def run(batches):
        now_doing(__name__)
        centre, hub = None, np.zeros(0, np.uint64)
        for batch in pieces_of(batches, 1 << 20):
            sets = shingle_sets(texts_of(batch.column(4)), width)
            out: list[tuple[int, int]] = []
            for b, spoke, node, own in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), sets, strict=True):
                # keys of rows are hashes: only texts of the two nodes count
                if not len(own) or set_hash(own) != node:
                    continue
                if not spoke:
                    centre, hub = b, own
                elif b == centre:
                    both = overlap(own, hub)
                    if 100 * both >= percent * (len(own) + len(hub) - both):
                        out.append((node, b))
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    bounded_batches(pairs.sparkSession)
    return rows.mapInArrow(run, "a long, b long")


def crowd_links(sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the pairs of ``left`` and ``right`` with different labels that reach ``percent``, one for each two labels."""
    values = np.concatenate([sets[i] for i in (*left, *right)])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(sets[i]) for i in (*left, *right)])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [at, at + width])
        has = np.zeros((len(left) + len(right), width), np.float32)
        has[owner[low:high], column[low:high] - at] = 1
        both += has[: len(left)] @ has[len(left) :].T
    sizes = np.array([len(x) for x in sets])
    linked = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
    linked &= labels[left][:, None] != labels[right][None, :]
    i, j = np.nonzero(linked)
    a, b = left[i], right[j]
    first = np.unique(np.stack([np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])], axis=1), axis=0, return_index=True)[1] if len(a) else ()
    return [(int(a[k]), int(b[k])) for k in first]


def _blocked(members: DataFrame, block: int) -> DataFrame:
    """``members`` (key, node, ...) by pair of blocks of their bucket (bi, bj) and their own block, in order.

    A bucket's members are cut into blocks of about ``block``; two blocks meet in one task.
    """
    sizes = written(members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
    rows = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("blocks", "other")
    return rows


def _sides(group: pa.Table, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    block = np.asarray(group.column("block"))
    return tuple(np.flatnonzero(fits & (block == group.column(c)[0].as_py())) for c in ("bi", "bj"))


def sketched(members: DataFrame, percent: int) -> DataFrame:
    """Of ``members`` (key, node, label, n, sketch) the (key, node) that sizes and sketches leave a partner with another label."""
    rows = _blocked(members, SKETCH_BLOCK).select("key", "bi", "bj", "block", "node", "label", "n", *[F.col("sketch")[i].alias(f"w{i}") for i in range(SKETCH_WORDS)])
    rows = rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    bounded_batches(members.sparkSession)

    def run(batches):
        now_doing(__name__)
        for group in runs_of(batches, 3):
            label, n = np.asarray(group.column("label")), np.asarray(group.column("n"))
            words = np.stack([np.asarray(group.column(f"w{i}")) for i in range(SKETCH_WORDS)], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
            left, right = _sides(group, np.ones(len(n), bool))
            may = (64 * SKETCH_WORDS + bits[left] @ bits[right].T) / 2 >= least_agreement(percent)
            may &= label[left][:, None] != label[right][None, :]
            may &= 100 * np.minimum(n[left][:, None], n[right][None, :]) >= percent * np.maximum(n[left][:, None], n[right][None, :])
            kept = np.unique(np.concatenate([left[may.any(axis=1)], right[may.any(axis=0)]]))
            if len(kept):
                yield pa.record_batch([group.column("key").combine_chunks().take(pa.array(kept)), group.column("node").combine_chunks().take(pa.array(kept))], ["key", "node"])

    return rows.mapInArrow(run, "key long, node long")


def confirm_crowds(members: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links across the components within crowded buckets; ``members``: key, node, label, n, sketch.

    Sizes and sketches decide which members have a partner at all; their full sets are compared by pairs of blocks, and
    what is emitted is one link for each two components there, not pairs.
    """
    kept = members.join(written(sketched(members, percent).distinct(), "sketched"), ["key", "node"], "left_semi")
    members = written(kept.select("key", "node", "label"), "crowds")
    texts = texts_by_node(members.select("node"), nodes, texts)
    rows = _blocked(members, CROWD_BLOCK).join(texts, "node").select("key", "bi", "bj", "block", "node", "label", "text")
    rows = rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "node")
    bounded_batches(members.sparkSession)

    def run(batches):
        now_doing(__name__)
        for group in runs_of(batches, 3):
            sets = shingle_sets(texts_of(group.column("text")), width)
            node, label = (np.asarray(group.column(c)) for c in ("node", "label"))
            # keys of rows are hashes: only texts of the nodes count
            mine = np.array([len(x) > 0 and set_hash(x) == n for x, n in zip(sets, node.tolist(), strict=True)])
            left, right = _sides(group, mine)
            pairs = crowd_links(sets, label, left, right, percent) if len(left) and len(right) else []
            if pairs:
                yield pa.record_batch([pa.array([int(node[a]) for a, _ in pairs]), pa.array([int(node[b]) for _, b in pairs])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _joined_buckets(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, node, label, n, sketch) of crowded buckets, where buckets become one that hold nearly the same nodes.

    Copies of one text meet in many buckets, whose centres are in one component.  The buckets of such a component are
    taken together where that makes fewer pairs than they have one by one; all pairs of a bucket stay together.
    """
    of_centre = labels.select(F.col("node").alias("b"), F.col("label").alias("centre"))
    rows = crowded.join(of_centre, "b", "left").withColumn("centre", F.coalesce("centre", "b"))
    alone = rows.groupBy("centre").agg(F.sum(F.col("size").cast("double")).alias("pairs"))  # each member meets its bucket
    union = rows.select("centre", "node").distinct().groupBy("centre").agg(F.count("*").cast("double").alias("nodes"))
    joins = written(alone.join(union, "centre").select("centre", (F.col("nodes") * F.col("nodes") < F.col("pairs")).alias("join")), "joins")
    rows = rows.join(joins, "centre").withColumn("key", F.when(F.col("join"), F.xxhash64("centre")).otherwise(F.col("key")))
    return written(rows.groupBy("key", "node").agg(*[F.first(c).alias(c) for c in ("label", "n", "sketch")]), "crowded")


def least_agreement(percent: int) -> int:
    """Sketch bits that a pair at ``percent`` shares but for a chance below 1e-9."""
    share, bits = (1 + percent / 100) / 2, 64 * SKETCH_WORDS
    return int(bits * share - SKETCH_SLACK * (bits * share * (1 - share)) ** 0.5)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    out = linked(docs, width, percent).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, row (its key), n_shingles, component_id, first_row (the one row of its group that stays)."""
    texts = documents(docs).select(row_key().alias("row"), "text")
    signed = written(signatures(docs, width), "signatures")
    # of a node's rows that of the smallest doc_id stands for it, one without an id only if none has one
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), "row")
    grouped = signed.where("node is not null").groupBy("node").agg(F.min(order).alias("of"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = written(grouped.select("node", "of.none", "of.doc", "of.row", "n", "bands", "sketch"), "sets")
    rows = written(signed.select("doc_id", "row", "n_shingles", "node"), "rows")
    spent(signed)
    # each node of a bucket with the one that meets the most others in its buckets: of copies with changes that is the
    # text they were made from, or one much like it
    bands = nodes.select(F.explode("bands").alias("key"), "node")
    buckets = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size"))
    buckets = written(buckets.where("high != low").select("key", "size"), "buckets")
    met = written(bands.join(buckets, "key"), "met")
    spent(buckets)
    meets = met.groupBy("node").agg(F.sum("size").alias("meets"))
    centres = met.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node")).alias("centre"))
    members = written(met.select("key", "node").join(centres.select("key", F.col("centre.node").alias("b")), "key"), "members")
    spent(met)
    n_of = lambda c, n: nodes.select(F.col("node").alias(c), F.col("n").alias(n))
    stars = members.where("node != b").select(F.col("node").alias("a"), "b").distinct()
    stars = written(stars.join(n_of("a", "n_a"), "a").join(n_of("b", "n_b"), "b").where(_sizes_fit("n_a", "n_b", percent)).select("a", "b"), "stars")
    links = written(confirm(stars, nodes, texts, width, percent), "confirmed")
    labels = components(links)
    # what of the buckets is still apart
    labelled = members.join(labels, "node", "left").select("key", "node", "b", F.coalesce("label", "node").alias("label"))
    labelled = written(labelled, "labelled")
    spent(members)
    apart = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low != high and size > 2").select("key", "size")
    open_ = labelled.join(written(apart, "apart"), "key").join(nodes.select("node", "n", "sketch"), "node")
    open_ = written(open_.select("key", "size", "node", "label", "n", "sketch", "b"), "open")
    spent(labelled)
    left, right = (open_.where(F.col("size") <= CROWD).select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "label", "n", "sketch")]) for s in "ab")
    differ = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    across = left.join(right, (left["key"] == right["key"]) & (F.col("label_a") < F.col("label_b")) & _sizes_fit("n_a", "n_b", percent) & (64 * SKETCH_WORDS - differ >= least_agreement(percent)))
    across = across.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    tested = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = written(across.join(tested, ["a", "b"], "left_anti"), "across")
    crowded = _joined_buckets(open_.where(F.col("size") > CROWD), labels)
    more = [] if across.isEmpty() else [confirm(across, nodes, texts, width, percent)]
    more += [] if crowded.isEmpty() else [confirm_crowds(crowded, nodes, texts, width, percent)]
    for found in more:
        links = links.union(written(found, "confirmed"))
    if more:
        labels = components(links)
    firsts = written(nodes.select("node", F.struct("none", "doc", "row").alias("first")), "firsts")
    spent(nodes, open_, stars, across)
    smallest = written(labels.join(firsts, "node").groupBy("label").agg(F.min("first").alias("smallest")), "smallest")
    of_group = labels.join(smallest, "label").select("node", "smallest")
    of_node = firsts.join(of_group, "node", "left").select("node", F.coalesce("smallest", "first").alias("first"))
    out = rows.join(written(of_node, "components"), "node", "left")
    return out.select("doc_id", "row", "n_shingles", F.coalesce("first.doc", "doc_id").alias("component_id"), F.coalesce("first.row", "row").alias("first_row"))


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))
