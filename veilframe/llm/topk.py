"""Operator 9, exact top-k by inner product with a pair of cover trees.

The top of one cover tree, made on the driver from at most ``SAMPLE`` rows, gives shared pivots.  Every row belongs to
its nearest pivot; the rows of a pivot are the tree's nodes at that level, cut by a hash into blocks of about
``DATA_BLOCK`` rows, the queries among them into groups of about ``QUERY_BLOCK``.  A block or group has its pivot as
centre and the distance of its furthest row as covering radius.

No inner product between two nodes can be larger than ``c.d + r |d| + s |c| + r s`` (centres c and d, radii r and s).
Each group first searches one block of its own pivot, which gives each query a k-th score.  A block then goes to a
group only if their bound reaches the worst k-th score of the group.  Within a pair both sides get a cover tree, node
pairs are visited from the most promising on and pruned by the same bound; leaves are compared as one product of
matrices.  The best k of all pairs are ranked.

Scores are integers and exact: products of matrices are used where doubles hold every sum, whole numbers of any size
elsewhere.  A score outside the range of a long counts as that range's end.

Defined results: vectors that are null or empty or hold null or non-finite components take no part; vectors of
another dimension than the query's are no candidates; all rows with the query's id count as its own; of repeated query
rows the smallest vector is answered; with fewer than k candidates all are returned; a null id takes no part; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, now_doing, written

QUERY_BLOCK, DATA_BLOCK = 4096, 8192
#: Rows that the pivots are chosen from, and pivots at most.
SAMPLE, MOST_PIVOTS = 4096, 1024
LEAF, SHRINK, MOST_CHILDREN = 1024, 1.25, 32
EXACT = 2.0**53
LONG = (-(1 << 63), (1 << 63) - 1)


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    away = points - centre
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def net(points: np.ndarray, away: np.ndarray, centre: int, scale: float, most: int) -> list[tuple[np.ndarray, int, np.ndarray]] | None:
    """Cover of the points by balls of ``scale`` whose centres are further apart: (rows, centre, distances) of each;
    None if it takes more than ``most``."""
    parts, left, far, head = [], np.arange(len(points)), away, centre
    while len(left):
        if len(parts) == most:
            return None
        inside = far <= scale
        parts.append((left[inside], head, far[inside]))
        left = left[~inside]
        if len(left):
            head = int(left[0])
            far = distances(points[left], points[head])
    return parts


class CoverTree:
    """Points in an order in which each node has a contiguous run; nodes hold run, centre, radius and children.

    From level to level the scale shrinks until a level tells points apart; a node whose next level would have more
    than ``MOST_CHILDREN`` members, or that has few points, is a leaf.
    """

    def __init__(self, points: np.ndarray):
        self.order: list[np.ndarray] = []
        self.runs: list[tuple[int, int]] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[list[int]] = []
        self._points, self._filled = points, 0
        away = distances(points, points[0])
        self._node(np.arange(len(points)), 0, away, float(away.max(initial=0.0)))
        self.order_of = np.concatenate(self.order)
        self.points = points[self.order_of]
        self.norms = [float(np.sqrt(c @ c)) for c in self.centres]

    def _node(self, rows: np.ndarray, centre: int, away: np.ndarray, scale: float) -> int:
        me, begin = len(self.runs), self._filled
        self.runs.append((begin, begin))
        self.centres.append(self._points[centre])
        self.radii.append(float(away.max(initial=0.0)))
        self.children.append([])
        parts = None
        if len(rows) > LEAF and self.radii[me] > 0:
            scale, mine = min(scale, self.radii[me]), self._points[rows]
            head = int(np.flatnonzero(rows == centre)[0])
            while parts is None or len(parts) < 2:
                scale /= SHRINK
                parts = net(mine, away, head, scale, MOST_CHILDREN)
                if parts is None:
                    break
        if parts is None:
            self.order.append(rows)
            self._filled += len(rows)
        else:
            for part, head, far in parts:
                self.children[me].append(self._node(rows[part], int(rows[head]), far, scale))
        self.runs[me] = (begin, self._filled)
        return me


class Best:
    """The k best candidates of each query: higher scores first, of equal ones the smaller id."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.rows, self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def offer(self, low: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores (queries from ``low`` on, candidates); what is -inf is none."""
        floor = self.floor[low : low + len(score)]
        if score.shape[1] > self.k and (floor == -np.inf).any():
            floor = np.maximum(floor, np.partition(score, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        if not len(i):
            return
        rows = np.concatenate([self.rows, i + low])
        scores, ids = np.concatenate([self.scores, score[i, j]]), np.concatenate([self.ids, ids[j]])
        order = np.lexsort((ids, -scores, rows))
        rows = rows[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        keep = place < self.k
        self.rows, self.scores, self.ids = rows[keep], scores[order][keep], ids[order][keep]
        full = place[keep] == self.k - 1
        at = self.rows[full]
        self.floor[at] = np.maximum(self.floor[at], self.scores[full])


def bound(inner: float, norm_a: float, radius_a: float, norm_b: float, radius_b: float) -> float:
    return inner + radius_a * norm_b + radius_b * norm_a + radius_a * radius_b


def search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best candidates of each query that aren't below its floor."""
    if np.abs(queries).max() * np.abs(data).max() * queries.shape[1] >= EXACT:
        return search_wide(queries, query_ids, floor, data, data_ids, k)
    qt, dt = CoverTree(queries), CoverTree(data)
    ids, own = data_ids[dt.order_of], query_ids[qt.order_of]
    best = Best(floor[qt.order_of], k)
    limit = lambda a, b: bound(float(qt.centres[a] @ dt.centres[b]), qt.norms[a], qt.radii[a], dt.norms[b], dt.radii[b])
    slack = 1e-6 * (1.0 + max(qt.norms[0] + qt.radii[0], 1.0) * max(dt.norms[0] + dt.radii[0], 1.0))
    stack = [(0, 0, limit(0, 0))]
    while stack:
        a, b, most = stack.pop()
        low, high = qt.runs[a]
        if most + slack < best.floor[low:high].min():
            continue
        if not qt.children[a] and not dt.children[b]:
            begin, end = dt.runs[b]
            score = qt.points[low:high] @ dt.points[begin:end].T
            score[own[low:high][:, None] == ids[begin:end][None, :]] = -np.inf
            best.offer(low, score, ids[begin:end])
            continue
        # open the wider of the two
        if qt.children[a] and (not dt.children[b] or qt.radii[a] >= dt.radii[b]):
            pairs = [(c, b) for c in qt.children[a]]
        else:
            pairs = [(a, c) for c in dt.children[b]]
        stack += sorted(((x, y, limit(x, y)) for x, y in pairs), key=lambda p: p[2])
    return qt.order_of[best.rows], best.ids, best.scores.astype(np.int64)


def search_wide(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``search`` where doubles don't hold the sums: they choose what is summed up in whole numbers."""
    norms = np.sqrt((data / max(1.0, np.abs(data).max())) ** 2 @ np.ones(data.shape[1])) * max(1.0, np.abs(data).max())
    whole = [[int(x) for x in v] for v in data.tolist()]
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for row, (query, own, least) in enumerate(zip(queries, query_ids.tolist(), floor.tolist(), strict=True)):
        mine = [int(x) for x in query.tolist()]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            near = data @ query
            off = np.sqrt(query @ query) * norms * (data.shape[1] * 2.0**-50) + 1.0
            low = near - off
            low[data_ids == own] = -np.inf
            known = np.isfinite(low)
            cut = max(least - abs(least) * 1e-12, np.partition(low[known], -k)[-k] if known.sum() > k else -np.inf)
            may = np.flatnonzero((~(near + off < cut) | ~known) & (data_ids != own))
        found = sorted((-min(max(sum(a * b for a, b in zip(mine, whole[j], strict=True)), LONG[0]), LONG[1]), int(data_ids[j])) for j in may.tolist())[:k]
        for score, i in found:
            for column, x in zip(out, (row, i, -score), strict=True):
                column.append(x)
    return tuple(np.array(x, np.int64) for x in out)


def choose_pivots(sample: list[tuple[int, list[float]]], most: int) -> dict[int, np.ndarray]:
    """By dimension, centres of the first level of a cover tree that has about as many members as wanted."""
    out = {}
    by: dict[int, list[list[float]]] = {}
    for dim, vector in sample:
        if max(map(abs, vector)) < 1e100:  # squares that doubles hold
            by.setdefault(dim, []).append(vector)
    for dim, vectors in by.items():
        points = np.unique(np.array(vectors), axis=0)
        points = points[np.random.default_rng(len(points)).permutation(len(points))]
        want = max(1, min(most * len(vectors) // len(sample), len(points)))
        away = distances(points, points[0])
        scale = float(away.max())
        chosen = [0]
        while len(chosen) < want:  # the points differ, so some level tells them apart
            scale /= SHRINK
            finer = net(points, away, 0, scale, want)
            if finer is None:  # the next level is too fine: as many of its members as are wanted
                far = away.copy()
                while len(chosen) < want and far.max() > scale:
                    chosen.append(int(far.argmax()))
                    far = np.minimum(far, distances(points, points[chosen[-1]]))
                break
            if len(finer) > len(chosen):
                chosen = [head for _, head, _ in finer]
        out[dim] = points[np.unique(chosen)]
    return out


def nearest(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector and its distance."""
    square = (pivots * pivots).sum(axis=1)
    pivot = (square[None, :] - 2 * vectors @ pivots.T).argmin(axis=1)
    away = vectors - pivots[pivot]
    return pivot, np.sqrt((away * away).sum(axis=1))


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(n, -1)


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` (vec_id, dim, vector) with their pivot and its distance; a dimension without pivots has the origin, -1."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, vectors = np.asarray(batch.column(1)), batch.column(2)
        pivot, away = np.full(len(dims), -1, np.int32), np.zeros(len(dims))
        np.seterr(over="ignore", invalid="ignore")  # what isn't a number prunes nothing
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            x = _vectors(vectors.take(pa.array(at)), len(at))
            if dim in pivots:
                pivot[at], away[at] = nearest(x, pivots[dim])
            else:
                away[at] = np.sqrt((x * x).sum(axis=1))
        return pa.record_batch([*batch.columns, pa.array(pivot), pa.array(away * (1 + 1e-9))], ["vec_id", "dim", "vector", "pivot", "away"])

    return map_batches(rows, each, "vec_id long, dim int, vector array<double>, pivot int, away double")


#: What a piece of work is named by: the group's pivot and part, the block's pivot and part.
PAIR = ("dim", "qp", "qn", "dp", "dn")


def _searched(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of each pair of (PAIR, vec_id, vector, least) and (PAIR, vec_id, vector)."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        now_doing(__name__)
        out: tuple = (np.zeros(0, np.int64),) * 3
        if left.num_rows and right.num_rows:
            floor = np.asarray(left.column("least").to_numpy(), np.float64)
            floor = np.where(np.isnan(floor), -np.inf, floor)
            qid, did = np.asarray(left.column("query_id")), np.asarray(right.column("vec_id"))
            rows, ids, scores = search(_vectors(left.column("query"), left.num_rows), qid, floor, _vectors(right.column("vector"), right.num_rows), did, k)
            out = (qid[rows], ids, scores)
        return pa.table([pa.array(x) for x in out], ["query_id", "vec_id", "score"])

    bounded_batches(queries.sparkSession)
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in PAIR], F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.col("least").alias("least"))
    return queries.groupBy(*[f"q_{c}" for c in PAIR]).cogroup(data.groupBy(*PAIR)).applyInArrow(work, "query_id long, vec_id long, score long")


def top_k(table: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k largest inner products of
    ``floor(scale * x)`` with all other rows, ties to the smaller id."""
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("raw"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("raw") > 0) & finite)
    # beyond 2 ** 53 every double is whole
    whole = lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale)
    rows = rows.select("vec_id", F.size("raw").alias("dim"), F.transform("raw", whole).alias("vector"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "vector").collect()
    n = rows.count()
    pivots = choose_pivots([(r["dim"], r["vector"]) for r in sample], max(1, min(MOST_PIVOTS, -(-n // data_block))))
    rows = written(_placed(rows, pivots), "vectors")
    asks = F.col("vec_id") % every == 0
    # at most a row for each sampled vector
    sizes = rows.where("pivot >= 0").groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.count_if(asks).alias("n_q"))
    rare = max(1, -(-10 * n // SAMPLE // data_block))  # blocks of a dimension that the sample of n rows missed
    sized = rows.join(F.broadcast(sizes), ["dim", "pivot"], "left")
    blocks = lambda c, block: F.coalesce(F.greatest(F.ceil(F.col(c) / block), F.lit(1)), F.lit(rare)).cast("int")
    cell = lambda salt, count: F.pmod(F.xxhash64("vec_id", F.lit(salt)), count).cast("int")
    data = sized.select("dim", F.col("pivot").alias("dp"), cell(2, blocks("n", data_block)).alias("dn"), blocks("n_q", query_block).alias("groups"), "vec_id", "vector", "away")
    asked = sized.where(asks).groupBy("vec_id").agg(F.min(F.struct("dim", "vector", "pivot", "n_q", "away")).alias("row")).select("vec_id", "row.*")
    queries = asked.select("dim", F.col("pivot").alias("qp"), cell(1, blocks("n_q", query_block)).alias("qn"), "vec_id", "vector", "away")
    # each group with one block of its own pivot
    near = data.where("dn = 0").withColumn("qn", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("qp", F.col("dp"))
    own = queries.withColumn("dp", F.col("qp")).withColumn("dn", F.lit(0)).withColumn("least", F.lit(None).cast("double"))
    first = written(_searched(own.select(*PAIR, "vec_id", "vector", "least"), near.select(*PAIR, "vec_id", "vector"), k), "first")
    kth = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("least"), F.count("*").alias("found")).where(F.col("found") >= k).select("vec_id", F.col("least").cast("double"))
    queries = written(queries.join(kth, "vec_id", "left"), "queries")
    # which blocks each group still has to see
    groups = queries.groupBy("dim", "qp", "qn").agg(F.max("away").alias("r"), F.min(F.coalesce("least", F.lit(float("-inf")))).alias("worst"))
    parts = data.groupBy("dim", "dp", "dn").agg(F.max("away").alias("s"))
    slices = max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = parts.withColumn("slice", F.pmod(F.xxhash64("dp", "dn"), F.lit(slices)).cast("int"))
    groups = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    pairs = groups.join(parts, ["dim", "slice"]).where("qp <> dp OR dn <> 0").select("dim", "qp", "qn", "dp", "dn", "r", "s", "worst")

    def promising(batch: pa.RecordBatch) -> pa.RecordBatch:
        dim, qp, _, dp, _, r, s, worst = (np.asarray(c) for c in batch.columns)
        keep = np.zeros(len(dim), bool)
        for d in np.unique(dim).tolist():
            at = np.flatnonzero(dim == d)
            centres = np.concatenate([pivots.get(d, np.zeros((0, d))), np.zeros((1, d))])  # -1 is the origin
            a, b = centres[qp[at]], centres[dp[at]]
            norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            most = (a * b).sum(axis=1) + r[at] * norm_b + s[at] * norm_a + r[at] * s[at]
            slack = 1e-6 * (1 + (norm_a + r[at]) * (norm_b + s[at]))
            keep[at] = ~(most + slack < worst[at])
        return batch.select(list(PAIR)).filter(pa.array(keep))

    pairs = written(map_batches(pairs, promising, "dim int, qp int, qn int, dp int, dn int"), "pairs")
    left = queries.join(pairs, ["dim", "qp", "qn"]).select(*PAIR, "vec_id", "vector", "least")
    right = data.join(pairs, ["dim", "dp", "dn"]).select(*PAIR, "vec_id", "vector")
    found = first.union(_searched(left, right, k))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
