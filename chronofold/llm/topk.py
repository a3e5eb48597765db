"""Exact top-k inner products by dual-tree search over cover trees.

The upper level of both trees is a set of cells around pivots that a bounded
sample of the vectors gives; every vector, query or not, belongs to the cell of
its nearest pivot, and a cell's covering radius is measured over all its rows.
Below, each task builds a cover tree over a block of queries of one cell and
one over a block of data of another: the points of a node's child lie within
half the node's radius of the child's centre, and centres are further apart
than that; a node that would need more than FANOUT children stays a leaf.
Node pairs are visited best first.  A pair (Q, D), cells or nodes, is pruned when

    <q, d> + |q| r_D + |d| r_Q + r_Q r_D < worst kth score of Q's queries,

q, d being the centres and r the covering radii.  Every query first meets one
block near it, so its kth score bounds all further work: cell pairs are pruned
before any vector moves, blocks before trees are built, nodes inside.  Equal scores are
never pruned, so ties go to the smaller id.

Vectors are integers; where all products and sums stay below 2^53, double
precision is exact.  Larger ones are compared by Python's integers at the leaves
and by scaled doubles in the bounds.  The best of all blocks are merged by a
window per query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm.common import save, small_batches

#: Rows of a block: a task holds one of each kind (17 MB each of 64 components).
DATA_BLOCK, QUERY_BLOCK = 32_768, 32_768
LEAF, FANOUT = 128, 64
#: Scores that a task holds at once.
TILE = 1 << 21
#: Rows that pivots are picked from, by the order of a hash of their ids, and pivots at most.
SAMPLE, PIVOTS = 4096, 256
#: Ids are any long, so absence is told by a mask and never by an id.
LONG_LIMIT = 2**63 - 1


class CoverTree:
    """Nodes over vectors (as doubles): centre, covering radius, and children or points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(points):
            self._build(np.arange(len(points)), 0)

    def _build(self, rows: np.ndarray, centre: int) -> int:
        own = len(self.centre)
        first = self.points[rows[centre]]
        distance = np.sqrt(((self.points[rows] - first) ** 2).sum(axis=1))
        radius = float(distance.max())
        self.centre.append(first)
        self.radius.append(radius * (1 + 1e-9))
        self.children.append([])
        self.members.append(rows)
        if len(rows) > self.leaf and radius > 0:
            owner, picked = spread(self.points[rows], centre, FANOUT, radius / 2)
            if owner is not None:
                for k, place in enumerate(picked):
                    mine = np.flatnonzero(owner == k)
                    self.children[own].append(self._build(rows[mine], int(np.searchsorted(mine, place))))
        return own


def spread(points: np.ndarray, first: int, most: int, within: float) -> tuple[np.ndarray | None, list[int]]:
    """Centres picked farthest-first until all points are within a distance of one.

    Each point's centre by number (None if more than `most` are needed), and the
    centres' places; `first` is the first of them.
    """
    nearest = np.full(len(points), np.inf)
    owner = np.zeros(len(points), np.int64)
    picked = [first]
    while True:
        there = np.sqrt(((points - points[picked[-1]]) ** 2).sum(axis=1))
        closer = there < nearest
        owner[closer], nearest[closer] = len(picked) - 1, there[closer]
        far = int(nearest.argmax())
        if nearest[far] <= within:
            return owner, picked
        if len(picked) == most:
            return None, picked
        picked.append(far)


def _first_best(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row, of equal ones the first (all columns if there are no more)."""
    width = score.shape[1]
    if width <= k:
        return np.broadcast_to(np.arange(width), score.shape)
    if score.dtype == object:
        return np.array([sorted(range(width), key=lambda i, x=x: (-x[i], i))[:k] for x in score])
    edge = np.partition(score, width - k, axis=1)[:, width - k, None]
    above, level = score > edge, score == edge
    kept = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1)[:, None]))
    return np.nonzero(kept)[1].reshape(len(score), k)


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, scores and presence (queries x k) of the best data rows, of which there may be fewer.

    A query is not compared with rows of its own id.  Ties go to the smaller id.
    Of each query only rows that score at least `least` are asked for.  Arrays of
    doubles must hold integers whose products are exact; others are object arrays
    of Python integers.
    """
    exact = queries.dtype == object or data.dtype == object
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    nothing = -np.inf
    best = np.full((len(queries), k), nothing, object if exact else np.float64)
    names = np.full((len(queries), k), LONG_LIMIT)
    there = np.zeros((len(queries), k), bool)
    if not len(queries) or not len(data):
        return names, best, there
    # the bounds of huge vectors are those of the vectors scaled down
    scale = 1
    if exact:
        top = max(max((abs(x) for row in m for x in row), default=0) for m in (queries, data))
        scale = 1 << max(0, int(top).bit_length() - 48)
    floats = lambda m: np.array([[x / scale for x in row] for row in m], float).reshape(m.shape) if exact else m
    floor = np.full(len(queries), nothing) if least is None else np.array([nothing if x is None else x / scale / scale for x in least], float)
    worst = floor.copy()
    left, right = CoverTree(floats(queries), 64), CoverTree(floats(data))
    norm_l = [float(np.linalg.norm(c)) for c in left.centre]
    norm_r = [float(np.linalg.norm(c)) for c in right.centre]

    def bound(q: int, d: int) -> float:
        reach = norm_l[q] * right.radius[d] + norm_r[d] * left.radius[q] + left.radius[q] * right.radius[d]
        return float(left.centre[q] @ right.centre[d]) + reach + 1e-9 * (1 + norm_l[q] * norm_r[d] + reach)

    def _compare(rows: np.ndarray, members: np.ndarray) -> None:
        score = queries[rows] @ data[members].T
        score[query_ids[rows][:, None] == ids[members][None, :]] = nothing
        some = ((score >= best[rows, -1:]) & (score > nothing)).any(axis=1)
        if not some.any():
            return
        rows, score = rows[some], score[some]
        # members ascend by id, so of equal scores the first are taken
        column = _first_best(score, k)
        own = np.take_along_axis(score, column, 1)
        scores = np.concatenate((best[rows], own), axis=1)
        who = np.concatenate((names[rows], ids[members][column]), axis=1)
        held = np.concatenate((there[rows], own > nothing), axis=1)
        if exact:
            chosen = np.array([sorted(range(len(x)), key=lambda i, x=x, n=n: (-x[i], n[i]))[:k] for x, n in zip(scores, who, strict=True)])
        else:
            chosen = np.lexsort((who, -scores), axis=1)[:, :k]
        best[rows], names[rows], there[rows] = (np.take_along_axis(x, chosen, 1) for x in (scores, who, held))
        kth = np.array([x / scale / scale if x > nothing else nothing for x in best[rows, -1]], float) if exact else best[rows, -1]
        worst[rows] = np.maximum(floor[rows], kth)

    heap, count = [(-bound(0, 0), 0, 0, 0)], 0
    while heap:
        upper, _, q, d = heapq.heappop(heap)
        rows = left.members[q]
        if -upper < worst[rows].min():
            continue
        down, across = right.children[d], left.children[q]
        if down and (not across or right.radius[d] >= left.radius[q]):
            pairs = [(q, x) for x in down]
        elif across:
            pairs = [(x, d) for x in across]
        else:
            members = right.members[d]
            wide = max(1, TILE // max(1, min(len(rows), 256)))
            for r in range(0, len(rows), 256):
                for m in range(0, len(members), wide):
                    _compare(rows[r : r + 256], members[m : m + wide])
            continue
        for a, b in pairs:
            upper = bound(a, b)
            if upper >= worst[left.members[a]].min():
                count += 1
                heapq.heappush(heap, (-upper, count, a, b))
    return names, best, there


def quantized(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """id and v: floor(scale * x) of each component as double.

    Rows with a null id or vector, a null or non-finite component, or one that is
    no longer finite when scaled, are left out.
    """
    v = F.col(vector_column)
    scaled = F.transform(v, lambda x: F.lit(float(scale)) * x.cast("double"))
    fine = v.isNotNull() & ~F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # doubles from 2^52 on are whole; floor() gives a long, which they may pass
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    return vectors.where(F.col(id_column).isNotNull() & fine).select(F.col(id_column).cast("long").alias("id"), F.transform(scaled, whole).alias("v"))


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by vector length, one per block up to PIVOTS, from the SAMPLE rows whose ids' hashes come first (a bounded table)."""
    most = max(1, min(PIVOTS, rows.count() // DATA_BLOCK))
    sample = rows.where(F.size("v") > 0).orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").collect()
    by_size: dict[int, list] = {}
    for (v,) in sample:
        by_size.setdefault(len(v), []).append(v)
    out = {}
    for size, own in by_size.items():
        points = np.unique(np.array(own), axis=0)
        points = points / max(1.0, float(np.abs(points).max()) / 2**48)
        picked, nearest, far = [], np.full(len(points), np.inf), 0
        while len(picked) < most and nearest[far] > 0:
            picked.append(far)
            nearest = np.minimum(nearest, np.sqrt(((points - points[far]) ** 2).sum(axis=1)))
            far = int(nearest.argmax())
        out[size] = points[picked]
    return out


def top_k(queries: DataFrame, data: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of data (id, v) for each id of queries (id, v).

    Rows of the query's own id are no candidates, nor are vectors of another
    length.  Repeated data rows count as often as they come; a query id that comes
    more than once is asked once, with its least vector.  Ids may be any long.  A
    score beyond a long is ranked exactly and written as the nearest long.  Either
    table empty gives no rows.  Hot cells (equal vectors, say) are cut into
    blocks by a hash of the row's number.
    """
    spark = data.sparkSession
    small_batches(spark)
    asked = queries.groupBy("id").agg(F.min("v").alias("v"))
    found, pivots, exact = _placed(data, asked)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    left, right = found
    # at most PIVOTS rows a vector length reach the driver here and below
    cells = right.groupBy("size", "cell").agg(F.max("blocks").alias("blocks"), F.count(F.lit(1)).alias("rows"), F.max("distance").alias("radius")).collect()
    asking = left.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("rows"), F.max("distance").alias("radius")).collect()

    # every query meets the first block of its own cell, or of the cell that promises most
    home = []
    for q in asking:
        fitting = [d for d in cells if d.size == q.size and d.rows // d.blocks > 2 * k]
        if fitting:
            home.append((q, max(fitting, key=lambda d: (d.cell == q.cell, float(pivots[q.size][q.cell] @ pivots[q.size][d.cell])))))
    seed = _searched(left.withColumn("least", F.lit(None).cast("binary")), right.where("block = 0").withColumn("blocks", F.lit(1)), [(q, d, 1) for q, d in home], k, exact)
    kth = seed.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "least")
    left = save(left.join(kth, "id", "left"), "queries")

    # pairs of cells that may hold better ones
    worst = {(r.size, r.cell): r.least for r in left.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n"), F.count("least").alias("known"), F.min("least").alias("least")).where("n = known").collect()}
    pairs = []
    for q in asking:
        least = worst.get((q.size, q.cell))
        for d in cells:
            if d.size != q.size:
                continue
            a, b = pivots[q.size][q.cell], pivots[q.size][d.cell]
            reach = float(np.linalg.norm(a)) * d.radius + float(np.linalg.norm(b)) * q.radius + q.radius * d.radius
            upper = float(a @ b) + reach
            # pivots of huge vectors are scaled, so all their pairs stay
            if exact or least is None or upper + 1e-6 * (1 + abs(upper) + reach) >= _score(least):
                pairs.append((q, d, d.blocks))
    best = _searched(left, right, pairs, k, exact)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("key"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: Scores as bytes whose order is that of the numbers: 2^2100 is beyond any product of two doubles.
_WIDTH, _SHIFT = 264, 1 << 2100


def _key(score: int, exact: bool) -> bytes:
    return int(score + (_SHIFT if exact else 1 << 62)).to_bytes(_WIDTH if exact else 8, "big")


def _score(key: bytes) -> int:
    return int.from_bytes(key, "big") - (_SHIFT if len(key) == _WIDTH else 1 << 62)


def _placed(data: DataFrame, asked: DataFrame):
    """Both tables with size, cell, distance from its pivot, blocks of the cell and the row's block; saved."""
    data = save(data, "vectors")
    pivots = _pivots(data)
    if not pivots:
        return None, {}, False

    def place(batches):
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            cells, far = np.zeros(len(ids), np.int32), np.zeros(len(ids))
            at, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(at)
            for size in np.unique(sizes):
                own = pivots.get(int(size))
                here = np.flatnonzero(sizes == size)
                if own is None:
                    continue
                points = flat[at[here][:, None] + np.arange(size)]
                with np.errstate(over="ignore", invalid="ignore"):  # any cell is right for a huge vector
                    squares = (points**2).sum(axis=1)[:, None] - 2 * points @ own.T + (own**2).sum(axis=1)
                    cells[here] = squares.argmin(axis=1)
                    far[here] = np.sqrt(((points - own[cells[here]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([ids, vectors, pa.array(sizes.astype(np.int32)), pa.array(cells), pa.array(far)], names=["id", "v", "size", "cell", "distance"])

    def placed(rows: DataFrame) -> DataFrame:
        return rows.where(F.size("v") > 0).mapInArrow(place, "id long, v array<double>, size int, cell int, distance double")

    right = save(placed(data), "data")
    shape = right.agg(F.max("size"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    exact = shape[1] is not None and not shape[1] * shape[1] * shape[0] < 2.0**52
    lacking = [r[0] for r in right.select("size").distinct().where(~F.col("size").isin([int(s) for s in pivots])).collect()]
    for size in lacking:  # too rare for the sample: one cell around the origin
        pivots[size] = np.zeros((1, size))
    if lacking:
        right = right.withColumn("distance", F.when(F.col("size").isin(lacking), F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))).otherwise(F.col("distance")))
    counts = right.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / DATA_BLOCK).cast("int").alias("blocks"))
    right = right.join(F.broadcast(counts), ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("blocks")).cast("int"))
    left = placed(asked).where(F.col("size").isin([int(s) for s in pivots]))
    left = left.withColumn("distance", F.when(F.col("size").isin(lacking), F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))).otherwise(F.col("distance")))
    return (save(left, "asked"), save(right, "blocks")), pivots, exact


def _searched(left: DataFrame, right: DataFrame, pairs: list[tuple], k: int, exact: bool) -> DataFrame:
    """query_id, vec_id, score and key of the best rows in each block that a query is sent to.

    pairs: (cell of queries, cell of data, its blocks).  A block is one task, or as
    many as its queries need at QUERY_BLOCK each, and moves once for each.
    """
    spark = left.sparkSession
    load: dict[tuple, int] = {}
    for q, d, _ in pairs:
        load[(d.size, d.cell)] = load.get((d.size, d.cell), 0) + q.rows
    parts = {cell: -(-rows // QUERY_BLOCK) for cell, rows in load.items()}
    routes = spark.createDataFrame([(q.size, q.cell, d.cell, blocks, parts[(d.size, d.cell)]) for q, d, blocks in pairs], "size int, cell int, `to` int, blocks int, parts int")
    asked = left.select("size", "cell", "id", "v", "least").join(F.broadcast(routes), ["size", "cell"])
    asked = asked.select("size", F.col("to").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("part"), "id", "v", "least")
    copies = spark.createDataFrame([(*cell, n) for cell, n in parts.items()], "size int, cell int, parts int")
    there = right.join(F.broadcast(copies), ["size", "cell"]).select("size", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v")
    keys = ["size", "cell", "block", "part"]

    def block(one: pa.Table, two: pa.Table) -> pa.Table:
        (a, x), (b, y) = _matrix(one, exact), _matrix(two, exact)
        floors = [None if key is None else _score(key) for key in one.column("least").to_pylist()]
        names, scores, found = search(a, x, b, y, k, floors)
        who = np.repeat(a, found.sum(axis=1))
        made = [int(s) for s in scores[found]]
        clipped = [max(-LONG_LIMIT - 1, min(LONG_LIMIT, s)) for s in made]
        return pa.table({"query_id": pa.array(who, pa.int64()), "vec_id": pa.array(names[found], pa.int64()), "score": pa.array(clipped, pa.int64()), "key": pa.array([_key(s, exact) for s in made], pa.binary())})

    small_batches(spark)
    return asked.groupBy(keys).cogroup(there.groupBy(keys)).applyInArrow(block, "query_id long, vec_id long, score long, key binary")


def _matrix(block: pa.Table, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    ids = block.column("id").to_numpy()
    values = block.column("v").combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if exact:
        flat = np.array([int(x) for x in flat], object)
    return ids, flat.reshape(len(ids), -1) if len(ids) else np.empty((0, 0))


def search_embeddings(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """top_k with the rows whose id is divisible by `every` as queries and all rows as data.

    Vectors that are null, or hold a null or non-finite component, take no part;
    other columns are not read.  See top_k for ties, repeated ids and empty tables.
    """
    rows = quantized(vectors)
    return top_k(rows.where(F.col("id") % every == 0), rows, k)
