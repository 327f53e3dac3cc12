"""Exact top-k inner products by best-first search in M-trees.

Vectors become whole numbers (``floor(scale * x)``). With one more component sqrt(M^2 - |x|^2), M the longest norm, all
candidates have one length, so d^2(q, x) = |q|^2 + M^2 - 2 q.x is a metric in which the largest inner products are the
nearest neighbours.

Index: a bounded sample gives routing objects; every vector goes to the region of its nearest one, and large regions (a vector
may be very common) are dealt over several trees, so a tree has at most about ``TREE`` vectors. A tree's nodes are pages of a
stored table: leaves of about ``PAGE`` entries with their distances to the leaf's routing object, and above them inner nodes of
about ``FAN`` children, level by level, up to the tree's root (the region's routing object). Every node has a routing object, a
covering radius around all vectors below it, and its routing object's distance to its parent's.

Search: queries, sorted by region, form blocks; a block meets only the trees of regions whose covering ball one of its queries may
reach. In a tree, a block's queries descend together, best first: a heap holds the open nodes by the least d(q, node) - radius, each with
the queries that have it open, and a query leaves a node where that exceeds its k-th best distance. Children are computed only if
|d(q, parent) - d(child, parent)| - radius leaves them open to a query, entries only if |d(q, leaf) - d(x, leaf)| does, so a closed subtree
costs no distance; a node's products with its queries are one matrix product. The k-th best starts from the bounded sample. Where
no bound closes anything (vectors without clusters in many dimensions), every query meets every vector: queries x vectors products.
Bounds have a rounding margin and scores are exact whole numbers, so results are exact; ties go to the smaller id. The best of
the trees are merged by a window over each query's few rows.

Rows whose id or vector is null, or whose vector holds a null or a component that is not finite, take no part; vectors of different
length count as padded with zeros. Rows with the same id are one vector (the least by its bytes).
Scores must fit in 64 bits, else an error is raised. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, stored

SCALE = 64
PAGE = 128
FAN = 8                   # children of an inner node
TREE = 4096
SAMPLE = 1024
QUERY_BLOCK = 64          # queries in a block
BLOCK_GROUP = 256         # blocks that meet a tree in one task
_EXACT = 1 << 53


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``id, dims, norm2, v`` (little-endian int64 components) of the vectors that take part."""
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(float)
                if not np.isfinite(v).all():
                    continue
                v = np.floor(scale * v)
                norm2 = float(v @ v)
                if norm2 >= 2.0 ** 62:
                    raise ValueError(f"vector {i}: scores would not fit in 64 bits")
                rows.append((i, len(v), norm2, v.astype("<i8").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["id", "dims", "norm2", "v"])

    return given.mapInArrow(run, "id long, dims long, norm2 double, v binary")


def _matrix(rows: list[bytes], dims: int) -> np.ndarray:
    m = np.zeros((len(rows), dims), np.int64)
    for k, r in enumerate(rows):
        v = np.frombuffer(r, "<i8")
        m[k, :len(v)] = v
    return m


class Space:
    """Distances in the space with one more component. ``top2``: the largest squared norm."""

    def __init__(self, dims: int, top2: float):
        self.dims, self.top2 = dims, top2
        self.margin = 1e-6 * (1 + np.sqrt(top2))
        self.kind = np.float64 if top2 < _EXACT else np.int64   # sums of products are exact in either

    def lift(self, m: np.ndarray) -> np.ndarray:
        m = m.astype(float)
        return np.hstack([m, np.sqrt(np.maximum(self.top2 - (m * m).sum(1), 0))[:, None]])

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.sqrt(np.maximum(d2, 0))

    def reach(self, q2, score):
        """The distance of a query of squared norm ``q2`` to a candidate with this score."""
        return np.sqrt(np.maximum(q2 + self.top2 - 2.0 * score, 0)) + self.margin


def _rings(points: np.ndarray, size: int) -> Iterator[tuple]:
    """Nodes of about ``size`` of the points: ``seed, members by distance, their distances``. A crowded seed has a node for each ring."""
    n = len(points)
    seeds = points[np.linspace(0, n - 1, -(-n // size)).astype(int)]
    near = np.concatenate([Space.distances(points[a:a + 2048], seeds).argmin(1) for a in range(0, n, 2048)])
    for s in np.unique(near):
        own = np.flatnonzero(near == s)
        d = Space.distances(points[own], seeds[s:s + 1])[:, 0]
        order = np.argsort(d, kind="stable")
        own, d = own[order], d[order]
        for a in range(0, len(own), 2 * size):
            yield seeds[s], own[a:a + 2 * size], d[a:a + 2 * size]


def _nodes(ids: np.ndarray, m: np.ndarray, space: Space, root: np.ndarray, page: int = PAGE, fan: int = FAN) -> list[tuple]:
    """The nodes of one tree: ``node, parent (-1: the root), route, radius, distance to the parent, entry distances, ids, vectors``;
    the last three are null in inner nodes."""
    leaves = list(_rings(space.lift(m), page))
    route, radius = [s for s, _, _ in leaves], [float(d[-1]) for _, _, d in leaves]
    parent, at = [-1] * len(leaves), [0.0] * len(leaves)
    level = range(len(leaves))
    while len(level) > fan:
        above = len(route)
        for seed, own, d in _rings(np.stack([route[k] for k in level]), fan):
            for k, e in zip(own, d):
                parent[level[k]], at[level[k]] = len(route), float(e)
            radius.append(max(float(e) + radius[level[k]] for k, e in zip(own, d)))
            route.append(seed)
            parent.append(-1)
            at.append(0.0)
        level = range(above, len(route))
    for k, d in zip(level, Space.distances(np.stack([route[k] for k in level]), root[None])[:, 0]):
        at[k] = float(d)
    out = []
    for k in range(len(route)):
        held = (None, None, None)
        if k < len(leaves):
            _, own, d = leaves[k]
            held = d.tobytes(), ids[own].tobytes(), m[own].astype("<i8").tobytes()
        out.append((k, parent[k], route[k].tobytes(), radius[k], at[k], *held))
    return out


class Tree:
    """The nodes of one tree, ready for searches. ``computed`` counts the distances and products of searches."""

    def __init__(self, root: np.ndarray, rows: list[tuple], space: Space):
        self.space, self.root = space, root
        rows = sorted(rows, key=lambda r: r[0])
        self.route = np.array([np.frombuffer(r[2]) for r in rows])
        self.route2 = (self.route * self.route).sum(1)
        self.radius, self.at = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        parent = np.array([r[1] for r in rows])
        self.children = {int(p): np.flatnonzero(parent == p) for p in np.unique(parent)}
        self.entry = [None if r[5] is None else np.frombuffer(r[5]) for r in rows]
        self.ids = [None if r[6] is None else np.frombuffer(r[6], np.int64) for r in rows]
        self.vectors = [None if r[7] is None else np.frombuffer(r[7], "<i8").reshape(-1, space.dims).astype(space.kind) for r in rows]
        self.computed = 0

    def _open(self, heap: list, node: int, rows: np.ndarray, d: np.ndarray, q: np.ndarray, q2: np.ndarray, reach: np.ndarray) -> None:
        """Puts the children of a node that some of its queries (``rows``, at distances ``d``) may reach on the heap: those that the
        stored distances and then their own leave open, each with its own queries."""
        below = self.children[node]
        near = np.abs(d[:, None] - self.at[below]) - self.radius[below] <= reach[rows, None]
        some, below = near.any(1), below[near.any(0)]
        rows = rows[some]
        if not len(below):
            return
        self.computed += len(rows) * len(below)
        far = np.sqrt(np.maximum(q2[rows, None] + self.route2[below] - 2 * (q[rows] @ self.route[below].T), 0))
        low = far - self.radius[below]
        is_open = low <= reach[rows, None]
        for k in np.flatnonzero(is_open.any(0)).tolist():
            own = np.flatnonzero(is_open[:, k])
            heapq.heappush(heap, (float(low[own, k].min()), int(below[k]), rows[own], low[own, k], far[own, k]))

    def search(self, ids: np.ndarray, m: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple]:
        """``query id, vec id, score`` of the best ``k`` of this tree that reach the queries' floors. The queries descend together:
        a node is visited once, by all queries that have it open then."""
        space, least_int = self.space, np.iinfo(np.int64).min
        q2 = (m.astype(float) ** 2).sum(1)
        lifted = np.hstack([m.astype(float), np.zeros((len(m), 1))])
        typed, least = m.astype(space.kind), floor.astype(np.int64)
        far_off = lambda rows: np.where(least[rows] > -_EXACT, space.reach(q2[rows], np.maximum(least[rows], -_EXACT)), np.inf)
        reach = far_off(slice(None))
        top = np.full((len(m), k), least_int)              # the best k scores up to now
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        heap: list[tuple] = []
        self._open(heap, -1, np.arange(len(m)), Space.distances(lifted, self.root[None])[:, 0], lifted, q2, reach)
        while heap:
            _, p, rows, low, d = heapq.heappop(heap)
            still = low <= reach[rows]
            rows, d = rows[still], d[still]
            if not len(rows):
                continue
            if self.entry[p] is None:
                self._open(heap, p, rows, d, lifted, q2, reach)
                continue
            a, b = np.searchsorted(self.entry[p], d - reach[rows]), np.searchsorted(self.entry[p], d + reach[rows], side="right")
            rows, a, b = rows[a < b], a[a < b], b[a < b]
            if not len(rows):
                continue
            a, b = int(a.min()), int(b.max())
            self.computed += len(rows) * (b - a)
            s, who = (typed[rows] @ self.vectors[p][a:b].T).astype(np.int64), self.ids[p][a:b]
            other = who[None] != ids[rows, None]
            hit = ((s >= least[rows, None]) & other).any(1)
            if not hit.any():
                continue
            rows, s, other = rows[hit], s[hit], other[hit]
            top[rows] = np.partition(np.hstack([top[rows], np.where(other, s, least_int)]), -k, 1)[:, -k:]
            least[rows] = np.maximum(least[rows], top[rows].min(1))
            reach[rows] = far_off(rows)
            i, j = np.nonzero((s >= least[rows, None]) & other)
            found.append((rows[i], who[j], s[i, j]))
        if not found:
            return iter(())
        rows, who, s = (np.concatenate(c) for c in zip(*found))
        keep = s >= least[rows]
        rows, who, s = rows[keep], who[keep], s[keep]
        order = np.lexsort((who, -s, rows))
        rows, who, s = rows[order], who[order], s[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return zip(ids[rows[best]].tolist(), who[best].tolist(), s[best].tolist())


def open_regions(m: np.ndarray, floor: np.ndarray, roots: np.ndarray, radius: np.ndarray, space: Space) -> np.ndarray:
    """The regions (root, covering radius; a negative one has no vectors) that may hold a result of one of a block's queries."""
    lifted = np.hstack([m.astype(float), np.zeros((len(m), 1))])
    reach = np.where(floor > -_EXACT, space.reach((m.astype(float) ** 2).sum(1), np.maximum(floor, -_EXACT)), np.inf)
    low = Space.distances(lifted, roots) - radius[None]
    return np.flatnonzero((low <= reach[:, None]).any(0) & (radius >= 0))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches sorted by their first column, by its value."""
    key, rows = None, []
    for b in batches:
        for k, *row in zip(*(c.to_pylist() for c in b.columns)):
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append(row)
    if rows:
        yield key, rows


def top_k(vectors: DataFrame, is_query: Callable, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, tree: int = TREE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows with ``is_query(id)``, against all rows but their own."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    v = stored(integers(vectors, id_col, vec_col, scale).groupBy("id")
               .agg(F.min(F.struct("v", "dims", "norm2")).alias("s")).select("id", "s.*"), "vectors")
    facts = v.agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("dims"), F.max("norm2").alias("top2")).collect()[0]
    if not facts.n:
        return spark.createDataFrame([], out)
    space = Space(max(facts.dims, 1), facts.top2)
    drawn = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sample_ids, sample = np.array([r.id for r in drawn]), _matrix([r.v for r in drawn], space.dims)
    roots = space.lift(sample[:int(np.clip(-(-facts.n // tree), 1, SAMPLE))])
    given = spark.sparkContext.broadcast((space, sample_ids, sample, roots))    # at most SAMPLE vectors
    parts = shuffle_parts(spark)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, _, _, roots = given.value
        for b in batches:
            if b.num_rows:
                d = Space.distances(space.lift(_matrix(b.column("v").to_pylist(), space.dims)), roots)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(d.argmin(1)), pa.array(d.min(1))],
                                                 ["id", "v", "region", "far"])

    placed = stored(v.mapInArrow(assign, "id long, v binary, region long, far double"), "placed")
    regions = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()    # at most SAMPLE rows
    sizes = {r.region: r.n for r in regions}
    radius = np.full(len(roots), -1.0)
    for r in regions:
        radius[r.region] = r.far
    trees, first = 0, {}
    for region in sorted(sizes):
        n = -(-sizes[region] // tree)
        first[region], trees = (trees, n), trees + n
    region_trees = spark.createDataFrame([(r, a, n) for r, (a, n) in first.items()], "region long, a long, n long")
    home = (placed.join(F.broadcast(region_trees), "region")
            .withColumn("tree", F.col("a") + F.pmod(F.xxhash64("id"), F.col("n"))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, _, _, roots = given.value
        for key, rows in _groups(batches):
            m = _matrix([r[1] for r in rows], space.dims)
            nodes = _nodes(np.array([r[0] for r in rows]), m, space, roots[rows[0][2]])
            cols = [[key] * len(nodes), [rows[0][2]] * len(nodes), *zip(*nodes)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names)

    names = ["tree", "region", "node", "parent", "route", "radius", "at", "entry", "ids", "vectors"]
    kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.float64()] * 2 + [pa.binary()] * 3
    shape = ("tree long, region long, node long, parent long, route binary, radius double, at double, entry binary, ids binary, "
             "vectors binary")
    pages = stored(home.repartition(max(1, min(trees, parts)), "tree").sortWithinPartitions("tree", "id")
                   .select("tree", "id", "v", "region").mapInArrow(build, shape), "pages")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries with the k-th best score against the sample, a floor of their results, and the regions they may reach."""
        space, ids, sample, roots = given.value
        for b in batches:
            for a in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(a, QUERY_BLOCK)
                own = part.column("id").to_numpy()
                m = _matrix(part.column("v").to_pylist(), space.dims)
                s = (m.astype(space.kind) @ sample.T.astype(space.kind)).astype(np.int64)
                s[own[:, None] == ids[None]] = np.iinfo(np.int64).min
                floor = np.partition(s, -k, 1)[:, -k] if s.shape[1] > k else np.full(len(s), np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([pa.array([int(own[0])]), pa.array([own.tobytes()]), pa.array([m.tobytes()]),
                                                  pa.array([floor.tobytes()]),
                                                  pa.array([open_regions(m, floor, roots, radius, space)], pa.list_(pa.int64()))],
                                                 ["name", "ids", "m", "floor", "regions"])

    queries = stored(placed.where(is_query(F.col("id"))).select("id", "v", "region").sortWithinPartitions("region", "id").select("id", "v")
                     .mapInArrow(blocks, "name long, ids binary, m binary, floor binary, regions array<long>"), "query_blocks")
    n_blocks = queries.count()
    groups = max(1, -(-n_blocks // BLOCK_GROUP))
    task = lambda g: F.xxhash64("tree", g)
    to_pages = (pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
                .select(task("g").alias("task"), F.lit(0).alias("kind"), *names))
    met_trees = (queries.withColumn("region", F.explode("regions")).join(F.broadcast(region_trees), "region")
                 .select("name", "ids", "m", "floor", F.explode(F.expr("sequence(a, a + n - 1)")).alias("tree"),
                         F.pmod(F.xxhash64("name"), F.lit(groups)).cast("int").alias("g")))
    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
    to_blocks = met_trees.select(task("g").alias("task"), F.lit(1).alias("kind"), "tree", zero.alias("region"), zero.alias("node"),
                                 zero.alias("parent"), F.col("floor").alias("route"), F.lit(0.0).alias("radius"), F.lit(0.0).alias("at"),
                                 none.alias("entry"), "ids", F.col("m").alias("vectors"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, _, _, roots = given.value
        key, rows, ready = None, [], None
        for b in batches:
            found: list[tuple] = []
            for t, kind, _, region, *row in zip(*(c.to_pylist() for c in b.columns)):
                if t != key:
                    key, rows, ready = t, [], None
                if kind == 0:
                    rows.append((region, tuple(row)))
                    continue
                if ready is None and rows:
                    ready = Tree(roots[rows[0][0]], [r for _, r in rows], space)
                if ready is not None:
                    ids = np.frombuffer(row[6], np.int64)
                    found += ready.search(ids, np.frombuffer(row[7], np.int64).reshape(len(ids), -1),
                                          np.frombuffer(row[2], np.int64), k)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "vec_id", "score"])

    met = (to_pages.unionByName(to_blocks).repartition(max(1, min(trees * groups, parts)), "task")
           .sortWithinPartitions("task", "kind"))
    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
