"""Exact top-k inner products by dual-tree search over cover trees.

The upper level of the trees is shared by all tasks: pivots from a bounded sample (SAMPLE_ROWS) that are far from each other.
Each vector belongs to the cell of its nearest pivot, each query to the group of its nearest group pivot; large cells are cut
into blocks, large groups into chunks. Covering radii are of all rows, so bounds hold whatever the sample.

1. Each group searches a block of the cells with the best bounds, which gives every query a k-th score to beat.
2. A pair of a group and a cell is dropped when its bound is below the worst k-th score of the group's queries. Only blocks of
   the pairs that are left are sent to the group, in stripes of STRIPE blocks, best bounds first; scores found in a block
   count at once for the blocks behind it, which may then be dropped unread.
3. In a task, queries and the block's points are indexed by cover trees: a node's children are balls of half its radius around points
   further apart than that; a node that would need more than FAN of them is a leaf. Pairs of nodes are descended together, in
   the order of their bounds: with centres p, c and covering radii s, r no query of one has a product above
   p.c + s|c| + r|p| + s r with a point of the other. A pair is dropped when that is below the worst k-th score of the query
   node's members, which is kept for inner nodes too.

Products are exact: in float64 while all partial sums stay below 2**53, else in Python's integers. The order is that of exact
scores; the column saturates at the ends of a long.

Edge cases: vectors that are null, or hold a null or a component that isn't finite, take no part, nor do rows with a null
id or an empty vector. Vectors of different lengths are compared only with those of their own length. Each row is a vector of its own:
of repeated ids, each row is a query and a candidate of the others. Components saturate at the ends of a long. Fewer than k
candidates give as many ranks. An empty table gives an empty result. Extra columns are ignored.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docquarry.session import ship, stash

LEAF, FAN = 64, 64
#: Rows in a block of a cell, queries in a chunk of a group, blocks in a stripe.
BLOCK_ROWS, QUERY_ROWS, STRIPE = 8192, 2048, 64
#: Rows from which pivots are picked, and pivots at most. The bounds don't depend on them.
SAMPLE_ROWS, PIVOTS = 4096, 1024
_NONE = -(1 << 200)
_HALF = 1 << 62


class CoverTree:
    """Nodes in arrays of equal index: centre row, covering radius, member rows, children, parent."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.x, self.leaf, self.fan = x, leaf, fan
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.rows: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.parent: list[int] = []
        if len(x):
            self._grow(np.arange(len(x)))

    def _node(self, centre: int, radius: float, rows: np.ndarray, parent: int) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.rows.append(rows)
        self.children.append([])
        self.parent.append(parent)
        return len(self.rows) - 1

    def _grow(self, rows: np.ndarray) -> None:
        todo = [self._node(int(rows[0]), float(self._distance(rows, rows[0]).max()), rows, -1)]
        while todo:
            at = todo.pop()
            rows, radius = self.rows[at], self.radius[at]
            if len(rows) <= self.leaf or radius == 0:
                continue
            left, kids = np.arange(len(rows)), []
            while len(left) and len(kids) < self.fan:
                centre = int(rows[left[0]])
                d = self._distance(rows[left], centre)
                inside = d <= radius / 2
                kids.append((centre, rows[left[inside]], float(d[inside].max())))
                left = left[~inside]
            if len(left) or len(kids) < 2:
                continue
            for centre, own, far in kids:
                child = self._node(centre, far, own, at)
                self.children[at].append(child)
                todo.append(child)

    def _distance(self, rows: np.ndarray, centre: int) -> np.ndarray:
        diff = self.x[rows] - self.x[centre]
        return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def slack(a, b):
    """More than what rounding can take from a product of vectors of norms a and b."""
    return 1e-9 * a * b + 1


class Search:
    """The k best points of each query so far; blocks of points come one after the other."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, k: int, floor: list[int] | None = None):
        """queries: integers; rows: their numbers; floor: scores that k points reach elsewhere."""
        self.raw, self.q, self.rows, self.k = queries, queries.astype(np.float64), rows, k
        self.tree = CoverTree(self.q)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.q, self.q))
        n = len(queries)
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]  # (-score, id, row), best first
        self.floor = floor if floor is not None else [_NONE] * n
        self.least = np.array([float(f) if f > _NONE else -np.inf for f in self.floor])  # k-th score to beat, as a float
        self.worst = np.array([self.least[r].min() for r in self.tree.rows])
        self.most = float(np.abs(self.q).max(initial=0))

    def add(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(points) or not len(self.q):
            return
        p = points.astype(np.float64)
        exact = p.shape[1] * self.most * float(np.abs(p).max()) < 2.0**53
        a, b = self.tree, CoverTree(p)
        norm = np.sqrt(np.einsum("ij,ij->i", p, p))
        centre, radius = np.array(b.centre), np.array(b.radius)

        def bound(i: int, j: np.ndarray) -> np.ndarray:
            x, s = a.centre[i], a.radius[i]
            c, r = centre[j], radius[j]
            return p[c] @ self.q[x] + s * norm[c] + r * self.norm[x] + s * r + slack(self.norm[x] + s, norm[c] + r)

        heap = [(-float(bound(0, np.array([0]))[0]), 0, 0)]
        while heap:
            top, i, j = heapq.heappop(heap)
            if -top < self.worst[i]:
                continue
            if not a.children[i] and not b.children[j]:
                self._leaf(i, points, p, ids, rows, b.rows[j], exact)
                continue
            # the wider node is opened; of the query side each child meets j, of the other i meets each child
            if a.children[i] and (not b.children[j] or a.radius[i] >= b.radius[j]):
                for x in a.children[i]:
                    y = float(bound(x, np.array([j]))[0])
                    if y >= self.worst[x]:
                        heapq.heappush(heap, (-y, x, j))
            else:
                for y, z in zip(bound(i, np.array(b.children[j])).tolist(), b.children[j], strict=True):
                    if y >= self.worst[i]:
                        heapq.heappush(heap, (-y, i, z))

    def _leaf(self, i: int, points, p, ids, rows, mine: np.ndarray, exact: bool) -> None:
        k = self.k
        for cut in range(0, len(self.tree.rows[i]), 256):
            own = self.tree.rows[i][cut : cut + 256]
            score = self.q[own] @ p[mine].T if exact else self.raw[own].astype(object) @ points[mine].astype(object).T
            near = score if exact else score.astype(np.float64) * 1.0
            near = np.where(self.rows[own][:, None] == rows[mine][None, :], -np.inf, near)
            least = self.least[own]
            if near.shape[1] > 2 * k:  # the leaf's own k-th score is one to beat too
                least = np.maximum(least, -np.partition(-near, k - 1, axis=1)[:, k - 1])
            if not exact:  # floats only choose what is looked at
                least = least - np.abs(least) * 1e-12
            hit = (near >= least[:, None]) & ~np.isneginf(near)
            for r in np.flatnonzero(hit.any(axis=1)).tolist():
                at = np.flatnonzero(hit[r])
                q = int(own[r])
                found = [(-int(s), x, y) for s, x, y in zip(score[r, at].tolist(), ids[mine[at]].tolist(), rows[mine[at]].tolist(), strict=True)]
                self.best[q] = sorted(self.best[q] + found)[:k]
                if len(self.best[q]) == k:
                    self.least[q] = max(self.least[q], float(-self.best[q][-1][0]))
        while i >= 0:
            kids = self.tree.children[i]
            self.worst[i] = self.worst[kids].min() if kids else self.least[self.tree.rows[i]].min()
            i = self.tree.parent[i]


def dual_top_k(queries: np.ndarray, query_rows: np.ndarray, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query (id, score) of its k best points of another row, best first, ties to smaller ids."""
    search = Search(queries, query_rows, k)
    search.add(points, ids, rows)
    return [[(i, -s) for s, i, _ in own] for own in search.best]


def _matrix(column) -> np.ndarray:
    """A list column of vectors of one length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    return values.reshape(len(lists), -1)


_FOUND = "row long, query_id long, vec_id long, found_row long, high long, low long"


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, search, block, held = [], None, None, []

        def flush():
            if held and held[0][0] >= search.worst[0]:  # the block's bound may be beaten by now
                search.add(*(np.concatenate([h[x] for h in held]) for x in (1, 2, 3)))
            held.clear()

        for batch in batches:
            block_of = batch["place"].to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(block_of)) + 1, [len(block_of)]])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                if block_of[a] < 0:  # the queries come first
                    head.append(part)
                    continue
                if search is None:
                    search, queries = _begin(head, k)
                if block_of[a] != block:
                    flush()
                    block = block_of[a]
                held.append((float(part["bound"][0].as_py()), _matrix(part["v"]), part["vec_id"].to_numpy(), part["row"].to_numpy()))
        if search is None:
            return
        flush()
        rows = [(int(queries[0][n]), int(queries[1][n]), i, r, -s // _HALF, -s % _HALF) for n, own in enumerate(search.best) for s, i, r in own]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "query_id", "vec_id", "found_row", "high", "low"])

    return run


def _begin(head: list, k: int):
    table = pa.Table.from_batches(head)
    rows = table["row"].to_numpy()
    floor = [_NONE if h is None else h * _HALF + x for h, x in zip(table["high"].to_pylist(), table["low"].to_pylist(), strict=True)]
    return Search(_matrix(table["v"]), rows, k, floor), (rows, table["vec_id"].to_numpy())


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of the sample, each the farthest from those before it; centres of the shared upper level."""
    out = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(out) < min(n, len(sample)) and away.max() > 0:
        out.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[out[-1]]) ** 2).sum(axis=1))
    return sample[out]


def _place(cells: dict, groups: dict):
    """Nearest cell and group pivot of each vector, and the distances to them."""
    def nearest(x, centres):
        if centres is None:
            return np.zeros(len(x), np.int32), np.full(len(x), np.inf)
        square = (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T
        at = square.argmin(axis=1)
        return at.astype(np.int32), np.sqrt(((x - centres[at]) ** 2).sum(axis=1))

    def run(batches):
        for batch in batches:
            dim = batch["dim"].to_numpy(zero_copy_only=False)
            out = [np.zeros(len(dim), np.int32), np.zeros(len(dim)), np.zeros(len(dim), np.int32), np.zeros(len(dim))]
            for d in np.unique(dim).tolist():
                own = np.flatnonzero(dim == d)
                x = _matrix(batch["v"].take(pa.array(own))).astype(np.float64)
                for k, centres in enumerate((cells, groups)):
                    out[2 * k][own], out[2 * k + 1][own] = nearest(x, centres.get(d))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=[*batch.schema.names, "cell", "away", "grp", "group_away"])

    return run


def _pairs(cells: dict, groups: dict, stats: dict, k: int, first: bool):
    """Blocks that a group (dim, grp, chunk, radius, worst) is to search, best bounds first.

    first: one block of as many cells as give a few times k points; else all other blocks of cells whose bound isn't below worst.
    """
    def bounds(dim: int, grp: int, radius: float, cell: np.ndarray, r: np.ndarray) -> np.ndarray:
        if dim not in cells:
            return np.full(len(cell), np.inf)
        p, c = groups[dim][grp], cells[dim][cell]
        norm_p, norm_c = np.sqrt((p**2).sum()), np.sqrt((c**2).sum(axis=1))
        return c @ p + radius * norm_c + r * norm_p + radius * r + slack(norm_p + radius, norm_c + r)

    def run(batches):
        for batch in batches:
            out = []
            for dim, grp, chunk, radius, worst in zip(*(batch[c].to_pylist() for c in ("dim", "grp", "chunk", "radius", "worst")), strict=True):
                cell, n, r, cuts = stats[dim]
                bound = bounds(dim, grp, radius, cell, r)
                order = np.argsort(-bound, kind="stable")
                before = np.cumsum(n[order] / cuts[order]) - n[order] / cuts[order]
                home = order[before < 4 * k]
                place = 0
                for x in (home if first else order).tolist():
                    if not first and worst is not None and bound[x] < worst:
                        break
                    for b in range(1) if first else range(int(x in home), int(cuts[x])):
                        out.append((dim, grp, chunk, int(cell[x]), b, float(bound[x]), place, place // STRIPE))
                        place += 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["dim", "grp", "chunk", "cell", "block", "bound", "place", "stripe"])

    return run


_PAIRS = "dim int, grp int, chunk int, cell int, block int, bound double, place long, stripe long"
_GROUP = ["dim", "grp", "chunk"]


def _run(queries: DataFrame, points: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """What the groups find in the blocks that pairs name. queries: with high and low of the score to beat, or nulls."""
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    asked = queries.join(pairs.select(*_GROUP, "stripe").distinct(), _GROUP).select(*_GROUP, "stripe", F.lit(-1).cast("long").alias("place"), "row", "vec_id", "v", none("bound", "double"), "high", "low")
    sent = points.join(pairs, ["dim", "cell", "block"]).select(*_GROUP, "stripe", "place", "row", "vec_id", "v", "bound", none("high", "long"), none("low", "long"))
    key = [*_GROUP, "stripe"]
    # in a group the queries come first, then blocks by place
    both = asked.unionByName(sent).repartition(*key).sortWithinPartitions(*key, "place")
    return both.groupBy(*key).applyInArrow(_search(k), _FOUND)


def top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other vectors for each vector for which is_query holds."""
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.where(F.size("v") > 0).select("vec_id", "v", F.size("v").alias("dim"), is_query.alias("is_query"))
    n, ids, nq = v.agg(F.count(F.lit(1)), F.count_distinct("vec_id"), F.count_if("is_query")).first()
    if n == ids:
        v = v.withColumn("row", F.col("vec_id"))
    else:
        v = stash(v.orderBy("vec_id", "v").withColumn("row", F.monotonically_increasing_id()), "vectors")
    some = v.select("dim", "v", F.xxhash64("row").alias("h"), "row").orderBy("h", "row").limit(SAMPLE_ROWS).collect()
    held: dict[int, list] = {}
    for r in some:
        held.setdefault(r["dim"], []).append(r["v"])
    clip = lambda m: min(PIVOTS, max(1, m))
    cells = {d: pivots(np.array(x, np.float64), clip(n // (BLOCK_ROWS // 2))) for d, x in held.items()}
    groups = {d: pivots(np.array(x, np.float64), clip(nq // (QUERY_ROWS // 2))) for d, x in held.items()}
    schema = "vec_id long, v array<long>, dim int, is_query boolean, row long, cell int, away double, grp int, group_away double"
    placed = stash(v.select("vec_id", "v", "dim", "is_query", "row").mapInArrow(_place(cells, groups), schema), "placed")
    # a row for each cell: PIVOTS of them for each length of vectors
    stats: dict[int, list] = {}
    for r in placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).toLocalIterator():
        stats.setdefault(r["dim"], []).append((r["cell"], r["n"], r["r"]))
    stats = {d: tuple(map(np.array, zip(*sorted(x), strict=True))) for d, x in stats.items()}
    stats = {d: (cell, m, r, -(-m // BLOCK_ROWS)) for d, (cell, m, r) in stats.items()}
    cuts = spark.createDataFrame([(int(d), int(c), int(b)) for d, (cell, _, _, cut) in stats.items() for c, b in zip(cell, cut, strict=True)], "dim int, cell int, cuts int")
    spread = lambda m, salt: F.pmod(F.xxhash64("row", F.lit(salt)), m).cast("int")
    points = placed.join(F.broadcast(cuts), ["dim", "cell"]).select("dim", "cell", spread(F.col("cuts"), 1).alias("block"), "row", "vec_id", "v")
    asked = placed.where("is_query")
    parts = asked.groupBy("dim", "grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("chunks"), F.max("group_away").alias("radius"))
    queries = asked.join(F.broadcast(parts), ["dim", "grp"]).select("dim", "grp", spread(F.col("chunks"), 2).alias("chunk"), "radius", "row", "vec_id", "v")  # parts: PIVOTS rows a length
    told = queries.select(*_GROUP, "radius").distinct()
    home = stash(told.withColumn("worst", F.lit(None).cast("double")).mapInArrow(_pairs(cells, groups, stats, k, True), _PAIRS), "pairs")
    fresh = queries.withColumn("high", F.lit(None).cast("long")).withColumn("low", F.lit(None).cast("long"))
    found = stash(_run(fresh, points, home, k), "found")
    # the k-th score of each query, and the worst of a group (null: some query has fewer than k yet)
    order = Window.partitionBy("row").orderBy(F.desc("high"), F.desc("low"), "vec_id", "found_row")
    kth = found.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("row", "high", "low")
    ready = stash(queries.join(kth, "row", "left"), "queries")
    score = F.col("high").cast("double") * F.lit(float(_HALF)) + F.col("low").cast("double")
    worst = ready.groupBy(*_GROUP, "radius").agg(F.when(F.count_if(F.col("high").isNull()) == 0, F.min(score * (1 - F.signum(score) * 1e-12))).alias("worst"))
    rest = stash(worst.mapInArrow(_pairs(cells, groups, stats, k, False), _PAIRS), "pairs")
    every = found.unionByName(_run(ready, points, rest, k))
    least, most = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    exact = F.when(F.col("high") >= 2, most).when(F.col("high") < -2, least).otherwise(F.shiftleft(F.col("high"), 62) + F.col("low"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", exact.alias("score"))
