"""Exact top-k by inner product: best-first search in M-trees of paged metric nodes.

Components become floor(256 * x) with x as double. Vectors that are null or empty, or hold null or non-finite
components, and rows without an id take no part; vectors are compared with those of their own dimension. A candidate
is every row but the query's own: another row of the query's id is one too, and rows that repeat an id and a vector count
as often as they occur. Equal scores go to the smaller id; a query with fewer candidates has fewer ranks; query rows of
one id each have their own ranks. An empty table gives no rows; other columns of the table are left out.

Pivots (at most MAX_PIVOTS rows, those of smallest hash) route each vector to its nearest. A region is cut by distance
to its pivot into rings of about PAGE vectors, and a ring of far more (one vector may fill a region) by hash: these are
the pages, MAX_PAGES at most, as they grow beyond that. All vectors are indexed; no result depends on the sample. A page's
vectors form an M-tree, built once in one task and stored as one row: nodes with covering radii and the distances of
their entries to the node's own routing vector. For a query q and an entry at distance d from a routing vector p with
known q.p, all scores below it are at most q.p + |q| (d + r), so that many inner products are never computed; with q.c
computed, they are at most q.c + |q| r. Nodes are opened best first until the bound falls below the k-th score.

Queries first search their home page; with the k-th score found there they visit only pages whose bound reaches it. A
page's bound is the least of three: by its outer radius, by its largest norm, and by how far q's own distance to the
pivot lies outside of the ring. Queries go to pages, and a page meets them in blocks of QUERY_BLOCK: its tree is copied
only for a page that more queries ask for.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandlens.llm.store import keep, table

PAGE, LEAF, FAN = 8192, 512, 16
MAX_PIVOTS, MAX_PAGES, QUERY_BLOCK = 1024, 65_536, 16_384
#: Quantiles of the distances in a region from which its rings are made.
RINGS = 64
#: Relative room for rounding in bounds; scores themselves are whole numbers.
SLACK = 1e-9


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def fits_doubles(q: np.ndarray, largest: float) -> bool:
    """Whether doubles hold all sums of q's products with components up to `largest`."""
    return bool(np.abs(q).max(initial=0) * largest * len(q) < 2.0**53)


def products(q: np.ndarray, rows: np.ndarray, doubles: bool) -> np.ndarray:
    """Exact inner products: in doubles where these hold all sums, else in long arithmetic."""
    return (rows @ q if doubles else rows.astype(np.int64) @ q.astype(np.int64)).astype(np.int64)


class Node:
    """`entries`: vectors, their distance to this node's routing vector, radii and children; a leaf has ids and row
    numbers instead."""

    __slots__ = ("vectors", "away", "radii", "children", "ids", "rows")


def distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - centre) ** 2).sum(axis=1))


def build(vectors: np.ndarray, ids: np.ndarray, numbers: np.ndarray, centre: np.ndarray) -> Node:
    node = Node()
    node.ids = node.rows = node.radii = node.children = None
    if len(vectors) <= LEAF:
        node.vectors, node.ids, node.rows, node.away = vectors, ids, numbers, distances(vectors, centre)
        return node
    pick = np.linspace(0, len(vectors) - 1, FAN).astype(int)
    routes = np.unique(vectors[pick], axis=0)
    near = np.argmin(((vectors**2).sum(axis=1)[:, None] - 2 * vectors @ routes.T) + (routes**2).sum(axis=1), axis=1)
    parts = [np.flatnonzero(near == k) for k in range(len(routes))]
    if max(map(len, parts)) == len(vectors):  # nothing to tell them apart by: cut in equal parts
        parts = np.array_split(np.arange(len(vectors)), FAN)
        routes = np.repeat(routes[:1], FAN, axis=0)
    node.children, rows, radii = [], [], []
    for route, own in zip(routes, parts):
        if len(own):
            node.children.append(build(vectors[own], ids[own], numbers[own], route))
            rows.append(route)
            radii.append(distances(vectors[own], route).max())
    node.vectors, node.radii = np.array(rows), np.array(radii)
    node.away = distances(node.vectors, centre)
    return node


def best_first(root: Node, centre: np.ndarray, q: np.ndarray, own: int, k: int, floor: float, doubles: bool = True) -> list[tuple[int, int, int]]:
    """The k best (score, -id, row number) of at least `floor` under the root, but for the query's own row."""
    norm = float(np.sqrt(q @ q))
    found: list[tuple[int, int, int]] = []
    queue = [(-np.inf, 0, root, float(q @ centre))]
    count, limit = 1, floor
    while queue:
        bound, _, node, at_route = heapq.heappop(queue)
        if -bound < limit:
            break
        room = SLACK * (abs(at_route) + norm + 1)
        reach = at_route + norm * (node.away if node.radii is None else node.away + node.radii) + room
        maybe = np.flatnonzero(reach >= limit)
        if not len(maybe):
            continue
        scores = products(q, node.vectors if len(maybe) == len(reach) else node.vectors[maybe], doubles)
        if node.radii is None:
            high = np.flatnonzero((scores >= limit) & (node.rows[maybe] != own))
            if len(high) > 4 * k:  # of many, those below the k-th best can't enter
                high = high[scores[high] >= np.partition(scores[high], len(high) - k)[len(high) - k]]
            for score, i, row in zip(scores[high].tolist(), node.ids[maybe[high]].tolist(), node.rows[maybe[high]].tolist()):
                if score >= limit:
                    if len(found) < k:
                        heapq.heappush(found, (score, -i, row))
                    elif (score, -i, row) > found[0]:
                        heapq.heapreplace(found, (score, -i, row))
                    if len(found) == k:
                        limit = max(limit, found[0][0])
        else:
            for j, score in zip(maybe.tolist(), scores.tolist()):
                bound = score + norm * node.radii[j] + SLACK * (abs(score) + norm + 1)
                if bound >= limit:
                    heapq.heappush(queue, (-bound, count, node.children[j], float(score)))
                    count += 1
    return found


class Router:
    """Bounded: at most MAX_PIVOTS routing vectors and MAX_PAGES pages with their covering radii."""

    def __init__(self, pivots: list[tuple]):
        self.centres = {d: np.array([v for v in pivots if len(v) == d], np.float64) for d in {len(v) for v in pivots}}

    def regions(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest pivot of its dimension (0, an empty route, if there is none) and its distance."""
        centres = self.centres.get(rows.shape[1], np.zeros((1, rows.shape[1])))
        near = np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)
        return near, np.sqrt(((rows - centres[near]) ** 2).sum(axis=1))

    def centre(self, dimension: int, region: int) -> np.ndarray:
        return self.centres.get(dimension, np.zeros((1, dimension)))[region]


def page_bounds(at: np.ndarray, norms: np.ndarray, away: np.ndarray, low: float, high: float, largest: float) -> np.ndarray:
    """The largest score that each query can have in a page: `at` is q.p, `away` |q - p| for the page's pivot p; the page's
    vectors lie between `low` and `high` from p, and none is longer than `largest`."""
    gap = np.maximum(0, np.maximum(away - high, low - away))
    return np.minimum(np.minimum(at + norms * high, norms * largest), (norms**2 + largest**2 - gap**2) / 2)


def scaled(frame: DataFrame, key: str, vector: str, is_query: str) -> DataFrame:
    """Columns id, v (whole numbers as doubles), asks: the rows that take part."""
    part = frame.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    part = part.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(finite)
    return part.select("id", F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"), "asks")


PLACE = ["dim", "region", "page"]


def top_k(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", is_query: str = "vec_id % 50 = 0", k: int = 5, page: int = PAGE) -> DataFrame:
    """Columns query_id, rank, vec_id, score: for each row of `frame` for which is_query holds its k best others."""
    spark = frame.sparkSession
    base = scaled(frame, key, vector, is_query)
    n_rows = base.count()
    page = max(page, -(-n_rows // MAX_PAGES))
    pivots = min(MAX_PIVOTS, -(-n_rows // page))
    router = Router([tuple(r.v) for r in base.select("id", "v").orderBy(F.xxhash64("id", "v")).limit(pivots).collect()] if n_rows else [])

    def route(batches):
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                region, away = router.regions(matrix(part.column("v")))
                yield pa.record_batch([*(part.column(x) for x in ("row", "id", "v", "asks")), pa.array(np.full(part.num_rows, d), pa.int32()), pa.array(region, pa.int32()), pa.array(away)], names=["row", "id", "v", "asks", "dim", "region", "away"])

    # row numbers hold from here on, as they are written
    numbered = base.withColumn("row", F.monotonically_increasing_id())
    routed = keep(numbered.mapInArrow(route, "row long, id long, v array<double>, asks boolean, dim int, region int, away double"), "routed")
    # a row for each pivot, or for each dimension without one
    edges = routed.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / F.lit(page)).cast("int").alias("pages"), F.percentile_approx("away", [i / RINGS for i in range(1, RINGS)], 1000).alias("edges"))
    fine = F.size(F.filter("edges", lambda e: e < F.col("away")))
    ringed = routed.join(edges, ["dim", "region"]).withColumn("ring", F.floor(fine * F.least("pages", F.lit(RINGS)) / F.lit(RINGS)).cast("int")).drop("pages", "edges")
    parts = ringed.groupBy("dim", "region", "ring").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * page)).cast("int").alias("parts"))
    numbered_page = (F.col("ring") * F.lit(MAX_PAGES) + F.pmod(F.xxhash64("row"), "parts").cast("int")).alias("page")
    placed = ringed.join(parts, ["dim", "region", "ring"]).select("row", "id", "v", "asks", "dim", "region", numbered_page, "away")

    def plant(place, members):
        centre, vectors, away = router.centre(place[0].as_py(), place[1].as_py()), matrix(members["v"]), members["away"].to_numpy()
        root = build(vectors, members["id"].to_numpy(), members["row"].to_numpy(), centre)
        largest = float(np.sqrt((vectors**2).sum(axis=1)).max())
        return pa.table({**{c: pa.array([x.as_py()], pa.int32()) for c, x in zip(PLACE, place)}, "low": [float(away.min())], "high": [float(away.max())], "norm": [largest], "most": [float(np.abs(vectors).max())], "tree": pa.array([pickle.dumps(root, 5)], pa.binary())})

    trees = keep(placed.select("row", "id", "v", "away", *PLACE).groupBy(*PLACE).applyInArrow(plant, "dim int, region int, page int, low double, high double, norm double, most double, tree binary"), "trees")
    known = spark.sparkContext.broadcast([tuple(r) for r in trees.select(*PLACE, "low", "high", "norm").collect()])  # MAX_PAGES rows or so
    asked = keep(placed.filter("asks").select("row", "id", "v", *PLACE), "queries")

    def search(place, tree, given):
        out: list = []
        if tree.num_rows and given.num_rows:
            centre = router.centre(place[0].as_py(), place[1].as_py())
            root, largest = pickle.loads(tree["tree"][0].as_py()), tree["most"][0].as_py()
            floors = given["floor"].to_numpy()
            for i, (row, own, q) in enumerate(zip(given["row"].to_pylist(), given["id"].to_pylist(), matrix(given["v"]))):
                out += [(row, own, -low, score) for score, low, _ in best_first(root, centre, q, row, k, floors[i], fits_doubles(q, largest))]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_row", "query_id", "vec_id", "score"), columns)})

    def visit(given: DataFrame) -> DataFrame:
        """Each tree once for every block of its queries."""
        blocks = given.groupBy(*PLACE).agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("blocks"))
        held = trees.select(*PLACE, "most", "tree").join(blocks, PLACE).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        dealt = given.join(blocks, PLACE).withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int")).drop("blocks")
        where = [*PLACE, "block"]
        return held.groupBy(*where).cogroup(dealt.groupBy(*where)).applyInArrow(search, "query_row long, query_id long, vec_id long, score long")

    home = keep(visit(asked.withColumn("floor", F.lit(float("-inf")))), "home")
    floor = home.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
    started = asked.join(floor, F.col("row") == F.col("query_row"), "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))

    def spread(batches):
        fields = ("row", "id", "v", "floor")
        by: dict = {}
        for d, region, number, *bounds in known.value:
            by.setdefault(d, {}).setdefault(region, []).append((number, *bounds))
        for batch in batches:
            dims, homes = batch.column("dim").to_numpy(), list(zip(batch.column("region").to_pylist(), batch.column("page").to_pylist()))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                own = [h for h, x in zip(homes, dims) if x == d]
                q, floors = matrix(part.column("v")), part.column("floor").to_numpy()
                norms = np.sqrt((q**2).sum(axis=1))
                for region, pages in by[d].items():
                    centre = router.centre(d, region)
                    at, away = q @ centre, distances(q, centre)
                    room = SLACK * (np.abs(at) + norms**2 + (centre @ centre) + 1)
                    for number, *bounds in pages:
                        go = (page_bounds(at, norms, away, *bounds) + room >= floors) & np.array([h != (region, number) for h in own])
                        if go.any():
                            some = part.filter(pa.array(go))
                            n = some.num_rows
                            yield pa.record_batch([*(some.column(x) for x in fields), *(pa.array(np.full(n, x), pa.int32()) for x in (d, region, number))], names=[*fields, *PLACE])

    further = started.select("row", "id", "v", "floor", *PLACE).mapInArrow(spread, "row long, id long, v array<double>, floor double, dim int, region int, page int")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (home.union(visit(keep(further, "visits"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op8_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


#: The same rows by DuckDB.
SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, len(embedding) AS d, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r AND q.d = c.d),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
