"""Exact top-k by inner product with paged M-trees, searched best first.

Vectors are split around pivots, large cells again around pivots of their own, until a page holds about 1,024. A
page is an M-tree node: its centre, leaves with a routing vector, a covering radius, the largest norm inside and the
distance to the centre, and in each leaf the vectors with their norms and distances to the routing vector. Centres
and radii of the pages are the members of further such nodes, the directory. For an anchor a at distance d from
a query q, and x within r of a, q.x is at most (|q|^2 + |x|^2 - (d - r)^2) / 2 and at most q.a + |q| r. Both hold
for a lower bound of d as well, so the triangle inequality rules out leaves, pages and vectors by stored distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from burnish.llm.common import sized
from burnish.sources.shared import written

SCALE = 1024
PIVOTS = 64  # of a cell; they shape the pages, results do not depend on them
PAGE_ROWS, LEAF_ROWS = 1024, 32  # members of a page and of a leaf, about
LEVELS = 9  # of cells at most, as cell numbers take six bits a level; what is larger yet is cut by hash
SPLIT_ROWS = 1 << 16  # rows of a cell that one task splits, about
QUERIES = 512  # queries of a block, about
LANES = 8  # of the pages of a directory node, at least; a lane is a key of the last join
FIRST = 2  # pages a query visits, best bound first, before it meets the rest
NONE = -((1 << 63) - 1)  # no score yet
SLACK = 1e-6  # relative; bounds are rounded, scores are exact

NODE = [T.StructField(name, T.BinaryType()) for name in ("vectors", "near", "leaves", "routes", "centre")] + [
    T.StructField("radius", T.DoubleType()), T.StructField("top", T.DoubleType()),
]
PAGE = T.StructType([T.StructField("cell", T.LongType()), T.StructField("part", T.LongType()), T.StructField("numbers", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.LongType())), *NODE])
DIRECTORY = T.StructType([T.StructField(name, T.ArrayType(T.LongType())) for name in ("pages", "lanes")] + [T.StructField("node", T.LongType()), *NODE])
HIT = "query_row long, query_id long, vec_id long, score long"
HIT_COLUMNS = ["query_row", "query_id", "vec_id", "score"]
LISTS = ["query_rows", "query_ids", "query_vectors", "floors"]
ASKED = ["lane", "pages", "mask", *LISTS]
ASK = "lane long, pages array<long>, mask binary, query_rows array<long>, query_ids array<long>, query_vectors array<binary>, floors array<double>"


def integers(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, v): floor(SCALE * x) of the rows whose vectors are there and have finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return vectors.where(F.col(vector).isNotNull() & fine).select(F.col(id_column).alias("vec_id"), scaled.alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(squared, 0))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    largest = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    if largest < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return (a.astype(object) @ b.T.astype(object)).astype(np.int64)


def _nearest(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return _distances(v, pivots).argmin(1)


def _first_cells(pivots: np.ndarray):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = _nearest(_matrix(batch["v"], pivots.shape[1]), pivots) if len(batch) else np.empty(0, dtype=np.int64)
            yield batch.assign(cell=PIVOTS + near)

    return rows


def _next_cells(width: int):
    """Rows sorted by cell and lane, the cell's pivots before its rows, which go to the nearest of them."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, pivots = None, None
        for batch in batches:
            for key, part in batch.groupby("cell", sort=False):
                if key != cell:
                    cell, pivots = key, None
                given = part.loc[part["pivots"].notna(), "pivots"]
                if len(given):
                    pivots = _matrix(pd.Series(list(given.iloc[0])), width)
                part = part.loc[part["pivots"].isna(), ["vec_id", "v", "row"]]
                near = _nearest(_matrix(part["v"], width), pivots) if pivots is not None and len(part) else 0
                yield part.assign(cell=key * PIVOTS + near)

    return rows


def _split(placed: DataFrame, large: DataFrame, level: int, width: int) -> DataFrame:
    """The rows of the cells of ``large`` (cell, n) around pivots of their cell; lanes share the rows of a cell out."""
    inside = placed.join(sized(large), "cell")
    many = F.least(F.lit(PIVOTS), F.ceil(2 * F.col("n") / PAGE_ROWS))
    drawn = inside.where(F.pmod(F.xxhash64("row", F.lit(level)), F.col("n")) < 4 * PIVOTS)
    picked = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("row").alias("h"), "row", "v"))), F.lit(1), F.first(many).cast("int"))
    pivots = written(drawn.groupBy("cell").agg(picked.getField("v").alias("pivots"), F.first("n").alias("n")), "pivots")
    lanes = F.ceil(F.col("n") / SPLIT_ROWS)
    rows = inside.select("cell", F.pmod(F.xxhash64("row"), lanes).alias("lane"), "vec_id", "v", "row", F.lit(None).cast("array<array<double>>").alias("pivots"))
    heads = pivots.select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), lanes - 1)).alias("lane"), F.lit(0).cast("long").alias("vec_id"),
        F.lit(None).cast("array<double>").alias("v"), F.lit(0).cast("long").alias("row"), "pivots",
    )
    stream = heads.unionByName(rows).repartition("cell", "lane").sortWithinPartitions("cell", "lane", F.col("pivots").isNull())
    return stream.mapInPandas(_next_cells(width), "vec_id long, v array<double>, row long, cell long")


def _node(v: np.ndarray, radii: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, dict]:
    """An M-tree node over balls: the order of its members, by leaf, and what is stored of it.

    Leaves are around routing vectors that are spread by farthest-first choice. ``tops`` are the largest squared
    norms in the balls; a single vector is a ball of radius 0.
    """
    centre = np.round(v.mean(0))
    to_centre = _distances(v, centre[None])[:, 0]
    chosen = [int(to_centre.argmin())]
    gap = _distances(v, v[chosen])[:, 0]
    while len(chosen) < -(-len(v) // LEAF_ROWS) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(v, v[chosen[-1:]])[:, 0])
    routes = v[chosen]
    apart = _distances(v, routes)
    leaf = apart.argmin(1)
    order = np.argsort(leaf, kind="stable")
    to_route = apart[order, leaf[order]]
    near = np.stack([to_route, radii[order], tops[order]])
    starts = np.searchsorted(leaf[order], np.arange(len(routes) + 1))
    leaves = np.array([
        (a, b, (near[0] + near[1])[a:b].max(initial=0), near[2, a:b].max(initial=0), d)
        for a, b, d in zip(starts, starts[1:], _distances(routes, centre[None])[:, 0], strict=False)
    ])
    arrays = {"vectors": v[order], "near": near, "leaves": leaves, "routes": routes, "centre": centre}
    numbers = {"radius": float((to_centre + radii).max()), "top": float(tops.max())}
    return order, {name: a.tobytes() for name, a in arrays.items()} | numbers


def _page_of(width: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        v = _matrix(rows["v"], width)
        order, stored = _node(v, np.zeros(len(v)), (v * v).sum(1))
        where = {name: int(rows[name].iloc[0]) for name in ("cell", "part")}
        return pd.DataFrame([{**where, "numbers": rows["row"].to_numpy()[order], "ids": rows["vec_id"].to_numpy()[order], **stored}])

    return build


def _directory_of(width: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("page")
        v = np.frombuffer(b"".join(rows["centre"])).reshape(-1, width)
        order, stored = _node(v, rows["radius"].to_numpy(), rows["top"].to_numpy())
        listed = {"pages": rows["page"].to_numpy()[order], "lanes": rows["lane"].to_numpy()[order]}
        return pd.DataFrame([{**listed, "node": int(rows["node"].iloc[0]), **stored}])

    return build


class _Node:
    """A stored node opened for search."""

    def __init__(self, row, width: int) -> None:
        self.v, self.routes = (np.frombuffer(b).reshape(-1, width) for b in (row.vectors, row.routes))
        self.to_route, self.radii, self.tops = np.frombuffer(row.near).reshape(3, -1)
        self.leaves = np.frombuffer(row.leaves).reshape(-1, 5)
        self.centre, self.radius, self.top = np.frombuffer(row.centre), row.radius, row.top
        self.squares, self.route_squares = (self.v * self.v).sum(1), (self.routes * self.routes).sum(1)

    def limit(self, norms, d, radius, top, squares) -> np.ndarray:
        """At least the score of any x within ``radius`` of an anchor that is ``d`` or more away from the query."""
        by_distance = (norms + top - np.maximum(d - radius, 0) ** 2) / 2
        by_ball = (norms + squares - d * d) / 2 + np.sqrt(norms) * radius
        return np.minimum(by_distance, by_ball) + SLACK * (norms + self.top + 1)

    def leaf_limits(self, queries: np.ndarray, norms: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Limits of each query in each leaf, -inf where ruled out, and its distances to the routing vectors."""
        norms, least = norms[:, None], least[:, None]
        to_centre = _distances(queries, self.centre[None])
        hopeful = self.limit(norms, to_centre, self.radius, self.top, (self.centre**2).sum()) >= least
        _, _, radii, tops, stored = self.leaves.T
        # |d(q, centre) - d(route, centre)| <= d(q, route): leaves ruled out by stored distances alone
        hopeful = hopeful & (self.limit(norms, np.abs(to_centre - stored), radii, tops, self.route_squares) >= least)
        rows, leaves = np.flatnonzero(hopeful.any(1)), np.flatnonzero(hopeful.any(0))
        to_route = np.full(hopeful.shape, np.inf)
        if len(rows):
            to_route[np.ix_(rows, leaves)] = _distances(queries[rows], self.routes[leaves])
        limits = np.full(hopeful.shape, -np.inf)
        found = self.limit(norms, np.where(hopeful, to_route, 0), radii, tops, self.route_squares)
        np.copyto(limits, found, where=hopeful & (found >= least))
        return limits, to_route

    def member_limits(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Limits of each query in each member, -inf where ruled out."""
        norms = (queries * queries).sum(1)
        by_leaf, to_route = self.leaf_limits(queries, norms, least)
        out = np.full((len(queries), len(self.v)), -np.inf)
        for n in np.flatnonzero((by_leaf > -np.inf).any(0)):
            a, b = int(self.leaves[n, 0]), int(self.leaves[n, 1])
            rows = np.flatnonzero(by_leaf[:, n] > -np.inf)
            balls = (self.radii[a:b], self.tops[a:b], self.squares[a:b])
            stored = np.abs(to_route[rows, n][:, None] - self.to_route[a:b])
            rows = rows[(self.limit(norms[rows, None], stored, *balls) >= least[rows, None]).any(1)]
            found = self.limit(norms[rows, None], _distances(queries[rows], self.v[a:b]), *balls)
            out[rows, a:b] = np.where(found >= least[rows, None], found, -np.inf)
        return out

    def search(self, own: np.ndarray, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, id and score of the at most k best members, by ids ``own``, that score ``least`` or more."""
        norms = (queries * queries).sum(1)
        limits, to_route = self.leaf_limits(queries, norms, least)
        floors = least.copy()
        scores, hits = np.full((len(queries), k), NONE), np.zeros((len(queries), k), dtype=np.int64)
        for n in np.argsort(-limits.max(0, initial=-np.inf), kind="stable"):
            rows = np.flatnonzero((limits[:, n] > -np.inf) & (limits[:, n] >= floors))
            a, b = int(self.leaves[n, 0]), int(self.leaves[n, 1])
            q2, d = norms[rows, None], to_route[rows, n][:, None]
            by_route = (q2 + self.route_squares[n] - d * d) / 2 + np.sqrt(q2) * self.to_route[a:b] + SLACK * (q2 + self.top + 1)
            stored = self.limit(q2, np.abs(d - self.to_route[a:b]), 0, self.tops[a:b], self.squares[a:b])
            hopeful = np.minimum(by_route, stored) >= floors[rows, None]
            some, members = np.flatnonzero(hopeful.any(1)), np.flatnonzero(hopeful.any(0))
            if not len(some):
                continue
            rows, hopeful, found = rows[some], hopeful[np.ix_(some, members)], own[a + members]
            reached = _scores(queries[rows], self.v[a + members])
            hopeful &= (reached >= scores[rows, -1:]) & (found != ids[rows, None])
            some = np.flatnonzero(hopeful.any(1))
            rows = rows[some]
            reached = np.concatenate((scores[rows], np.where(hopeful[some], reached[some], NONE)), axis=1)
            found = np.concatenate((hits[rows], np.broadcast_to(found, (len(rows), len(found)))), axis=1)
            order = np.lexsort((found, -reached))[:, :k]
            scores[rows], hits[rows] = np.take_along_axis(reached, order, 1), np.take_along_axis(found, order, 1)
            floors[rows] = np.where(scores[rows, -1] > NONE, np.maximum(floors[rows], scores[rows, -1]), floors[rows])
        i, j = np.nonzero((scores > NONE) & (scores >= least[:, None]))
        return i, hits[i, j], scores[i, j]


def _hits(hits: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    i, found, scores = hits
    return pd.DataFrame(dict(zip(HIT_COLUMNS, (rows[i], ids[i], found, scores), strict=True)))


def _seeds(width: int, k: int, every: int):
    """Queries in their own page."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                node, own, numbers = _Node(row, width), np.asarray(row.ids), np.asarray(row.numbers)
                mine = np.flatnonzero(own % every == 0)
                hits = node.search(own, own[mine], node.v[mine], np.full(len(mine), -np.inf), k)
                yield _hits(hits, numbers[mine], own[mine])

    return rows


def _visits(width: int, k: int):
    """A page and a block of queries; ``mask`` tells which of them are to visit it, by its ``place`` (from 1)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                mask = np.unpackbits(np.frombuffer(row.mask, dtype=np.uint8), count=len(row.query_ids) * row.n_pages)
                some = np.flatnonzero(mask.reshape(-1, row.n_pages)[:, row.place - 1])
                numbers, ids, floors = (np.asarray(c)[some] for c in (row.query_rows, row.query_ids, row.floors))
                queries = np.frombuffer(b"".join(row.query_vectors)).reshape(-1, width)[some]
                if len(some):
                    yield _hits(_Node(row, width).search(np.asarray(row.ids), ids, queries, floors.astype(float), k), numbers, ids)

    return rows


def _query_rows(width: int, every: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, numbers, v = np.asarray(row.ids), np.asarray(row.numbers), np.frombuffer(row.vectors).reshape(-1, width)
                mine = np.flatnonzero(ids % every == 0)
                yield pd.DataFrame({"query_row": numbers[mine], "query_id": ids[mine], "home": row.page, "vector": [v[i].tobytes() for i in mine]})

    return rows


def _limits(row, width: int) -> np.ndarray:
    """What each query of a block can score at most in the pages of a node; -inf where ruled out or visited."""
    queries = np.frombuffer(b"".join(row.query_vectors)).reshape(-1, width)
    limits = _Node(row, width).member_limits(queries, np.asarray(row.floors, dtype=float))
    place = {int(page): n for n, page in enumerate(row.pages)}
    for i, visited in enumerate(row.visited):
        limits[i, [place[page] for page in visited if page in place]] = -np.inf
    return limits


def _firsts(width: int):
    """The most hopeful pages of a node for each query of a block."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                limits = _limits(row, width)
                best = np.argsort(-limits, axis=1, kind="stable")[:, :FIRST]
                i, j = np.nonzero(np.take_along_axis(limits, best, 1) > -np.inf)
                pages = best[i, j]
                yield pd.DataFrame({"query_row": np.asarray(row.query_rows)[i], "page": np.asarray(row.pages)[pages], "limit": limits[i, pages]})

    return rows


def _asks(width: int):
    """The queries of a block that some page of a lane is not ruled out for, with a bit for each query and page."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                open_, pages, lanes = _limits(row, width) > -np.inf, np.asarray(row.pages), np.asarray(row.lanes)
                for lane in np.unique(lanes[open_.any(0)]):
                    mine = np.flatnonzero((lanes == lane) & open_.any(0))
                    some = np.flatnonzero(open_[:, mine].any(1))
                    asked = {name: np.asarray(getattr(row, name))[some] for name in ("query_rows", "query_ids", "floors")}
                    bits = np.packbits(open_[np.ix_(some, mine)]).tobytes()
                    yield pd.DataFrame([{"lane": lane, "pages": pages[mine], "mask": bits, "query_vectors": [row.query_vectors[i] for i in some], **asked}])[ASKED]

    return rows


def _pages(rows: DataFrame, width: int) -> DataFrame:
    """(page, PAGE): cells around pivots, split until one holds a page; what distances do not part is cut by hash."""
    sample = rows.select(F.xxhash64("row").alias("h"), "row", "v").orderBy("h", "row").limit(PIVOTS).toPandas()
    placed = rows.mapInPandas(_first_cells(_matrix(sample["v"], width)), "vec_id long, v array<double>, row long, cell long")
    done, former = [], None
    for level in range(1, LEVELS):
        placed = written(placed, "cells")
        large = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAGE_ROWS)
        if former is not None:  # cells that their pivots did not part are left as they are
            before = former.select(F.col("cell").alias("parent"), F.col("n").alias("parent_n"))
            large = large.withColumn("parent", F.floor(F.col("cell") / PIVOTS)).join(sized(before), "parent").where("n < parent_n").select("cell", "n")
        large = written(large, "large")
        done.append(placed.join(sized(large), "cell", "left_anti"))
        if large.isEmpty():
            break
        placed, former = _split(placed, large, level, width), large
    else:
        done.append(written(placed, "cells"))
    placed = reduce(DataFrame.unionByName, done)
    counts = written(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PAGE_ROWS).alias("parts")), "parts")
    paged = placed.join(sized(counts), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    pages = paged.groupBy("cell", "part").applyInPandas(_page_of(width), PAGE)
    return written(pages.withColumn("page", F.monotonically_increasing_id()), "pages")


def _located(pages: DataFrame) -> DataFrame:
    """Pages with the directory node that they are members of, near ones in one, and their lane."""
    n = pages.count()
    nodes = 1 + n // PAGE_ROWS
    lanes = max(LANES, -(-pages.sparkSession.sparkContext.defaultParallelism // nodes))
    beside = F.when(F.col("part") == 0, F.floor(F.col("cell") / PIVOTS)).otherwise(-F.col("cell"))
    node = F.pmod(F.xxhash64(beside, F.floor(F.col("part") / PAGE_ROWS)), F.lit(nodes))
    return pages.withColumn("node", node).withColumn("lane", F.col("node") * lanes + F.pmod(F.xxhash64("page"), F.lit(lanes)))


def _blocks(queries: DataFrame, key: list, n: Column) -> DataFrame:
    """Lists of about ``QUERIES`` queries with equal ``key``; ``n`` is how many share it."""
    part = F.pmod(F.xxhash64("query_row", F.lit(1)), 1 + F.floor(n / QUERIES))
    floor = F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf")))
    q = F.collect_list(F.struct("query_row", "query_id", "vector", floor.alias("floor"), "visited"))
    grouped = queries.groupBy(*key, part.alias("block")).agg(q.alias("q"))
    return grouped.select(
        *key, "block", F.col("q.query_row").alias("query_rows"), F.col("q.query_id").alias("query_ids"),
        F.col("q.vector").alias("query_vectors"), F.col("q.floor").alias("floors"), F.col("q.visited").alias("visited"),
    )


def _met(directory: DataFrame, queries: DataFrame, many: int, nodes: int) -> DataFrame:
    """Each node of the directory beside each block of queries."""
    blocks = _blocks(queries, [], F.lit(many)).withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nodes - 1).cast("long"))))
    return directory.hint("merge").join(blocks, "node")


def _floors(hits: DataFrame, k: int) -> DataFrame:
    """(query_row, floor): the k-th best score so far, null where there are fewer."""
    best = Window.partitionBy("query_row").orderBy(F.desc("score"))
    top = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    return top.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id is divisible by ``every``.

    Scores are inner products of floor(1024 * x), exact while they fit 64 bits; ties go to the smaller id. Rows
    with a null id, a null vector, or a component that is null or not finite take no part. Shorter vectors count
    as ending in zeros. Rows that repeat an id are candidates or queries each by itself: a query passes over all
    rows of its own id, and the hits of all rows of a query are ranked together. No rows, no result.

    Each query searches its own page first, then the ``FIRST`` pages of the best bounds, which gives it a score to
    beat. Then it visits all pages whose bounds reach that score. Bounds are found in the directory, whose nodes
    hold about 1,024 pages; vectors of pages are read only beside queries that visit them. A task holds one node
    or page and one block of queries at a time.
    """
    spark = vectors.sparkSession
    rows = written(integers(vectors.where(F.col(id_column).isNotNull()), id_column, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)  # only empty vectors: every score is 0
    pages = _located(_pages(rows, width))
    listed = pages.select("node", "lane", "page", "centre", "radius", "top")
    directory = written(listed.groupBy("node").applyInPandas(_directory_of(width), DIRECTORY), "directory")
    nodes = 1 + (directory.agg(F.max("node")).first()[0])

    seeds = written(pages.mapInPandas(_seeds(width, k, every), HIT), "seeds")
    asking = pages.select("page", "ids", "numbers", "vectors").mapInPandas(_query_rows(width, every), "query_row long, query_id long, home long, vector binary")
    asking = asking.hint("merge").join(_floors(seeds, k), "query_row", "left").withColumn("visited", F.array("home"))
    asking = written(asking, "queries")
    many = asking.count()

    near = _met(directory, asking, many, nodes).mapInPandas(_firsts(width), "query_row long, page long, limit double")
    hopeful = Window.partitionBy("query_row").orderBy(F.desc("limit"), "page")
    near = written(near.withColumn("n", F.row_number().over(hopeful)).where(F.col("n") <= FIRST).select("query_row", "page"), "near")
    crowds = written(near.groupBy("page").agg(F.count(F.lit(1)).alias("n")), "crowds")
    first = _blocks(near.join(sized(crowds), "page").hint("merge").join(asking, "query_row"), ["page", "n"], F.col("n"))
    # one page: a bit for each query, all set
    first = first.select("page", F.lit(1).alias("place"), F.lit(1).alias("n_pages"), F.unhex(F.repeat(F.lit("ff"), F.floor(F.size("query_ids") / 8).cast("int") + 1)).alias("mask"), *LISTS)
    stored = pages.select("page", "lane", "ids", *[field.name for field in NODE])
    found = written(stored.hint("merge").join(first, "page").mapInPandas(_visits(width, k), HIT), "found").unionByName(seeds)

    visited = near.groupBy("query_row").agg(F.collect_list("page").alias("pages"))
    asking = asking.drop("floor").hint("merge").join(_floors(found, k), "query_row", "left").join(visited.hint("merge"), "query_row", "left")
    asking = written(asking.withColumn("visited", F.concat("visited", F.coalesce("pages", F.array().cast("array<long>")))).drop("pages"), "queries")
    asks = _met(directory, asking, many, nodes).mapInPandas(_asks(width), ASK)
    placed = asks.withColumn("n_pages", F.size("pages"))
    rest = stored.hint("merge").join(placed, "lane").withColumn("place", F.array_position("pages", F.col("page")).cast("int"))
    rest = rest.where(F.col("place") > 0).drop("pages").mapInPandas(_visits(width, k), HIT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = found.unionByName(rest).withColumn("rank", F.row_number().over(best))
    return hits.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
