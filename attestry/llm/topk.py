"""Exact top-k inner-product search with a KD-tree per shard.

Vectors are made integral (``floor(scale * x)``, x as double).  A tree of median splits over a bounded sample cuts the
space into cells; every row goes to its cell, and a cell with more than ``shard_rows`` rows is dealt over several
shards by a hash, so that no shard is large whatever the data.  All cells get tight bounding boxes of their rows.  A
shard's task builds one KD-tree: median splits on the widest axis, every node with its tight box.  A query walks a tree best
first: a node's bound is the largest inner product any point of its box can have (the sum over axes of the better
corner), nodes wait in a heap by bound, and the walk ends when no bound reaches the k-th best score.

Each query first visits a shard of the cell with the largest bound.  The k-th best score from there is propagated: the query then
goes to the shards of those cells only whose bound reaches it, with that score as the first cut.  A shard's rows and
the queries that visit it are sorted together, so that its tree is built once and queries stream past it; queries
beyond ``block_rows`` for one shard go to further copies of it.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; a query meets only
vectors with as many components; rows without an id take no part; every other row is a candidate, so that a
``vec_id`` on several rows may be found several times, and each of its rows is a query of its own; a query leaves out its
own row, not others like it; fewer than k candidates give all of them; ties go to the smaller ``vec_id``.  Scores are
exact as long as they fit 64 bits: double arithmetic is used where all products fit 53 bits, integers elsewhere.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, sampled, stored

SCALE, SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 256, 8192, 8192, 64
#: Cells at most, and rows of the sample that their splits come from.
CELLS, SAMPLE = 1024, 16_384
#: Rows of a table of visits by shard up to which it is broadcast.
BROADCAST_ROWS = 100_000


class Tree:
    """A KD-tree over integral vectors, in arrays; children of node i are ``left[i]`` and ``right[i]``."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.lo, self.hi, self.span, self.left, self.right = [], [], [], [], []

        def add(a: int, b: int) -> int:
            own = points[order[a:b]]
            self.lo.append(own.min(axis=0))
            self.hi.append(own.max(axis=0))
            self.span.append((a, b))
            self.left.append(-1)
            self.right.append(-1)
            return len(self.span) - 1

        todo = [add(0, len(ids))]
        while todo:
            node = todo.pop()
            a, b = self.span[node]
            width = self.hi[node] - self.lo[node]
            axis = int(width.argmax())
            if b - a <= leaf or width[axis] == 0:
                continue
            mid = (b - a) // 2
            own = order[a:b]
            order[a:b] = own[np.argpartition(points[own, axis], mid)]
            self.left[node], self.right[node] = add(a, a + mid), add(a + mid, b)
            todo += [self.left[node], self.right[node]]
        self.ids, self.points = ids[order], points[order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def search(self, query_id: int, query: np.ndarray, k: int, cut: int | float) -> list[tuple[int, int]]:
        """Up to k (score, id), best first; scores below ``cut`` may be left out, and so is one row that is the query's own."""
        own_row = True
        bounds = np.where(query >= 0, self.hi, self.lo) @ query
        heap = [(-bounds[0], 0)]
        best: list[tuple[float, int]] = []  # a heap of (score, -id)
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < cut:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bounds[child] >= cut:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = self.span[node]
            scores = self.points[a:b] @ query
            for i in np.flatnonzero(scores >= cut):
                own = int(self.ids[a + i])
                if own_row and own == query_id and (self.points[a + i] == query).all():
                    own_row = False
                    continue
                entry = (int(scores[i]), -own)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                cut = max(cut, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]

    def as_integers(self) -> Tree:
        """The same tree over 64-bit integers."""
        out = copy.copy(self)
        out.points, out.lo, out.hi = self.points.astype(np.int64), self.lo.astype(np.int64), self.hi.astype(np.int64)
        return out


def exact_in_double(a: np.ndarray, b: np.ndarray, size: int) -> bool:
    return not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * size < 2.0**53


class Splits:
    """Median splits of the widest axis over a sample, for each number of components; a cell is a leaf."""

    def __init__(self, sample: dict[int, np.ndarray], cells: int):
        self.trees: dict[int, list[tuple[int, int, int, int]]] = {}  # (axis, least value on the right, left, right); a leaf has axis -1
        rows = sum(map(len, sample.values()))
        for size, points in sample.items():
            nodes, made = [(-1, 0, 0, 0)], 1
            most = max(1, cells * len(points) // rows)
            todo = [(0, np.arange(len(points)))]
            while todo and made < most:
                todo.sort(key=lambda x: len(x[1]))
                node, rows = todo.pop()
                spread = points[rows].max(axis=0) - points[rows].min(axis=0)
                axis = int(spread.argmax())
                if not spread[axis]:
                    continue
                values = np.sort(points[rows, axis])
                at = values[len(values) // 2]
                at = at if at > values[0] else values[values > values[0]][0]
                right = points[rows, axis] >= at
                nodes[node] = (axis, int(at), len(nodes), len(nodes) + 1)
                nodes += [(-1, 0, 0, 0), (-1, 0, 0, 0)]
                todo += [(len(nodes) - 2, rows[~right]), (len(nodes) - 1, rows[right])]
                made += 1
            self.trees[size] = nodes

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point (all of one number of components); 0 where the sample has no such points."""
        out = np.zeros(len(points), np.int64)
        nodes = self.trees.get(points.shape[1], [(-1, 0, 0, 0)])
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            axis, at, left, right = nodes[node]
            if axis < 0:
                out[rows] = node
            elif len(rows):
                on = points[rows, axis] >= at
                todo += [(left, rows[~on]), (right, rows[on])]
        return out


def integral(vectors: DataFrame, *, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` (longs) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding"),
    ).filter("vec_id is not null and size(embedding) > 0").filter(F.coalesce(ok, F.lit(False)))
    return rows.select("vec_id", F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each number of components in a list column."""
    ends = column.offsets.to_numpy()
    flat, begin, size = column.values.to_numpy(), ends[:-1], np.diff(ends)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, flat[begin[rows][:, None] + np.arange(n)]


def _in_cells(rows: DataFrame, splits: Splits) -> DataFrame:
    """``vec_id, v, size, cell``."""
    held = rows.sparkSession.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for own, points in _matrices(batch.column("v")):
                cell[own] = held.value.cells(points)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(np.diff(batch.column("v").offsets.to_numpy()).astype(np.int64)), pa.array(cell)],
                names=["vec_id", "v", "size", "cell"],
            )

    return rows.mapInArrow(run, "vec_id long, v array<long>, size long, cell long")


def _boxes(rows: DataFrame) -> DataFrame:
    """``size, cell, n, lo, hi`` over all rows: partial boxes by task, then one row a cell."""
    shape = "size long, cell long, n long, lo array<long>, hi array<long>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            for own, points in _matrices(batch.column("v")):
                order = np.argsort(cell[own], kind="stable")
                cells, start, count = np.unique(cell[own][order], return_index=True, return_counts=True)
                lo, hi = np.minimum.reduceat(points[order], start), np.maximum.reduceat(points[order], start)
                for i, c in enumerate(cells.tolist()):
                    key = (points.shape[1], c)
                    old = held.get(key)
                    held[key] = [count[i], lo[i], hi[i]] if old is None else [old[0] + count[i], np.minimum(old[1], lo[i]), np.maximum(old[2], hi[i])]
        if held:
            columns = [
                [k[0] for k in held],
                [k[1] for k in held],
                [int(x[0]) for x in held.values()],
                [x[1] for x in held.values()],
                [x[2] for x in held.values()],
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)],
                names=["size", "cell", "n", "lo", "hi"],
            )

    def whole(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            [(own["size"].iloc[0], own["cell"].iloc[0], own["n"].sum(), np.stack(own["lo"]).min(axis=0), np.stack(own["hi"]).max(axis=0))],
            columns=["size", "cell", "n", "lo", "hi"],
        )

    return rows.mapInArrow(partial, shape).groupBy("size", "cell").applyInPandas(whole, shape)


def _bounds(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with a point of each box."""
    kind = np.float64 if exact_in_double(queries, np.maximum(np.abs(lo), np.abs(hi)), queries.shape[1]) else np.int64
    q = queries.astype(kind)
    return (np.maximum(q, 0) @ hi.astype(kind).T + np.minimum(q, 0) @ lo.astype(kind).T).astype(np.int64)


class Cells:
    """The cells' boxes (CELLS of them for the common numbers of components) and numbers of shards."""

    def __init__(self, rows: list, shard_rows: int):
        self.of: dict[int, tuple[np.ndarray, ...]] = {}
        for size in sorted({r["size"] for r in rows}):
            own = sorted((r for r in rows if r["size"] == size), key=lambda r: r["cell"])
            self.of[size] = (
                np.array([r["cell"] for r in own]),
                np.array([-(-r["n"] // shard_rows) for r in own]),
                np.array([r["lo"] for r in own]),
                np.array([r["hi"] for r in own]),
            )


def _visits(queries: DataFrame, cells: Cells, first: bool) -> DataFrame:
    """``size, cell, part, query_id, v, cut`` of the shards that each query visits: first one of the most promising cell, then
    all others of the cells whose bound reaches the cut."""
    held = queries.sparkSession.sparkContext.broadcast(cells)
    shape = pa.schema([
        ("size", pa.int64()),
        ("cell", pa.int64()),
        ("part", pa.int64()),
        ("query_id", pa.int64()),
        ("v", pa.list_(pa.int64())),
        ("cut", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for at in range(0, large.num_rows, 512):
                batch = large.slice(at, 512)
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], names=batch.schema.names)
                cut, ids = batch.column("cut"), batch.column("query_id").to_numpy()
                for own, points in _matrices(batch.column("v")):
                    cell, parts, lo, hi = held.value.of[points.shape[1]]
                    bound = _bounds(points, lo, hi)
                    home = bound.argmax(axis=1)
                    # the home part is a hash of the query
                    part = ((ids[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts[home]
                    if first:
                        row, where, which = np.arange(len(own)), home, part
                    else:
                        least = np.array([-(1 << 63) if x is None else x for x in cut.take(pa.array(own)).to_pylist()], np.int64)
                        row, where = np.nonzero(bound >= least[:, None])
                        n = parts[where]
                        row, where, which = np.repeat(row, n), np.repeat(where, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        on = (where != home[row]) | (which != part[row])
                        row, where, which = row[on], where[on], which[on]
                    take = pa.array(own[row])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(row), points.shape[1])),
                            pa.array(cell[where]),
                            pa.array(which),
                            *[batch.column(c).take(take) for c in ("query_id", "v", "cut")],
                        ],
                        schema=shape,
                    )

    return queries.mapInArrow(run, "size long, cell long, part long, query_id long, v array<long>, cut long")


_OUT = "query_id long, v array<long>, vec_id long, score long"


def _searched(k: int):
    """Shards' rows, each followed by its queries, to the best rows of every query."""
    shape = pa.schema([("query_id", pa.int64()), ("v", pa.list_(pa.int64())), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, ids, points = None, None, [], []
        for batch in batches:
            key = list(zip(*[batch.column(c).to_pylist() for c in ("size", "cell", "part", "block")], strict=True))
            out: list[tuple] = []
            vectors = batch.column("v")
            for i, (own, asks, who, cut) in enumerate(zip(
                key,
                batch.column("asks").to_pylist(),
                batch.column("id").to_pylist(),
                batch.column("cut").to_pylist(),
                strict=True,
            )):
                if own != shard:
                    shard, tree, ids, points = own, None, [], []
                vector = vectors[i].values.to_numpy()
                if not asks:
                    ids.append(who)
                    points.append(vector)
                    continue
                if tree is None and ids:
                    stacked = np.stack(points)
                    tree = Tree(np.array(ids), stacked.astype(np.float64) if exact_in_double(stacked, stacked, stacked.shape[1]) else stacked)
                    points = []
                if tree is not None:
                    used = tree
                    if tree.points.dtype == np.float64 and not exact_in_double(vector, tree.points, len(vector)):
                        used = tree.as_integers()
                    out += [(who, vector, found, score) for score, found in used.search(who, vector.astype(used.points.dtype), k, -np.inf if cut is None else cut)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    return run


def top_k(vectors: DataFrame, is_query, *, k: int = 5, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that meet the condition ``is_query`` (a Column), against all rows."""
    rows = stored(integral(vectors, scale=scale))
    # of rows that are alike in all, k are as good as any number, and one more where one of them asks
    alike = rows.groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k + 1)).cast("int").alias("copies"))
    own = stored(alike.select("vec_id", "v", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy"))
    n = own.count()
    chosen = sampled(own, SAMPLE, "vec_id", "v").select("v").toArrow()  # SAMPLE rows at most
    sample = {v.shape[1]: v for _, v in _matrices(pa.concat_arrays(chosen.column("v").chunks))} if chosen.num_rows else {}
    base = stored(_in_cells(own, Splits(sample, min(CELLS, -(-n // shard_rows)))))
    cells = Cells(_boxes(base).collect(), shard_rows)  # CELLS rows, and one for each number of components that the sample lacks
    parts = rows.sparkSession.createDataFrame(
        [(size, int(c), int(p)) for size, own in cells.of.items() for c, p in zip(own[0], own[1], strict=True)],
        "size long, cell long, parts long",
    )
    base = base.join(F.broadcast(parts), ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).drop("parts")
    # rows that are alike are one query, answered as often as there are rows
    queries = rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.count("*").alias("times"))
    queries = stored(queries)

    def visit(asked: DataFrame) -> DataFrame:
        asked = stored(asked)
        blocks = asked.groupBy("size", "cell", "part").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks"))
        few = blocks.count() <= BROADCAST_ROWS
        blocks = F.broadcast(blocks) if few else blocks
        key = ["size", "cell", "part"]
        candidates = base.join(blocks, key).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        mine = asked.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.col("blocks")))
        both = candidates.select(*key, "block", F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("long").alias("cut"))
        both = both.unionByName(mine.select(*key, "block", F.lit(1).alias("asks"), F.col("query_id").alias("id"), "v", "cut"))
        return both.repartition(*key, "block").sortWithinPartitions(*key, "block", "asks").mapInArrow(_searched(k), _OUT)

    first = checkpointed(visit(_visits(queries.select("query_id", "v", F.lit(None).cast("long").alias("cut")), cells, first=True)))
    cuts = first.groupBy("query_id", "v").agg(F.when(F.count("*") >= k, F.min("score")).alias("cut"))
    rest = visit(_visits(queries.drop("times").join(cuts, ["query_id", "v"], "left").select("query_id", "v", "cut"), cells, first=False))
    order = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    best = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(queries, ["query_id", "v"]).withColumn(
        "time",
        F.explode(F.sequence(F.lit(1).cast("long"), "times")),
    ).select("query_id", "rank", "vec_id", "score")
