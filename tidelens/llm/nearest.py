"""Exact top-k search by inner product: a KD-tree for each shard, best-first, with a kth score that is passed on."""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType
from pyspark.sql.window import Window

from tidelens.llm.common import cut

#: Vectors of a leaf.
LEAF = 128
#: Sums of products below this are exact in float64.
_EXACT = 2**53


class Tree:
    """Median splits along the widest side, with the tight box of every node's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray | None = None) -> None:
        self.ids, self.vectors, self.copies = ids, vectors, np.ones(len(ids), np.int64) if copies is None else copies
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        if len(ids):
            self._node(np.arange(len(ids)))
        self.boxes = (np.array(self.low), np.array(self.high))

    def _node(self, rows: np.ndarray) -> int:
        at, own = len(self.low), self.vectors[rows]
        low, high = own.min(0), own.max(0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.rows.append(None)
        side = int(np.argmax(high - low))
        if len(rows) <= LEAF or high[side] == low[side]:
            self.rows[at] = rows
            return at
        order = np.argpartition(own[:, side], len(rows) // 2)
        half = len(rows) // 2
        left = self._node(rows[order[:half]])
        self.children[at] = (left, self._node(rows[order[half:]]))
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the largest inner product that a point of the node's box can have."""
        low, high = self.boxes
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T

    def search(self, query: np.ndarray, own_id: int | None, bounds: np.ndarray, k: int, least: float) -> tuple[list[tuple[float, int]], int]:
        """The k best of this tree among those that score `least` or more: (score, id), best first, ties to smaller
        ids; and how many leaves were read. Of rows with own_id and the query's vector one is left out. The node with the
        largest bound comes next; one whose bound is below the kth score so far ends the search."""
        if not len(self.ids):
            return [], 0
        found: list[tuple[float, int]] = []  # (-score, id), sorted
        heap, read, kth = [(-bounds[0], 0)], 0, least
        while heap:
            bound, at = heappop(heap)
            if -bound < kth:
                break
            if (pair := self.children[at]) is not None:
                for child in pair:
                    if bounds[child] >= kth:
                        heappush(heap, (-bounds[child], child))
                continue
            read += 1
            rows = self.rows[at]
            scores = self.vectors[rows] @ query
            good = np.flatnonzero(scores >= kth)
            if len(good):
                ids, copies = self.ids[rows[good]], np.minimum(self.copies[rows[good]], k + 1)
                for i in np.flatnonzero(ids == own_id) if own_id is not None else ():
                    copies[i] -= np.array_equal(self.vectors[rows[good[i]]], query)
                order = np.lexsort((ids, -scores[good]))
                order = np.repeat(order, copies[order])[:k]
                found = sorted([*found, *zip((-scores[good[order]]).tolist(), ids[order].tolist(), strict=True)])[:k]
                if len(found) == k:
                    kth = max(kth, -found[-1][0])
        return [(-s, i) for s, i in found], read


class Cells:
    """Where in space shards lie: median splits of a sample, for each length of vectors that is common in it, and the
    tight box of all vectors in each cell. Vectors of other lengths are in cell -1, which has no box."""

    def __init__(self, sample: list[list[float]], rows_of_a_cell: int, lengths: int = 16) -> None:
        by_length: dict[int, list[list[float]]] = {}
        for v in sample:
            by_length.setdefault(len(v), []).append(v)
        self.splits: dict[int, tuple] = {}
        self.count = 0
        for size in sorted(by_length, key=lambda n: (-len(by_length[n]), n))[:lengths]:
            self.splits[size] = self._split(np.array(by_length[size]), rows_of_a_cell)
        self.boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _split(self, own: np.ndarray, most: int) -> tuple:
        """(side, value, what is up to it, what is beyond), or the number of a cell."""
        spread = own.max(0) - own.min(0)
        side = int(np.argmax(spread))
        if len(own) > most and spread[side] > 0:
            x = own[:, side]
            value = float(np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2])
            value = value if value < x.max() else float(x[x < value].max())
            return (side, value, self._split(own[x <= value], most), self._split(own[x > value], most))
        self.count += 1
        return (self.count - 1,)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each of some vectors of one length."""
        out = np.full(len(vectors), -1, np.int64)
        todo = [(self.splits[vectors.shape[1]], np.arange(len(vectors)))] if vectors.shape[1] in self.splits else []
        while todo:
            node, rows = todo.pop()
            if len(node) == 1:
                out[rows] = node[0]
                continue
            low = vectors[rows, node[0]] <= node[1]
            todo += [(node[2], rows[low]), (node[3], rows[~low])]
        return out

    def know(self, boxes: dict[int, dict[int, tuple[list[float], list[float]]]]) -> None:
        """boxes: for each length, those of the cells that hold anything."""
        self.boxes = {size: (np.array(list(own)), np.array([b[0] for b in own.values()]), np.array([b[1] for b in own.values()])) for size, own in boxes.items()}

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and for each query and cell the most that the inner product with a vector there can be, a little more
        where sums round. Queries of a length without cells have cell -1, which anything may be in."""
        if queries.shape[1] not in self.boxes:
            return np.array([-1]), np.full((len(queries), 1), np.inf)
        cells, low, high = self.boxes[queries.shape[1]]
        most = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        return cells, most + 1e-12 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = np.concatenate([np.asarray(x.flatten()) for x in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])] or [np.zeros(0)])
    return flat.reshape(rows, -1).astype(np.float64) if rows else np.zeros((0, 0))


_FOUND = "q long, vec_id long, score long, leaves long"


def _searched(k: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "vec_id": [], "score": [], "leaves": []}
        n, m = points.num_rows, queries.num_rows
        if n and m:
            vectors, asked = _matrix(points["v"], n), _matrix(queries["v"], m)
            largest = np.abs(vectors).max(initial=0) * np.abs(asked).max(initial=0) * vectors.shape[1]
            if largest >= _EXACT:  # whole numbers of any size, slowly
                vectors, asked = (np.frompyfunc(int, 1, 1)(x) for x in (vectors, asked))
            tree = Tree(points["vec_id"].to_numpy(), vectors, points["copies"].to_numpy())
            bounds = tree.bounds(asked)
            least = [-math.inf if x is None else x for x in queries["least"].to_pylist()]
            for q, own, row, b, floor in zip(queries["q"].to_pylist(), queries["query_id"].to_pylist(), asked, bounds, least, strict=True):
                best, read = tree.search(row, own, b, k, floor)
                for score, i in best:
                    out["q"].append(q)
                    out["vec_id"].append(i)
                    out["score"].append(max(-(2**63), min(2**63 - 1, int(score))))
                    out["leaves"].append(read)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    return run


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch, for each length of vectors."""
    sizes = batch["size"].to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, _matrix(batch["v"].take(pa.array(rows)), len(rows))


def _with_cell(rows: DataFrame, cells: Cells, home: bool) -> DataFrame:
    """Adds cell: where a vector lies, or (home) the cell that has the largest bound for it as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(batch.num_rows, -1, np.int64)
            for rows, v in _by_length(batch):
                if home:
                    known, most = cells.bounds(v)
                    found[rows] = known[most.argmax(1)]
                else:
                    found[rows] = cells.of(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("cell", "long"))


def _reached(asked: DataFrame, cells: Cells) -> DataFrame:
    """Adds reach: the cells whose bound for a query comes up to its least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = np.array([-math.inf if x is None else float(x) for x in batch["least"].to_pylist()])
            reach: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for rows, v in _by_length(batch):
                known, most = cells.bounds(v)
                for i, good in zip(rows, most >= (floor[rows] - 1e-12 * np.abs(np.nan_to_num(floor[rows], neginf=0)))[:, None], strict=True):
                    reach[i] = known[good].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach, pa.list_(pa.int64()))], names=[*batch.schema.names, "reach"])

    return asked.mapInArrow(run, StructType([*asked.schema.fields]).add("reach", ArrayType(LongType())))


def whole_parts(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 256) -> DataFrame:
    """vec_id and v: each component times `scale`, rounded down. Rows take no part whose id or vector is null, or whose
    vector is empty or has a component that is null or not finite."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.size(vector) > 0, F.when(~bad, x)).alias("v"))
    return rows.filter("vec_id is not null and v is not null").select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("double")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 4096, block_rows: int = 4096, most_cells: int = 256) -> DataFrame:
    """For each row of queries the k vectors with the largest inner product, one row equal to the query in id and vector
    left out: query_id, rank (from 1), vec_id, score; ties go to the smaller id. Fewer than k vectors give fewer rows,
    none give none.

    vectors and queries have columns vec_id and v, of whole numbers, as whole_parts() makes them; vectors of another
    length than the query's do not meet it. Rows that share an id are candidates and queries each, and of each other too.
    Scores beyond 64 bits count as the nearest number that fits.

    Equal rows become one with a number of copies. Space is split at medians of a sample (64 rows a cell, most_cells
    cells: all that the driver sees of vectors are the sample and the boxes of the cells); every vector is in one cell,
    and a cell is dealt by hash into shards of about shard_rows. Queries form blocks of about block_rows, those of cells
    next to each other together, by the cell that promises them most. A task builds the tree of one shard and searches it for one block, so its memory is bounded by
    the two. First each query searches one shard of its own cell: the kth score there is what the others have to reach,
    and only shards of cells whose box can reach it are visited.
    """
    grouped = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("size", F.size("v"))
    points = cut(grouped)
    n = points.count()
    shards = max(1, math.ceil(n / shard_rows))
    rows_wanted = 64 * min(most_cells, shards)
    hashed = F.xxhash64("vec_id", "v")
    sample = points.filter(F.pmod(hashed, F.lit(max(1, n // rows_wanted))) == 0).limit(2 * rows_wanted).select("v").collect()
    cells = Cells([list(r.v) for r in sample], max(1, math.ceil(len(sample) / min(most_cells, shards))))
    points = _with_cell(points, cells, home=False)

    sides = points.filter("cell >= 0").select("size", "cell", F.posexplode("v").alias("side", "x"))
    boxes: dict[int, dict[int, tuple[list[float], list[float]]]] = {}
    parts = {-1: shards}
    for r in sides.groupBy("size", "cell", "side").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).orderBy("size", "cell", "side").collect():
        low, high = boxes.setdefault(r["size"], {}).setdefault(r.cell, ([], []))
        low.append(r.low)
        high.append(r.high)
        parts[r.cell] = max(1, math.ceil(r.n / shard_rows))
    cells.know(boxes)
    numbers = lambda of: F.create_map(*(F.lit(x).cast("long") for pair in (of or {-2: 1}).items() for x in pair))
    parts_of = numbers(parts)
    points = points.withColumn("sub", F.pmod(hashed, parts_of[F.col("cell")]))

    asked = queries.groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.count("*").alias("times")).withColumn("size", F.size("v")).withColumn("q", F.monotonically_increasing_id())
    asked = cut(_with_cell(asked, cells, home=True))
    group, total, groups = 0, {}, {}
    for r in sorted(asked.groupBy("cell").count().collect(), key=lambda r: r.cell):  # cells next to each other share a block
        group += total.get(group, 0) > 0 and total[group] + r["count"] > block_rows
        groups[r.cell], total[group] = group, total.get(group, 0) + r["count"]
    block_parts = numbers({c: max(1, math.ceil(total[g] / block_rows)) for c, g in groups.items()})[F.col("cell")]
    block = F.struct(numbers(groups)[F.col("cell")].alias("group"), F.pmod(F.xxhash64("q", F.lit(1)), block_parts).alias("part"))
    asked = asked.withColumn("block", block).withColumn("home", F.pmod(F.hash(block), parts_of[F.col("cell")]))

    def searched(asked: DataFrame) -> DataFrame:
        shard, key = ["size", "cell", "sub"], ["size", "cell", "sub", "block"]
        pairs = asked.select(*shard, F.col("block").alias("for_block")).distinct()
        met = points.join(pairs, shard).select("vec_id", "v", "copies", *(F.col(c).alias(f"p_{c}") for c in shard), "for_block")
        return met.groupBy(*(f"p_{c}" for c in shard), "for_block").cogroup(asked.groupBy(*key)).applyInArrow(_searched(k), _FOUND)

    columns = ["q", "query_id", "v", "size", "cell", "sub", "block", "least"]
    first = cut(searched(asked.withColumn("sub", F.col("home")).withColumn("least", F.lit(None).cast("long")).select(*columns)))
    floors = first.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter((F.col("n") >= k) & (F.col("least") > -(2**63))).select("q", "least")
    reached = _reached(asked.withColumnRenamed("cell", "own").join(floors, "q", "left"), cells).withColumn("cell", F.explode("reach"))
    every_part = F.sequence(F.lit(0).cast("long"), parts_of[F.col("cell")] - 1)
    rest = searched(reached.withColumn("sub", F.explode(every_part)).filter("cell <> own or sub <> home").select(*columns))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return ranked.join(asked.select("q", "query_id", "times"), "q").select("query_id", "rank", "vec_id", "score", each.alias("time")).drop("time")
