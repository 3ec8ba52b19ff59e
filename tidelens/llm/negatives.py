"""Hard negatives: a kNN join over Voronoi cells of vectors that a further side makes equally long."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType
from pyspark.sql.window import Window

from tidelens.llm.common import cut
from tidelens.llm.nearest import _EXACT, _by_length, _matrix

#: Pivots of each length of vectors, and lengths that have pivots, at most. Every pivot is a row of the sample.
PIVOTS, LENGTHS = 256, 16
#: Rows of the sample, at most: pivots are chosen from it, and first bounds of scores come from it.
SAMPLE = 2048
#: Scores that a task holds at once.
_SCORES = 4_000_000
#: What a bound on a distance gives way, relative to the largest length, as distances round.
_SLACK = 1e-6


class Space:
    """Where vectors of one length lie: pivots, and the length that the further side brings every vector up to.

    With that side, sqrt(longest^2 - |x|^2) for a candidate and 0 for an anchor, the squared distance of an anchor q and
    a candidate x is |q|^2 + longest^2 - 2qx: the larger the inner product, the nearer. Pivots have the further side of
    anchors, so that anchors lie near their pivots.
    """

    def __init__(self, sample: np.ndarray, longest: float, pivots: int) -> None:
        self.longest = longest
        own = self.lifted(sample, anchors=True)
        at = [0]
        apart = ((own - own[0]) ** 2).sum(1)
        while len(at) < min(pivots, len(own)) and apart.max() > 0:  # the farthest from those there are
            at.append(int(apart.argmax()))
            apart = np.minimum(apart, ((own - own[at[-1]]) ** 2).sum(1))
        self.pivots = own[at]
        self.apart = self._distances(self.pivots)

    def lifted(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        side = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return np.column_stack([x, side])

    def _distances(self, lifted: np.ndarray) -> np.ndarray:
        squares = (lifted**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """From each of some vectors to each pivot."""
        return self._distances(self.lifted(x, anchors))

    def far(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from anchors candidates of these scores are."""
        return np.sqrt(np.maximum((q**2).sum(1) + self.longest**2 - 2 * score, 0))


class Groups:
    """Groups of anchors of one length, each of cells next to each other: for each cell how far its anchors lie from its pivot, and
    between which distances from the anchors candidates can serve them."""

    def __init__(self, space: Space, rows: dict[int, tuple[int, float, float, float]], most: int) -> None:
        """rows: by cell, how many anchors, the radius, the least and the largest distance asked for."""
        self.space, self.cells = space, np.array(sorted(rows), np.int64)
        self.radius, self.low, self.high = (np.array([rows[c][i] for c in self.cells]) for i in (1, 2, 3))
        self.group, self.count, held = np.zeros(len(self.cells), np.int64), 0, 0
        left = list(range(len(self.cells)))
        at = 0
        while left:  # from each cell to the nearest that has no group yet
            n = rows[int(self.cells[at])][0]
            if held and held + n > most:
                self.count, held = self.count + 1, 0
            self.group[at], held = self.count, held + n
            left.remove(at)
            if left:
                at = min(left, key=lambda i: space.apart[self.cells[at], self.cells[i]])
        self.count += len(self.cells) > 0
        self.of_cell = dict(zip(self.cells.tolist(), self.group.tolist(), strict=True))

    def served(self, x: np.ndarray) -> np.ndarray:
        """For each candidate and group, whether it may serve an anchor there.

        By the triangle's rule an anchor of a cell lies within the radius of its pivot, so no nearer to the candidate than
        the candidate's distance from the pivot less the radius, and no farther than that and the radius. As each
        anchor is nearer to its own pivot than to any other, it lies beyond the plane between that and the pivot nearest to the candidate.
        """
        d = self.space.distances(x)
        own = d.argmin(1)
        to = d[:, self.cells]
        between = self.space.apart[own][:, self.cells]
        wide = between > 1e-3 * self.space.longest  # of nearer pivots the plane is not known well enough
        plane = np.where(wide, (to**2 - d[np.arange(len(x)), own][:, None] ** 2) / np.where(wide, 2 * between, 1), -np.inf)
        slack = _SLACK * (1 + self.space.longest + self.radius)
        good = (np.maximum(to - self.radius, plane) <= self.high + slack) & (to + self.radius >= self.low - slack)
        out = np.zeros((len(x), self.count), bool)
        for g in range(self.count):
            out[:, g] = good[:, self.group == g].any(1)
        return out


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores among those allowed, ties to what comes first; candidates are in the order of ids."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        s = scores[at]
        kth = np.partition(s, len(s) - k)[len(s) - k]
        above = at[s > kth]
        at = np.concatenate([above, at[s == kth][: k - len(above)]])
    return at[np.lexsort((ids[at], -scores[at]))]


_FOUND = "a long, request int, vec_id long, label string, score long"
#: What an anchor asks for: rows of its own label or of others, with scores from low to high, the k best.
_ASKS = "array<struct<request: int, same: boolean, low: double, high: double, k: int>>"


def _joined(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    """The best candidates here for each request of each anchor."""
    out: dict[str, list] = {"a": [], "request": [], "vec_id": [], "label": [], "score": []}
    if anchors.num_rows and candidates.num_rows:
        candidates = candidates.sort_by("vec_id")
        n, m = candidates.num_rows, anchors.num_rows
        v, q = _matrix(candidates["v"], n), _matrix(anchors["v"], m)
        exact = np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * v.shape[1] < _EXACT
        if not exact:  # whole numbers of any size, slowly
            v, q = (np.frompyfunc(int, 1, 1)(x) for x in (v, q))
        ids, copies = candidates["vec_id"].to_numpy(), candidates["copies"].to_numpy()
        labels = np.array(candidates["label"].to_pylist(), object)
        rows = zip(*(anchors[c].to_pylist() for c in ("a", "anchor_id", "label", "asks")), strict=True)
        step = max(1, _SCORES // n)
        block = np.zeros((0, n))
        for i, (a, own_id, label, asks) in enumerate(rows):
            if i % step == 0:
                block = q[i : i + step] @ v.T
            scores, same = block[i % step], labels == label
            # one row of the anchor's id, vector and label is itself
            mine = [j for j in range(np.searchsorted(ids, own_id), np.searchsorted(ids, own_id, "right")) if same[j] and np.array_equal(v[j], q[i])]
            for ask in asks:
                allowed = (same if ask["same"] else ~same) & (scores >= ask["low"]) & (scores <= ask["high"])
                if ask["same"] and mine and copies[mine[0]] == 1:
                    allowed[mine[0]] = False
                for j in _best(scores, ids, allowed, ask["k"]):
                    times = min(int(copies[j]) - (ask["same"] and j in mine[:1]), ask["k"])
                    out["a"] += [a] * times
                    out["request"] += [ask["request"]] * times
                    out["vec_id"] += [int(ids[j])] * times
                    out["label"] += [labels[j]] * times
                    out["score"] += [max(-(2**63), min(2**63 - 1, int(scores[j])))] * times
    kinds = {"a": pa.int64(), "request": pa.int32(), "vec_id": pa.int64(), "label": pa.string(), "score": pa.int64()}
    return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})


def _raised(label: str, own_id: int, q: np.ndarray, sample: tuple[np.ndarray, np.ndarray, np.ndarray], asks: list[dict]) -> list[dict]:
    """The requests, with low raised to the kth best score that the sample has for them: the k best score no less."""
    ids, labels, v = sample
    scores, same = v @ q, labels == label
    me = same & (ids == own_id) & (v == q).all(1)
    out = []
    for ask in asks:
        good = scores[(same & ~me if ask["same"] else ~same) & (scores >= ask["low"]) & (scores <= ask["high"])]
        at = len(good) - ask["k"]
        # where sums round, the score may be a little less
        out.append(ask if at < 0 else ask | {"low": max(ask["low"], float((kth := np.partition(good, at)[at]) - 1e-9 * abs(kth)))})
    return out


def _numbers(of: dict[tuple[int, int], int]) -> Column:
    """The number of a row's size and group, 1 where there is none."""
    key = F.when(F.col("group") < 0, F.lit(-1).cast("long")).otherwise(F.col("size") * F.lit(2**31) + F.col("group"))
    known = F.create_map(*(F.lit(x) for (size, group), n in (of or {(-1, -2): 1}).items() for x in (-1 if group < 0 else size * 2**31 + group, max(1, n)))).cast("map<bigint, int>")
    return F.coalesce(F.try_element_at(known, key), F.lit(1))


class _Search:
    """Candidates by id, vector and label, and what all searches among them need: the sample, pivots by length."""

    def __init__(self, points: DataFrame, sample_rows: int, pivots: int, block_rows: int, part_rows: int) -> None:
        self.points, self.block_rows, self.part_rows = points, block_rows, part_rows
        self.rows = points.count()
        order = F.pmod(F.xxhash64("vec_id", "v", "label"), F.lit(max(1, self.rows // sample_rows)))
        # the share of rows that the hash gives is about sample_rows; the limit bounds what comes to the driver
        taken = points.filter(order == 0).select("vec_id", "label", "v").limit(2 * sample_rows).collect()
        longest = {r["size"]: float(r.longest) for r in points.groupBy("size").agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest"), F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(LENGTHS).collect()}
        self.samples: dict[int, tuple] = {}
        self.spaces: dict[int, Space] = {}
        for size, square in longest.items():
            own = sorted((r.vec_id, r.label, r.v) for r in taken if len(r.v) == size)
            if own and math.isfinite(square):
                v = np.array([r[2] for r in own])
                self.samples[size] = (np.array([r[0] for r in own]), np.array([r[1] for r in own], object), v)
                self.spaces[size] = Space(v, math.sqrt(square), pivots)

    def with_bounds(self, asked: DataFrame) -> DataFrame:
        """Anchors with asks raised by the sample, their cell, and what of the cell's bounds is theirs."""
        samples, spaces, others = self.samples, self.spaces, [c for c in asked.columns if c != "asks"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asks, ids, labels = batch["asks"].to_pylist(), batch["anchor_id"].to_pylist(), batch["label"].to_pylist()
                cell, bounds = np.full(batch.num_rows, -1, np.int32), np.zeros((3, batch.num_rows))
                for rows, q in _by_length(batch):
                    size = q.shape[1]
                    if size not in spaces:
                        continue
                    d = spaces[size].distances(q, anchors=True)
                    cell[rows], bounds[0, rows] = d.argmin(1), d.min(1)
                    for k, i in enumerate(rows):
                        asks[i] = _raised(labels[i], ids[i], q[k], samples[size], asks[i])
                    low, high = (np.array([f(a[x] for a in asks[i]) for i in rows]) for f, x in ((min, "low"), (max, "high")))
                    bounds[1, rows], bounds[2, rows] = spaces[size].far(q, high), spaces[size].far(q, low)
                columns = [*(batch[c] for c in others), pa.array(asks, batch.schema.field("asks").type), pa.array(cell), *map(pa.array, bounds)]
                yield pa.RecordBatch.from_arrays(columns, [*others, "asks", "cell", "radius", "from_far", "to_far"])

        schema = StructType([*(asked.schema[c] for c in others), asked.schema["asks"]])
        for name, kind in (("cell", "integer"), ("radius", "double"), ("from_far", "double"), ("to_far", "double")):
            schema = schema.add(name, kind)
        return asked.mapInArrow(run, schema)

    def best(self, asked: DataFrame) -> DataFrame:
        """a, request, place (from 1), vec_id, label and score: the best candidates for each request of anchors
        (a, anchor_id, label, v, size, asks)."""
        asked = cut(self.with_bounds(asked))
        by_size: dict[int, dict] = {}
        summary = asked.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.min("from_far").alias("low"), F.max("to_far").alias("high"))
        for r in summary.filter("cell >= 0").collect():  # as many rows as there are pivots, at most
            by_size.setdefault(r["size"], {})[r.cell] = (r.n, r.radius, r.low, r.high)
        groups = {size: Groups(self.spaces[size], rows, self.block_rows) for size, rows in by_size.items()}

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [groups[s].of_cell[c] if c >= 0 else -1 for s, c in zip(batch["size"].to_pylist(), batch["cell"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "group"])

        def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                reach: list[list[int]] = [[-1]] * batch.num_rows
                for rows, v in _by_length(batch):
                    if v.shape[1] in spaces:  # of lengths without pivots all meet
                        served = groups[v.shape[1]].served(v) if v.shape[1] in groups else np.zeros((len(v), 0), bool)
                        for i, g in zip(rows, served, strict=True):
                            reach[i] = np.flatnonzero(g).tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach, pa.list_(pa.int32()))], [*batch.schema.names, "reach"])

        spaces = self.spaces
        anchors = asked.mapInArrow(placed, StructType([*asked.schema]).add("group", "integer")).select("a", "anchor_id", "label", "v", "size", "asks", "group")
        sent = cut(self.points.mapInArrow(reaching, StructType([*self.points.schema]).add("reach", ArrayType(IntegerType()))))
        # a group's candidates are dealt into parts by hash, and its anchors into blocks, so no task has all of a group;
        # groups are some hundreds for each length that has pivots, and one for all others
        known = F.when(F.col("group") < 0, -1).otherwise(F.col("size")).alias("known")
        met = sent.select("size", F.explode("reach").alias("group")).groupBy(known, "group").count().collect()
        parts = _numbers({(r.known, r.group): -(-r["count"] // self.part_rows) for r in met})
        blocks = _numbers({(r.known, r.group): -(-r["count"] // self.block_rows) for r in anchors.groupBy(known, "group").count().collect()})
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        c = sent.select("vec_id", "v", "label", "copies", "size", F.explode("reach").alias("group"))
        c = c.withColumn("part", F.pmod(F.xxhash64("vec_id", "v", "label"), parts).cast("int")).withColumn("block", every(blocks))
        q = anchors.withColumn("block", F.pmod(F.xxhash64("a"), blocks).cast("int")).withColumn("part", every(parts))
        key = ["size", "group", "part", "block"]
        found = q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(_joined, _FOUND)
        order = Window.partitionBy("a", "request").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("place", F.row_number().over(order))


def labelled(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label (as text) and v: each component times `scale`, rounded down. Rows take no part whose id, label or vector is null, or
    whose vector is empty or has a component that is null or not finite."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.when(F.size(vector) > 0, F.when(~bad, x)).alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null")
    return rows.withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("double")))


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    pivots: int = PIVOTS, sample_rows: int = SAMPLE, block_rows: int = 1024, part_rows: int = 8192,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score, all exact.

    vectors and anchors (which are rows of vectors): vec_id, label and v, of whole numbers, as labelled() makes them. A
    score is the inner product; higher ones come first, ties by the smaller id. An anchor's positives are its first
    `positives` other rows of its label. For each of them, the negatives are the first `negatives` rows of other labels
    with scores from low to high percent of the positive's. Fewer rows give fewer; a positive without any gives none.

    Two searches, each a join over Voronoi cells. Vectors get a further side that makes all equally long, so the largest inner products are the
    smallest distances. Pivots come from a sample. An anchor lies in the cell of its nearest pivot; the kth best score
    of the sample tells how far the k best candidates can be away, and so, for each cell, between which distances from
    its anchors candidates serve. Cells next to each other form groups of about block_rows anchors, and a candidate is
    sent only to the groups that it may serve, by its distances from pivots and from the planes between them. There
    anchors and candidates are compared in full, in blocks of up to about block_rows anchors and parts of about part_rows
    candidates. The second search asks for each positive's range of scores. To the driver come the sample and one row for
    each cell. Vectors of a length without pivots (LENGTHS lengths have some) all meet those of their length.

    Rows of equal id, label and vector are brought down to one with a number of copies: each copy is a candidate, and an anchor of
    its own, for whom the other copies are positives like others. Vectors of another length than the anchor's do not
    meet it. Scores beyond 64 bits count as the nearest number that fits. Empty tables give an empty one.
    """
    points = cut(vectors.groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies")).withColumn("size", F.size("v")))
    search = _Search(points, sample_rows, pivots, block_rows, part_rows)
    asked = anchors.groupBy(F.col("vec_id").alias("anchor_id"), "label", "v").agg(F.count("*").alias("times")).withColumn("size", F.size("v"))
    asked = cut(asked.withColumn("a", F.monotonically_increasing_id()))
    infinite = F.lit(math.inf)
    ask = lambda request, same, a, b, k: F.struct(request.cast("int").alias("request"), F.lit(same).alias("same"), a.cast("double").alias("low"), b.cast("double").alias("high"), F.lit(k).alias("k"))
    first = asked.select("a", "anchor_id", "label", "v", "size", F.array(ask(F.lit(0), True, -infinite, infinite, positives)).cast(_ASKS).alias("asks"))
    liked = cut(search.best(first).filter(F.col("place") <= positives).select("a", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    exact = F.col("positive_score").cast("decimal(24,0)")
    # a positive's range holds whole numbers only where its score is none below 0
    ranges = liked.filter("positive_score >= 0").groupBy("a").agg(F.sort_array(F.collect_list(ask(F.col("place"), False, F.ceil(exact * low / 100), F.floor(exact * high / 100), negatives))).cast(_ASKS).alias("asks"))
    second = asked.select("a", "anchor_id", "label", "v", "size").join(ranges, "a")
    found = search.best(second).filter(F.col("place") <= negatives).select("a", F.col("request").alias("of"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    rows = found.join(liked.withColumnRenamed("place", "of"), ["a", "of"]).join(asked.select("a", "anchor_id", "times"), "a")
    return rows.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", each.alias("time")).drop("time")
