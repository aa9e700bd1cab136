"""Approximate nearest neighbours: stable projections in kd-trees, with a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import few, stored

#: Dimensions of the projection (even, for the closed form below), and the test's confidence.
DIMS, SURE = 10, 0.98
#: Vectors of a cell, queries that meet a cell in one task, and vectors of a leaf, about; the sample that cells are fitted on, of
#: which each cell should have SHAPE vectors; and rows of a few numbers that are broadcast at most.
CELL, BLOCK, LEAF, SAMPLE, SHAPE, BROADCAST_ROWS = 16_384, 4_096, 32, 200_000, 8, 200_000
#: Cosines are found to this precision first, and then exactly.
CLOSE = 1e-9


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """Distribution function of the chi-square with an even number of degrees of freedom."""
    half = np.asarray(x, dtype=float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1000.0
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(np.array(mid), dims) < p else (lo, mid)
    return hi


def projection(width: int, dims: int, seed: int = 5) -> np.ndarray:
    """Gaussian, that is 2-stable: a projected difference is the true distance times a normal vector."""
    return np.random.default_rng(seed).normal(size=(width, dims))


def split_tree(points: np.ndarray, leaf: int) -> tuple[list[tuple[int, float]], list[np.ndarray]]:
    """A kd-tree by halves along the widest axis: splits in heap order (axis -1: none) and the leaves' row numbers."""
    depth = max(0, math.ceil(math.log2(max(1, len(points)) / leaf)))
    splits, level = [], [np.arange(len(points))]
    for _ in range(depth):
        below = []
        for rows in level:
            if len(rows) < 2:
                splits.append((-1, 0.0))
                below += [rows, rows[:0]]
                continue
            x = points[rows]
            axis = int((x.max(axis=0) - x.min(axis=0)).argmax())
            order = rows[np.argsort(x[:, axis], kind="stable")]
            half = len(order) // 2
            splits.append((axis, float(points[order[half], axis])))
            below += [order[:half], order[half:]]
        level = below
    return splits, level


def locate(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """The leaf, in order, of each point."""
    depth = (len(splits) + 1).bit_length() - 1
    axes, cuts = np.array([s[0] for s in splits] or [0]), np.array([s[1] for s in splits] or [0.0])
    at = np.zeros(len(points), dtype=np.int64)
    for d in range(depth):
        node = (1 << d) - 1 + at
        a = axes[node]
        right = (a >= 0) & (points[np.arange(len(points)), np.maximum(a, 0)] >= cuts[node])
        at = 2 * at + right
    return at


def within(low: np.ndarray, splits: list[tuple[int, float]], limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a point's row and a leaf whose box lies within the point's squared ``limit``, found from the root down."""
    depth = (len(splits) + 1).bit_length() - 1
    row, at, off = np.arange(len(low)), np.zeros(len(low), dtype=np.int64), np.zeros_like(low)
    for d in range(depth):
        axes, cuts = np.array([s[0] for s in splits[(1 << d) - 1 : (2 << d) - 1]]), np.array([s[1] for s in splits[(1 << d) - 1 : (2 << d) - 1]])
        axis = np.maximum(axes[at], 0)
        gap = low[row, axis] - cuts[at]
        right = (axes[at] >= 0) & (gap >= 0)
        # over the cut, the box is as far along its axis as the cut is
        far = off.copy()
        far[np.arange(len(row)), axis] = gap
        reach = (axes[at] >= 0) & ((far * far).sum(axis=1) <= limit[row])
        row, off, at = np.r_[row, row[reach]], np.concatenate((off, far[reach])), np.r_[2 * at + right, 2 * at[reach] + ~right[reach]]
    return row, at


def exact(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two vectors, reckoned in extended precision and rounded once, so that equal cosines come out equal."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


class Cell:
    """The vectors of a cell, in a kd-tree on their projections."""

    def __init__(self, ids: list, raw: np.ndarray, low: np.ndarray):
        _, leaves = split_tree(low, LEAF)
        leaves = [x for x in leaves if len(x)]
        order = np.concatenate(leaves)
        self.start = np.r_[0, np.cumsum([len(x) for x in leaves])]
        self.ids, self.raw, self.low = [ids[i] for i in order], raw[order], low[order]
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.raw, self.raw))
        self.lo = np.minimum.reduceat(self.low, self.start[:-1])
        self.hi = np.maximum.reduceat(self.low, self.start[:-1])

    def search(self, raw: np.ndarray, low: np.ndarray, k: int, bound: float, stop: float) -> list[tuple[float, int]]:
        """Best (cosine, id) of a query, leaves in order of projected distance, until the test says that no better one is likely.

        ``bound`` is a cosine that is known to be reached by k; ``stop`` the chi-square quantile. Equal cosines go by id.
        """
        gap = np.maximum(np.maximum(self.lo - low, low - self.hi), 0)
        far = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(far, kind="stable")
        size, best, i, step = math.sqrt(raw @ raw), [], 0, 4
        while i < len(order):
            # the squared distance of unit vectors is 2 - 2 cos
            limit = stop * max(0.0, 2 - 2 * bound) + CLOSE
            some = order[i : i + step]
            some = some[far[some] <= limit]
            if not len(some):
                break
            i, step = i + step, min(64, step * 2)
            rows = np.concatenate([np.arange(self.start[j], self.start[j + 1]) for j in some])
            diff = self.low[rows] - low
            rows = rows[np.einsum("ij,ij->i", diff, diff) <= limit]
            if not len(rows):
                continue
            cos = self.raw[rows] @ raw / (self.norm[rows] * size)
            # all that are as good as the k-th of these, however many
            least = max(bound, np.partition(cos, -k)[-k] if len(cos) > k else -1.0) - CLOSE
            for r in np.flatnonzero(cos >= least):
                score = exact(self.raw[rows[r]], raw)
                best += [(score, v) for v in self.ids[rows[r]]]
            best = sorted(set(best), key=lambda x: (-x[0], x[1]))[:k]
            if len(best) == k:
                bound = max(bound, best[-1][0])
        return best


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """``vec_id``, ``v`` and its hash ``h`` of the rows that have an id and a vector that isn't null, empty, zero or partly null or non-finite."""
    arr = F.col(vector)
    fine = F.when(
        arr.isNotNull() & (F.size(arr) > 0),
        F.forall(arr, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(arr, lambda x: x != 0),
    )
    ok = rows.where(fine & F.col("vec_id").isNotNull()).select("vec_id", arr.cast("array<double>").alias("v"))
    return ok.withColumn("h", F.xxhash64("v"))


def distinct_vectors(rows: DataFrame, vector: str, k: int) -> DataFrame:
    """``v`` and ``ids``: each different vector with its k + 1 least ids, all that any result can show of it.

    The ranks are cut off in each task before the shuffle, so a vector with very many copies is no hot group.
    """
    first = usable(rows, vector).withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return first.groupBy("h", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select("v", "ids")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", cell: int = CELL, dims: int = DIMS, sure: float = SURE, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k largest cosines found for each query.

    ``rows`` and ``queries`` have ``vec_id`` and a vector; a query's own id is no
    result of it. Vectors that are null, empty, zero or hold a null or non-finite
    component take no part, and vectors meet those of the same width only. Ties go to the smaller id. Repeated rows count once; if an id has several
    vectors, the best of them counts. Empty tables give no rows. Other columns don't matter.

    Unit vectors are projected to ``dims`` stable dimensions. Cells, the upper
    part of a kd-tree fitted on a bounded sample, are dealt to tasks, where the
    lower part indexes every vector. In the first round a query searches its own
    cell; in the second, with the k-th cosine found as a bound, the cells that the
    stopping test does not rule out: projected squared distance over true squared
    distance is chi-square, so beyond its ``sure`` quantile times the k-th squared
    distance, a better vector is left with probability 1 - ``sure`` at most.

    Equal vectors are one row of the index, and one query; a cell that still holds too many vectors is dealt in parts, each with a
    tree of its own, and the queries that visit a cell in blocks of about ``block``, which meet it in tasks of their own.
    """
    data = stored(distinct_vectors(rows, vector, k))
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width in [r["n"] for r in data.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]:
        out = out.union(_nearest(data.where(F.size("v") == width), width, usable(queries, vector).where(F.size("v") == width), k, cell, dims, sure, block))
    return out


def _nearest(data: DataFrame, width: int, queries: DataFrame, k: int, cell: int, dims: int, sure: float, block: int) -> DataFrame:
    matrix, total, stop = projection(width, dims), data.count(), quantile(sure, dims)

    def project(raw: np.ndarray) -> np.ndarray:
        # scaled first, as squares of very large or small components would leave the range of a double
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
        return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None] @ matrix

    def vectors(column) -> np.ndarray:
        return np.array(column.to_pylist(), dtype=float).reshape(-1, width)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(project(vectors(b.column("v")))), pa.list_(pa.float64()))], ["low"])

    part = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.2 * SAMPLE / total)) + 1
    sample = data.select("v").where(part).limit(SAMPLE).mapInArrow(projected, "low array<double>").toArrow()
    points = np.array(sample["low"].to_pylist(), dtype=float).reshape(-1, dims)
    cells = max(1, min(total // cell, len(points) // SHAPE))
    splits, _ = split_tree(points, max(1.0, len(points) / cells))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(locate(project(vectors(b.column("v"))), splits)), b.column("ids"), b.column("v")], ["cell", "ids", "v"])

    placed = data.mapInArrow(put, "cell long, ids array<long>, v array<double>")
    parts = stored(placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * cell)).alias("parts")))
    placed = stored(placed.join(few(parts, BROADCAST_ROWS), "cell").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts"))).drop("parts"))

    # a vector that many queries share is searched for once, under the least of their ids
    asked = stored(queries.select(F.col("vec_id").alias("query_id"), "h", "v").distinct())
    given = stored(asked.groupBy("h", "v").agg(F.min("query_id").alias("q")))

    def reach(batches: Iterator[pa.RecordBatch], home: bool) -> Iterator[pa.RecordBatch]:
        """The cells that a query visits."""
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                low = project(vectors(some.column("v")))
                own = locate(low, splits)
                if home:
                    row, to, bound = np.arange(len(low)), own, np.full(len(low), -1.0)
                else:
                    bound = np.array(some.column("bound").to_pylist(), dtype=float)
                    row, to = within(low, splits, stop * np.maximum(0, 2 - 2 * bound) + CLOSE)
                    row, to = row[to != own[row]], to[to != own[row]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to), some.column("q").take(pa.array(row)), some.column("v").take(pa.array(row)), pa.array(bound[row])], ["cell", "q", "v", "bound"])

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            raw = vectors(left["v"])
            tree = Cell(left["ids"].to_pylist(), raw, project(raw))
            q = vectors(right["v"])
            for x, low, own, bound in zip(q, project(q), right["q"].to_pylist(), right["bound"].to_pylist(), strict=True):
                out += [(own, v, c) for c, v in tree.search(x, low, k + 1, bound, stop)]
        return pa.table({"q": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    def visit(visits: DataFrame) -> DataFrame:
        """Queries, in blocks, meet the cells that they visit."""
        visits = stored(visits)
        blocks = visits.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks")).join(parts, "cell")
        sized = few(stored(blocks), BROADCAST_ROWS)
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = placed.join(sized.drop("parts"), "cell").withColumn("block", each("blocks")).drop("blocks")
        right = visits.join(sized, "cell").withColumn("part", each("parts")).withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks"))).drop("parts", "blocks")
        key = ["cell", "part", "block"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "q long, vec_id long, score double")

    schema = "cell long, q long, v array<double>, bound double"
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    first = visit(given.mapInArrow(lambda b: reach(b, True), schema)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    first = stored(first)
    known = first.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).otherwise(-1.0).alias("bound"))
    again = given.join(known, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0)))
    found = first.union(visit(again.mapInArrow(lambda b: reach(b, False), schema)))
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    # k + 1 for each vector are k and the query's own
    named = asked.select("query_id", "h", "v").join(given, ["h", "v"]).select("query_id", "q").join(found, "q").where("query_id <> vec_id")
    named = named.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = named.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_projected_tree(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0), 5)
