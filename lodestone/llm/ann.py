"""Nearest neighbours by cosine: stable projections, kd-trees, and a chi-square stopping test.

Vectors are brought to length 1, so that the largest cosine is the smallest
distance, and projected on a few random Gaussian (2-stable) directions. A
projected squared distance, over the true one, follows a chi-square law. A
kd-tree of the projected points, fitted on a bounded sample, deals all rows to
cells; each cell's points are indexed by a kd-tree of their own. A query visits
cells, and inside them leaves, in order of their projected distance and
verifies the vectors found there. It stops when a vector as near as its k-th
best so far would, with probability ``sure``, have projected nearer than
anything that is left.

Queries travel to cells in rounds: the nearest cell, a few more, and then all
that the test still leaves open; each round knows the k-th best of the ones
before. Where the vectors have no structure the test leaves most cells open,
and most vectors are verified.

Equal vectors are one entry of the index; only the members that can be among k
nearest (the k + 1 smallest ids) stand behind it, which changes no result.
Vectors that are null, empty, zero, or hold null or non-finite components, or
have a null id, take no part; vectors of unlike lengths are never compared.
Components of any magnitude are scaled by a power of two first, so no square
is lost. An empty table gives an empty result; other columns are never looked
at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import stored

DIRECTIONS, LEAF, SURE = 8, 64, 0.95
#: Rows of a cell, and projected rows that the tree of cells is fitted on, at most.
CELL_ROWS, SAMPLE_ROWS = 16_384, 65_536
#: Cells that a query has visited after each round but the last.
ROUNDS = (1, 8)


def chi_square(x: np.ndarray, m: int) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.maximum(x, 0) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


class Tree:
    """A kd-tree cut at medians of the widest side; leaves keep their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        open_ = [(0, len(points))]
        while open_:
            a, b = open_.pop()
            own = self.order[a:b]
            if b - a <= leaf:
                self.leaves.append((a, b))
                continue
            side = np.ptp(points[own], axis=0).argmax()
            mid = (b - a) // 2
            self.order[a:b] = own[np.argpartition(points[own, side], mid)]
            open_ += [(a, a + mid), (a + mid, b)]
        self.low = np.array([points[self.order[a:b]].min(0) for a, b in self.leaves])
        self.high = np.array([points[self.order[a:b]].max(0) for a, b in self.leaves])

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf whose box is nearest, for each point; of equals the first."""
        out = np.empty(len(points), np.int32)
        for i in range(0, len(points), 256):
            out[i : i + 256] = boxes_apart(self.low, self.high, points[i : i + 256]).argmin(1)
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances from one point to all leaves' boxes."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


def boxes_apart(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances from points (rows) to boxes (columns)."""
    gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0)
    return np.einsum("ijk,ijk->ij", gap, gap)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose largest component lies in [0.5, 1): a power of two is taken out of each, which rounds nothing."""
    _, power = np.frexp(np.abs(vectors).max(1))
    return np.ldexp(vectors, -power[:, None])


def projected(vectors: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and their projections."""
    vectors = scaled(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return unit, unit @ np.random.default_rng(seed).normal(size=(vectors.shape[1], m))


def search(vectors: np.ndarray, queries: np.ndarray, k: int, m: int, sure: float, seed: int, within: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Row numbers of at least the k nearest found, for each query; of those nearer than the squared distance ``within`` only."""
    unit, points = projected(vectors, m, seed)
    tree = Tree(points)
    del points
    # vectors in the order of the leaves, so that a leaf is a slice
    unit = unit[tree.order]
    start, end = np.array(tree.leaves).T
    stop = _quantile(sure, m)
    within = np.full(len(queries), np.inf) if within is None else within
    for q, p, most in zip(*projected(queries, m, seed), within):
        near = tree.distances(p)
        leaves = np.argsort(near, kind="stable")
        best, rows = np.zeros(0), np.zeros(0, np.int64)
        at, width = 0, 4
        while at < len(leaves):
            if near[leaves[at]] >= stop * max(min(best[k - 1] if len(best) >= k else np.inf, most), 0):
                break
            some = leaves[at : at + width]
            at, width = at + width, min(64, width * 2)
            size = end[some] - start[some]
            far = 2 - 2 * np.concatenate([unit[slice(*tree.leaves[i])] @ q for i in some.tolist()])
            some = np.repeat(start[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
            # what ties with the k-th, up to rounding, stays
            keep = far <= min(best[k - 1] if len(best) >= k else np.inf, most) + 1e-9
            some, far = some[keep], far[keep]
            rows, best = np.concatenate([rows, some]), np.concatenate([best, far])
            order = np.argsort(best, kind="stable")
            rows, best = rows[order], best[order]
            if len(best) > k:
                n = np.searchsorted(best, best[k - 1] + 1e-9, "right")
                rows, best = rows[:n], best[:n]
        yield tree.order[rows]


def _quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array([mid]), m)[0] < p else (low, mid)
    return high


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in one fixed order of additions: equal vectors get equal values."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Cells:
    """Boxes of the projected points of each length of vectors: cells are numbered anew for each length."""

    def __init__(self, samples: dict[int, np.ndarray], rows: dict[int, int], cell_rows: int):
        self.trees = {}
        for size, points in samples.items():
            cells = max(1, min(math.ceil(rows[size] / cell_rows), len(points) // 32))
            self.trees[size] = Tree(points, max(1, math.ceil(len(points) / cells)))

    def of(self, size: int, points: np.ndarray) -> np.ndarray:
        """Vectors of a length that the sample hasn't seen have one cell."""
        return self.trees[size].cell_of(points) if size in self.trees else np.zeros(len(points), np.int32)


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding",
    directions: int = DIRECTIONS, sure: float = SURE, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS, seed: int = 0,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: up to ``k`` nearest of each query, rows with its own id excepted.

    ``sure`` is the chance that a true neighbour is found, at least. Ties go to
    the smaller id. Rows with one id and one vector count as one; each row of
    the queries has an answer of its own, also where rows share an id. The tree
    of cells is fitted on ``sample_rows`` rows at most; all rows are indexed.
    """
    spark = vectors.sparkSession

    def ready(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def place(frames: Iterator[pd.DataFrame], cells: Cells | None = None) -> Iterator[pd.DataFrame]:
        """With the projected point ``p`` of each vector, and its cell."""
        for frame in frames:
            sizes = frame["v"].map(len)
            for size in sizes.unique():
                own = frame[sizes == size].copy()
                points = projected(np.stack(own["v"].to_numpy()).astype(float), directions, seed)[1]
                own["p"] = list(points)
                if cells:
                    own["size"], own["cell"] = size, cells.of(size, points)
                yield own

    # one entry for each distinct vector; the salt keeps a vector that very many rows share from one task
    rows = ready(vectors).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = W.partitionBy("v", "salt").orderBy("id")
    rows = rows.withColumn("nth", F.dense_rank().over(few)).where(F.col("nth") <= k + 1).groupBy("v", "salt").agg(F.collect_set("id").alias("ids"))
    index = stored(rows.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")))
    counts = {r.n: r["count"] for r in index.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count")).limit(64).collect()}
    # of a fixed size
    sample = index.select("v").orderBy(F.xxhash64(F.lit(seed), "v")).limit(sample_rows).mapInPandas(place, "v array<double>, p array<double>")
    sample = sample.select(F.size("v").alias("n"), "p").toPandas()
    points = {int(n): np.stack(own.to_numpy()) for n, own in sample.groupby("n")["p"] if n in counts}
    cells = spark.sparkContext.broadcast(Cells(points, counts, cell_rows))

    index = stored(index.mapInPandas(lambda x: place(x, cells.value), "v array<double>, ids array<long>, p array<double>, size int, cell int"))
    # of a fixed size: boxes of all cells, as the rows fill them; a cell over the size is searched in parts
    sides = [f(F.get("p", F.lit(i))).alias(f"{n}{i}") for i in range(directions) for n, f in (("low", F.min), ("high", F.max))]
    boxes = index.groupBy("size", "cell").agg(F.count("*").alias("rows"), *sides).toPandas().sort_values(["size", "cell"])
    boxes["parts"] = np.ceil(boxes["rows"] / cell_rows).astype(int)
    known = spark.sparkContext.broadcast({int(n): (own["cell"].to_numpy(), own["parts"].to_numpy(), own[[f"low{i}" for i in range(directions)]].to_numpy(), own[[f"high{i}" for i in range(directions)]].to_numpy()) for n, own in boxes.groupby("size")})
    parts = F.create_map(*[x for r in boxes[boxes["parts"] > 1].itertuples() for x in (F.lit(f"{r.size}:{r.cell}"), F.lit(r.parts))]) if (boxes["parts"] > 1).any() else None
    split = F.pmod(F.xxhash64(F.lit(seed), "v"), F.coalesce(F.element_at(parts, F.concat_ws(":", "size", "cell")), F.lit(1))) if parts is not None else F.lit(0)
    index = index.select("size", "cell", split.cast("int").alias("part"), "v", "ids")
    stop = _quantile(sure, directions)

    def open_cells(first: int, last: int | None):
        """Queries to the cells that come at places ``first`` to ``last`` by distance and that the test leaves open."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for query, own, v, most in frame[["query", "id", "v", "most"]].itertuples(index=False):
                    if len(v) not in known.value:
                        continue
                    cell, parts, low, high = known.value[len(v)]
                    near = boxes_apart(low, high, projected(np.asarray(v, float)[None], directions, seed)[1])[0]
                    some = np.argsort(near, kind="stable")[first:last]
                    for i in some[near[some] < stop * most] if most < np.inf else some:
                        out += [(len(v), int(cell[i]), part, query, own, v, most) for part in range(parts[i])]
                yield pd.DataFrame(out, columns=["size", "cell", "part", "query", "id", "v", "most"])

        return run

    def run(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, float]] = []
        if len(found) and len(wanted):
            matrix, asks = np.stack(found["v"].to_numpy()).astype(float), np.stack(wanted["v"].to_numpy()).astype(float)
            members = found["ids"].to_numpy()
            # k + 1 entries, as one may be the query itself and no other
            for query, own, vector, rows in zip(wanted["query"], wanted["id"], asks, search(matrix, asks, k + 1, directions, sure, seed, wanted["most"].to_numpy())):
                scores = cosine(matrix[rows], np.broadcast_to(vector, (len(rows), len(vector)))) if len(rows) else []
                best = sorted((-s, i) for s, r in zip(scores, rows) for i in members[r] if i != own)[:k]
                out += [(query, own, int(i), -s) for s, i in best]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"]).astype({"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})

    # a number for each row, fixed by writing it
    asked = stored(ready(queries).withColumn("query", F.monotonically_increasing_id()))
    best = None
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    edges = [0, *[n for n in ROUNDS if n < len(boxes)], None]
    key = ["size", "cell", "part"]
    for first, last in zip(edges[:-1], edges[1:]):
        if best is None:
            todo = asked.withColumn("most", F.lit(float("inf")))
        else:
            # the squared distance of the k-th best so far
            reached = best.groupBy("query").agg(F.when(F.count("*") >= k, 2 - 2 * F.min("score")).otherwise(float("inf")).alias("most"))
            todo = asked.join(reached, "query", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
        todo = todo.mapInPandas(open_cells(first, last), "size int, cell int, part int, query long, id long, v array<double>, most double")
        made = index.groupBy(*key).cogroup(todo.groupBy(*key)).applyInPandas(run, "query long, query_id long, vec_id long, score double")
        # a query has k candidates of each cell
        made = made if best is None else best.drop("rank").unionByName(made)
        best = stored(made.withColumn("rank", rank).where(F.col("rank") <= k))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
