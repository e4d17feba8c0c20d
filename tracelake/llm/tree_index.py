"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample and every row is indexed under its leaf. A query walks the
tree best bin first: it descends to the nearest child, keeps the other children in a priority
queue by distance, and goes on from the nearest one left, so leaves come in a fixed order of
promise. How many leaves are visited is widened until the recall of calibration queries, whose
true neighbours over all rows are known, reaches the target. Distances within the visited leaves
are exact.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import carried, stored
from tracelake.llm.vectors import dimension, kmeans, matrix, packed, sample, squared, unpack, valid

#: Rows of a pack; the largest number of queries in a bundle.
PACK, QUERIES = 1024, 512
FOUND = "query_id bigint, vec_id bigint, score double, cell int"


@dataclass
class Tree:
    """Inner nodes: centres of the children and their numbers (leaves are -1 - leaf number)."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    def grow(self, data: np.ndarray, branch: int, leaf: int, seed: int = 1) -> int:
        centres, nearest = kmeans(data, branch, seed=seed) if len(data) > leaf else (data[:1], np.zeros(len(data), int))
        if len(centres) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(centres)
        self.children.append([])
        self.children[node] = [self.grow(data[nearest == c], branch, leaf, seed + 1) if (nearest == c).any() else self.empty() for c in range(len(centres))]
        return node

    def empty(self) -> int:
        self.leaves += 1
        return -self.leaves

    def assign(self, data: np.ndarray) -> np.ndarray:
        """Leaf number of each row: the nearest child all the way down."""
        leaf = np.zeros(len(data), np.int32)
        waiting = [(0, np.arange(len(data)))] if self.centres else []
        while waiting:
            node, rows = waiting.pop()
            near = squared(data[rows], self.centres[node]).argmin(1)
            for c, child in enumerate(self.children[node]):
                mine = rows[near == c]
                if len(mine) and child < 0:
                    leaf[mine] = -1 - child
                elif len(mine):
                    waiting.append((child, mine))
        return leaf

    def visit(self, row: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of the best-bin-first walk of one query."""
        if not self.centres:
            return [0]
        bins, order, made = [(0.0, 0, 0)], [], 0
        while bins and len(order) < most:
            _, _, node = heapq.heappop(bins)
            while node >= 0:
                distances = squared(row[None], self.centres[node])[0]
                best = int(distances.argmin())
                for c, child in enumerate(self.children[node]):
                    if c != best:
                        made += 1
                        heapq.heappush(bins, (float(distances[c]), made, child))
                node = self.children[node][best]
            order.append(-1 - node)
        return order


def nearest(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, distance) of the k nearest candidates of each query, ties to smaller ids."""
    rough = squared(q, x)
    rough[qids[:, None] == ids[None, :]] = np.inf
    if len(ids) > k:
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * ((q * q).sum(1) + (x * x).sum(1).max()) + 1e-300
        kept = rough <= (limit + slack)[:, None]
    else:
        kept = np.ones(rough.shape, bool)
    kept &= np.isfinite(rough)
    r, c = np.nonzero(kept)
    exact = np.sqrt(((q[r] - x[c]) ** 2).sum(1))
    order = np.lexsort((ids[c], exact, r))
    r, c, exact = r[order], c[order], exact[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    near = rank < k
    return r[near], c[near], exact[near]


def _found(qids, q, ids, x, cell, k):
    r, c, score = nearest(qids, q, ids, x, k)
    return pa.RecordBatch.from_arrays([pa.array(qids[r]), pa.array(ids[c]), pa.array(score), pa.array(np.full(len(r), cell, np.int32))],
                                      names=["query_id", "vec_id", "score", "cell"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(df: DataFrame, k: int = 10, every: int = 100, vector: str = "embedding", sample_rows: int = 20_000,
           branch: int = 8, leaf_rows: int = 64, calibration: int = 100, target: float = 0.97) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): about the ``k`` nearest rows by Euclidean distance.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates are all rows but
    the query's own. The tree is fitted on ``sample_rows`` rows; the number of leaves to visit is
    the least for which ``calibration`` queries (those of smallest hash), compared with all rows,
    reach a mean recall of ``target``. ``score`` is the distance in double precision; ties go to
    the smaller id. Rows that take no part: see ``vectors.valid`` (nulls, non-finite, zero vectors)
    and vectors of another than the most common length. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = stored(valid(df, vector, zero=False))
    d = dimension(rows)
    rows = rows.where(F.size("v") == d)
    data = sample(rows, sample_rows).reshape(-1, max(d, 1)) if d else np.zeros((0, 1))
    if not len(data):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    tree = Tree()
    tree.grow(data, branch, leaf_rows)
    sent = carried(spark, tree)
    total = rows.count()

    def place(batches):
        grown = sent()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(grown.assign(matrix(batch.column(1)))), batch.column(0), batch.column(1)],
                                                 names=["cell", "vec_id", "v"])

    placed = rows.select("vec_id", "v").mapInArrow(place, "cell int, vec_id bigint, v array<double>")
    packs = stored(packed(placed, max(8, -(-total // (16 * PACK))), PACK))

    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    trial = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(calibration).toPandas()
    visits = tree.leaves
    if len(trial):
        tq, tv = trial["vec_id"].to_numpy(np.int64), np.array(trial["v"].tolist(), np.float64)
        known = spark.sparkContext.broadcast((tq, tv))

        def brute(batches):
            for batch in batches:
                for cell, ids, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    yield _found(*known.value, *unpack(ids, block), cell, k)

        true = _best(packs.mapInArrow(brute, FOUND), k).select("query_id", "cell").toPandas()
        visits = calibrated(tree, tq, tv, true, target)

    def probe(batches):
        grown = sent()
        for batch in batches:
            if not batch.num_rows:
                continue
            walks = [grown.visit(r, visits) for r in matrix(batch.column(1))]
            again = np.repeat(np.arange(len(walks)), [len(w) for w in walks])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(walks).astype(np.int32)), batch.column(0).take(pa.array(again)),
                                              batch.column(1).take(pa.array(again))], names=["cell", "vec_id", "v"])

    parts = max(8, -(-(total // every) * visits // (16 * QUERIES)))
    probes = packed(asked.mapInArrow(probe, "cell int, vec_id bigint, v array<double>"), parts, QUERIES)
    met = probes.select("cell", F.col("ids").alias("qids"), F.col("data").alias("q")).join(packs, "cell")

    def compare(batches):
        for batch in batches:
            for cell, qids, q, ids, block in zip(*(batch.column(i).to_pylist() for i in range(5))):
                yield _found(*unpack(qids, q), *unpack(ids, block), cell, k)

    found = met.select("cell", "qids", "q", "ids", "data").mapInArrow(compare, FOUND)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def calibrated(tree: Tree, ids: np.ndarray, rows: np.ndarray, true: pd.DataFrame, target: float) -> int:
    """The least number of leaf visits at which the mean recall of the trial queries is ``target``."""
    cells = true.groupby("query_id")["cell"].apply(list).to_dict()
    hits = np.zeros(tree.leaves + 1)
    queries = 0
    for q, row in zip(ids, rows):
        mine = cells.get(int(q))
        if not mine:
            continue
        queries += 1
        turn = {leaf: i + 1 for i, leaf in enumerate(tree.visit(row, tree.leaves))}
        for cell in mine:
            hits[turn[cell]] += 1 / len(mine)
    if not queries:
        return tree.leaves
    return max(1, int(np.searchsorted(np.cumsum(hits) / queries, target - 1e-9)))
