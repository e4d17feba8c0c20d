"""Exact top-k inner-product search with block-at-a-time pruning.

Rows lie in document ranges; each range is a pack with its forward index (the rows' vectors) and
is cut into blocks. A vector's components are its terms; a block keeps each term's largest and
smallest weight. The bound of a block for a query is the sum over terms of the larger product of
the query's weight with the two. Per query, blocks are taken in falling order of bounds and scored
through the forward index until the bound falls below the k-th score. Ranges follow clusters of a
sample, which makes bounds tight; the answer does not depend on them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import stored
from tracelake.llm.vectors import cells, dimension, kmeans, packed, sample, unpack, valid

RANGE, BLOCK, QUERIES = 4096, 128, 2048
HITS = "query_id bigint, vec_id bigint, score bigint"


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact: in doubles where they fit, else in Python's integers."""
    most = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    if most < 2.0 ** 24:
        return (q.astype(np.float32) @ x.T.astype(np.float32)).astype(np.float64)
    if most < 2.0 ** 53:
        return q @ x.T
    exact = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.clip(exact, -2 ** 63, 2 ** 63 - 1)


class Best:
    """The k best (score, id) seen by each of some queries, ties to the smaller id."""

    def __init__(self, count: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.copy()
        self.rows = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.scores = np.zeros(0)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        rows = np.concatenate([self.rows, rows])
        ids = np.concatenate([self.ids, ids])
        scores = np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        last = rank == self.k - 1
        self.floor[rows[last]] = np.maximum(self.floor[rows[last]], scores[last])
        kept = rank < self.k
        self.rows, self.ids, self.scores = rows[kept], ids[kept], scores[kept]


def search(qids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Best:
    """Best rows of one range for some queries whose k-th scores are at least ``floor`` so far."""
    best = Best(len(qids), k, floor)
    starts = range(0, len(ids), BLOCK)
    high = np.array([x[a:a + BLOCK].max(0) for a in starts])
    low = np.array([x[a:a + BLOCK].min(0) for a in starts])
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    bounds += 1e-9 * np.abs(bounds)  # rounding of very large sums must not lower a bound
    order = np.argsort(-bounds, axis=1)
    for turn in range(order.shape[1]):
        block = order[:, turn]
        live = np.flatnonzero(bounds[np.arange(len(q)), block] >= best.floor)
        if not len(live):
            break
        found = [[], [], []]
        for b in np.unique(block[live]):
            mine = live[block[live] == b]
            a = b * BLOCK
            scores = products(q[mine], x[a:a + BLOCK])
            r, c = np.nonzero((scores >= best.floor[mine][:, None]) & (qids[mine][:, None] != ids[a:a + BLOCK][None, :]))
            found[0].append(mine[r])
            found[1].append(ids[a:a + BLOCK][c])
            found[2].append(scores[r, c])
        best.add(*map(np.concatenate, found))
    return best


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, vector: str = "embedding",
          sample_rows: int = 4096, clusters: int = 48) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's ``k`` best rows by integer inner product.

    Components become floor(scale * x). Queries are the rows whose ``vec_id`` is divisible by
    ``every``; candidates are all rows but the query's own; fewer than ``k`` candidates are all
    returned; ties go to the smaller id. See ``vectors.valid`` for rows that take no part (nulls,
    non-finite components) and for repeated ids; vectors of another than the most common length
    take no part. Scores beyond 64 bits are clipped. An empty table gives no rows.
    """
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    rows = stored(valid(df, vector).select("vec_id", whole.alias("v")))
    d = dimension(rows)
    rows = rows.where(F.size("v") == d)
    data = sample(rows, sample_rows).reshape(-1, max(d, 1)) if d else np.zeros((0, 1))
    if not len(data):
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    total = rows.count()
    parts = max(8, -(-total // RANGE))
    centres, _ = kmeans(data, clusters)
    ranges = stored(packed(cells(rows, centres), parts, RANGE).withColumn("range_id", F.monotonically_increasing_id()))

    def seed(batches):
        # A query's k-th score inside its own range is a floor of its k-th score over all rows.
        for batch in batches:
            for cell, ids, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, x = unpack(ids, data)
                mine = np.flatnonzero(ids % every == 0)
                floor = np.full(len(mine), -np.inf)
                if len(ids) > k:
                    for at in range(0, len(mine), 256):
                        part = mine[at:at + 256]
                        scores = products(x[part], x).astype(np.float64)
                        scores[np.arange(len(part)), part] = -np.inf
                        floor[at:at + 256] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                if len(mine):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(mine), cell, np.int32)), pa.array(ids[mine]), pa.array([r.tobytes() for r in x[mine]], pa.binary()), pa.array(floor)],
                        names=["cell", "query_id", "v", "floor"])

    def bundle(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.column(1).to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                    pa.array([b"".join(part.column(2).to_pylist())], pa.binary()),
                    pa.array([part.column(3).to_numpy(zero_copy_only=False).tobytes()], pa.binary())], names=["qids", "q", "floor"])

    def score(batches):
        for batch in batches:
            for qids, q, floor, ids, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                qids, q = unpack(qids, q)
                ids, x = unpack(ids, data)
                best = search(qids, q, np.frombuffer(floor), ids, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[best.rows]), pa.array(best.ids), pa.array([int(s) for s in best.scores], pa.int64())],
                                                 names=["query_id", "vec_id", "score"])

    seeded = ranges.select("cell", "ids", "data").mapInArrow(seed, "cell int, query_id bigint, v binary, floor double")
    bundles = seeded.repartitionByRange(max(2, total // every // QUERIES + 1), "cell", "query_id").mapInArrow(bundle, "qids binary, q binary, floor binary")
    # The query set meets every range once, bundle by bundle: an equi-join on the range's slot.
    asked = bundles.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    placed = ranges.select(F.pmod(F.xxhash64("range_id"), F.lit(parts)).cast("int").alias("slot"), "ids", "data")
    hits = asked.join(placed, "slot").select("qids", "q", "floor", "ids", "data").mapInArrow(score, HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
