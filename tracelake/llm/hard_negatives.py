"""Hard negatives by a vertical scan of columnar vector blocks (bounds on what is not read yet).

Rows lie in blocks, dimension by dimension, next to each dimension's smallest and largest value. An
anchor reads the dimensions in falling order of its own magnitudes. After each step every row has the
exact sum over what was read, and the rest lies between the sums of the smaller and the larger
products with the block's extremes. Rows whose range can't reach the anchor's floor, or none of its
score windows, leave the candidate bitmap; what is left at the end is scored exactly. The first step
reads three quarters of the dimensions, each anchor its own, for many anchors and all rows at once.

Two scans run: the first finds each anchor's positives, the second the rows of other labels inside the
windows that the positives' scores open. Both start from floors found in the anchor's own block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import stored
from tracelake.llm.topk import products
from tracelake.llm.vectors import dimension, kmeans, matrix, sample, squared

#: Rows of a block, anchors of a bundle, blocks that one join key gathers at most, dimensions read in one later step.
BLOCK, BUNDLE, SHARE, STEP = 2048, 256, 16, 16
#: Anchors whose first step is taken at once.
TOGETHER = 64
SAMPLE = 4096
WIDE = np.iinfo(np.int64)
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def labelled(df: DataFrame, scale: int, vector: str) -> DataFrame:
    """``vec_id, label, v``: rows that take part, components as floor(scale * x).

    Null ids, labels and vectors, and null or non-finite components take no part. Of rows that share
    an id the one with the smallest (vector, label) stays.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), v.alias("v")).dropna(subset=["vec_id", "label", "v"])
    rows = rows.where(F.coalesce(finite, F.lit(False))).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r"))
    return rows.select("vec_id", "r.label", F.transform("r.v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


class Columns:
    """One block: ids, labels and vectors, dimension by dimension."""

    def __init__(self, ids: bytes, labels: bytes, data: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.data = np.frombuffer(data).reshape(-1, len(self.ids))
        self.high, self.low = self.data.max(1), self.data.min(1)
        self.size = max(float(np.abs(self.high).max(initial=0)), float(np.abs(self.low).max(initial=0)))

    def most(self, q: np.ndarray) -> np.ndarray:
        """The largest score that any row can have, for each anchor."""
        top = np.maximum(q, 0) @ self.high + np.minimum(q, 0) @ self.low
        return top + 1e-9 * np.abs(top)


def opening(d: int) -> int:
    """How many of ``d`` dimensions an anchor reads before rows leave: bounds on more than a quarter of them tell little."""
    return -(-3 * d // 4)


def begun(block: Columns, q: np.ndarray) -> np.ndarray:
    """Sums over the dimensions that each of the anchors ``q`` reads first, for all rows of the block at once."""
    first = np.argsort(-np.abs(q), axis=1, kind="stable")[:, :opening(q.shape[1])]
    read = np.zeros(q.shape)
    np.put_along_axis(read, first, np.take_along_axis(q, first, 1), 1)
    return read @ block.data


def firsts(block: Columns, q: np.ndarray, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each of ``anchors`` (places in ``q``) with what ``begun`` gives for it."""
    for at in range(0, len(anchors), TOGETHER):
        some = anchors[at:at + TOGETHER]
        yield from zip(some, begun(block, q[some]))


def scan(block: Columns, anchor: int, q: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray, k: int,
         part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``alive`` (places in the block) with a score in one of the windows low..high, and the scores.

    For each window the ``k`` best rows are in what comes back; rows that can't be among them may be
    missing. ``anchor`` itself must not be in ``alive``. ``part`` is what ``begun`` gives for ``q``.
    """
    order = np.argsort(-np.abs(q), kind="stable")
    top = np.maximum(q * block.high, q * block.low)[order]
    bottom = np.minimum(q * block.high, q * block.low)[order]
    # Whole numbers below 2^53 add up exactly; beyond, bounds get the room that rounding may take.
    reach = float(np.abs(q).sum()) * block.size
    slack = 0.0 if reach < 2.0 ** 53 else reach * 1e-9
    above = np.concatenate([np.cumsum(top[::-1])[::-1], [0.0]]) + slack
    below = np.concatenate([np.cumsum(bottom[::-1])[::-1], [0.0]]) - slack
    low, high = low.astype(np.float64), high.astype(np.float64)
    part = (begun(block, q[None])[0] if part is None else part)[alive]
    read = opening(len(order))
    while True:
        up, down = above[read], below[read]
        for j in np.flatnonzero(high - low >= up - down):
            sure = part[(part >= low[j] - down) & (part <= high[j] - up)]
            if len(sure) >= k:
                low[j] = max(low[j], np.partition(sure, len(sure) - k)[len(sure) - k] + down)
        stay = np.zeros(len(part), bool)
        for least, greatest in joined(low - up, high - down):
            stay |= (part >= least) & (part <= greatest)
        alive, part = alive[stay], part[stay]
        if not len(alive):
            return alive, np.zeros(0)
        if read == len(order):
            return alive, (products(q[None, :], block.data[:, alive].T)[0] if slack else part)
        dims = order[read:read + STEP]
        part += q[dims] @ block.data[np.ix_(dims, alive)]
        read += len(dims)


def joined(low: np.ndarray, high: np.ndarray) -> list[tuple[float, float]]:
    """The ranges low..high with those that meet made one."""
    out: list[tuple[float, float]] = []
    for a, b in sorted(zip(low.tolist(), high.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a <= b:
            out.append((a, b))
    return out


def cut(ids: np.ndarray, scores: np.ndarray, low: int, high: int, k: int, last: int) -> np.ndarray:
    """Places of the ``k`` best rows inside one window; at score ``low`` ids up to ``last`` only."""
    inside = np.flatnonzero((scores >= low) & (scores <= high) & ((scores > low) | (ids <= last)))
    return inside[np.lexsort((ids[inside], -scores[inside]))[:k]]


def _blocks(rows: DataFrame, total: int, d: int) -> DataFrame:
    """(cell, share, shares, block, ids, labels, data): rows in blocks of one cell of near vectors."""
    spark = rows.sparkSession
    data = sample(rows.select("vec_id", "v"), SAMPLE).reshape(-1, d)
    centres, _ = kmeans(data, min(64, max(1, total // BLOCK)))
    sent = spark.sparkContext.broadcast(centres)

    def near(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                cell = squared(matrix(batch.column(2)), sent.value).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], names=["cell", "vec_id", "label", "v"])

    def pack(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(cells):
                continue
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            data = matrix(batch.column(3))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
            cuts = [(x, min(x + BLOCK, b)) for a, b in zip(starts, starts[1:]) for x in range(a, b, BLOCK)]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(cells[a]) for a, _ in cuts], pa.int32()), pa.array([ids[a:b].tobytes() for a, b in cuts], pa.binary()),
                pa.array([labels[a:b].tobytes() for a, b in cuts], pa.binary()),
                pa.array([np.ascontiguousarray(data[a:b].T).tobytes() for a, b in cuts], pa.binary())], names=["cell", "ids", "labels", "data"])

    named = rows.select("vec_id", "label", "v").mapInArrow(near, "cell int, vec_id bigint, label bigint, v array<double>")
    dealt = named.repartitionByRange(max(8, -(-total // BLOCK)), "cell", "label", "vec_id").sortWithinPartitions("cell", "label", "vec_id")
    packs = stored(dealt.mapInArrow(pack, "cell int, ids binary, labels binary, data binary").withColumn("block", F.monotonically_increasing_id()))
    # A cell that holds many blocks is split into shares; counts by cell are at most 64 rows.
    count = {r["cell"]: -(-r["count"] // SHARE) for r in packs.groupBy("cell").count().collect()}
    shares = F.element_at(F.create_map(*[F.lit(x) for pair in count.items() for x in pair]), F.col("cell"))
    return packs.withColumn("shares", shares).withColumn("share", F.pmod(F.xxhash64("block"), F.col("shares")).cast("int"))


def _extremes(blocks: DataFrame, d: int) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """Per cell the largest and smallest value of each dimension and its shares (at most 64 x 2 x d numbers)."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for ids, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.frombuffer(data).reshape(-1, len(ids) // 8)
                cell = batch.column(0)[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, cell, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(x.max(1)), pa.array(x.min(1))],
                                                 names=["cell", "dim", "high", "low"])

    def each(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from run(batch.slice(i, 1) for i in range(batch.num_rows))

    found = blocks.select("cell", "ids", "data").mapInArrow(each, "cell int, dim int, high double, low double")
    rows = found.groupBy("cell", "dim").agg(F.max("high").alias("high"), F.min("low").alias("low")).collect()
    shares = {r["cell"]: r["shares"] for r in blocks.select("cell", "shares").distinct().collect()}
    out = {cell: (np.zeros(d), np.zeros(d), n) for cell, n in shares.items()}
    for r in rows:
        out[r["cell"]][0][r["dim"]], out[r["cell"]][1][r["dim"]] = r["high"], r["low"]
    return out


ASKED = "cell int, shares int, block bigint, qids binary, qlabels binary, q binary, low binary, high binary, last binary"


def _asked(anchors: DataFrame, extremes: dict, width: int, d: int, own: bool) -> DataFrame:
    """Bundles of anchors (anchor_id, label, block, v, low, high, last as arrays) for the cells they may find rows in.

    With ``own`` a bundle asks only the block of its anchors. A cell whose extremes keep every anchor's
    score below all its windows is left out before anything is shuffled to it.
    """
    sent = anchors.sparkSession.sparkContext.broadcast(extremes)
    names = [f.split()[0] for f in ASKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for at in range(0, whole.num_rows, BUNDLE):
                batch = whole.slice(at, BUNDLE)
                ids, labels, blocks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                q, low, high, last = (np.array(batch.column(i).to_pylist(), t) for i, t in ((3, np.float64), (4, np.int64), (5, np.int64), (6, np.int64)))
                if own:
                    keys = [(0, 1, b, np.flatnonzero(blocks == b)) for b in np.unique(blocks)]
                else:
                    floors = np.where(low <= high, low, WIDE.max).min(1)
                    keys = []
                    for cell, (top, bottom, shares) in sent.value.items():
                        most = np.maximum(q, 0) @ top + np.minimum(q, 0) @ bottom
                        keys.append((cell, shares, -1, np.flatnonzero(most + 1e-9 * np.abs(most) >= floors)))
                keys = [x for x in keys if len(x[3])]
                if keys:
                    part = lambda a: pa.array([a[m].tobytes() for *_, m in keys], pa.binary())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([c for c, *_ in keys], pa.int32()), pa.array([s for _, s, *_ in keys], pa.int32()), pa.array([int(b) for _, _, b, _ in keys], pa.int64()),
                        part(ids), part(labels), part(q), part(low), part(high), part(last)], names=names)

    order = ("block", "anchor_id") if own else ("anchor_id",)
    dealt = anchors.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("anchor_id", "label", "block", "v", "low", "high", "last").mapInArrow(run, ASKED)


def _scanned(pairs: DataFrame, width: int, d: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, vec_id, score) from (bundle, block) pairs: per anchor, window and block the ``k`` best rows."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, data, *rest = (batch.column(c)[i].as_py() for c in range(9))
                block = Columns(ids, labels, data)
                qids, qlabels = (np.frombuffer(b, np.int64) for b in rest[:2])
                q = np.frombuffer(rest[2]).reshape(len(qids), d)
                low, high, last = (np.frombuffer(b, np.int64).reshape(len(qids), width) for b in rest[3:])
                reach = block.most(q)
                out = [[], [], []]
                for a, part in firsts(block, q, np.flatnonzero(reach >= np.where(low <= high, low, WIDE.max).min(1))):
                    mine = (block.labels == qlabels[a]) == same
                    mine[block.ids == qids[a]] = False
                    open_ = low[a] <= high[a]
                    alive, scores = scan(block, int(qids[a]), q[a], np.flatnonzero(mine), low[a][open_], high[a][open_], k, part)
                    scores = np.array([int(s) for s in scores], np.int64)
                    found = block.ids[alive]
                    kept = [cut(found, scores, *w, k, z) for *w, z in zip(low[a][open_].tolist(), high[a][open_].tolist(), last[a][open_].tolist())]
                    kept = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
                    out[0].append(np.full(len(kept), qids[a]))
                    out[1].append(found[kept])
                    out[2].append(scores[kept])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), pa.int64()) for o in out], names=["anchor_id", "vec_id", "score"])

    return pairs.select("ids", "labels", "data", "qids", "qlabels", "q", "low", "high", "last").mapInArrow(run, "anchor_id bigint, vec_id bigint, score bigint")


def _meet(asked: DataFrame, blocks: DataFrame, own: bool) -> DataFrame:
    if own:
        return asked.drop("cell", "shares").join(blocks.drop("cell", "share", "shares"), "block")
    spread = asked.drop("block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return spread.join(blocks.drop("block", "shares"), ["cell", "share"])


def _ranked(hits: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, anchors_every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
         scale: int = 256, vector: str = "embedding") -> DataFrame:
    """Hard negatives of every anchor and positive, exactly.

    Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Anchors are the
    rows whose ``vec_id`` is divisible by ``anchors_every``; an anchor's positives are its first
    ``positives`` other rows of the same label by integer inner product, ties by the smaller id. For
    each positive the first ``negatives`` rows of other labels whose score lies between ``least`` and
    ``most`` percent of the positive's are returned; fewer where there are fewer, none for a negative
    positive score. See ``labelled`` for rows that take no part and for repeated ids; vectors of
    another than the most common length take no part. Scores beyond 64 bits are clipped. An empty
    table gives no rows; other columns are not read.
    """
    rows = stored(labelled(df, scale, vector))
    d = dimension(rows)
    rows = rows.where(F.size("v") == d)
    total = rows.count() if d else 0
    if not total:
        return rows.sparkSession.createDataFrame([], RESULT)
    blocks = _blocks(rows, total, d)
    extremes = _extremes(blocks, d)

    def place(batches: Iterator[pa.RecordBatch]):
        # An anchor with its block, and the floor that its own block gives: the last kept (score, id) of its label there.
        for batch in batches:
            for block, ids, labels, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held = Columns(ids, labels, data)
                out = [[], [], [], [], []]
                for a, part in firsts(held, held.data.T, np.flatnonzero(held.ids % anchors_every == 0)):
                    q = held.data[:, a]
                    alike = held.labels == held.labels[a]
                    alike[a] = False
                    alive, scores = scan(held, int(held.ids[a]), q, np.flatnonzero(alike), np.array([WIDE.min]), np.array([WIDE.max]), positives, part)
                    scores = np.array([int(s) for s in scores], np.int64)
                    best = cut(held.ids[alive], scores, WIDE.min, WIDE.max, positives, WIDE.max)
                    full = len(best) == positives
                    for o, x in zip(out, (held.ids[a], held.labels[a], q.tolist(), scores[best[-1]] if full else WIDE.min, held.ids[alive[best[-1]]] if full else WIDE.max)):
                        o.append(x)
                yield pa.RecordBatch.from_arrays([
                    pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(np.full(len(out[0]), block, np.int64)), pa.array(out[2], pa.list_(pa.float64())),
                    pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], names=["anchor_id", "label", "block", "v", "low", "last"])

    placed = blocks.select("block", "ids", "labels", "data").mapInArrow(
        place, "anchor_id bigint, label bigint, block bigint, v array<double>, low bigint, last bigint")
    placed = stored(placed)
    first = placed.select("anchor_id", "label", "block", "v", F.array("low").alias("low"), F.array(F.lit(int(WIDE.max))).alias("high"), F.array("last").alias("last"))
    found = _scanned(_meet(_asked(first, extremes, 1, d, False), blocks, False), 1, d, positives, True)
    near = stored(_ranked(found, ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # Windows in whole numbers: least * p <= 100 * n <= most * p; lists hold at most ``positives`` members.
    share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * F.lit(percent) / 100
    windows = near.where("positive_score >= 0").select(
        "anchor_id", "positive_id", "positive_score", F.ceil(share(least)).cast("long").alias("low"), F.floor(share(most)).cast("long").alias("high"))
    windows = windows.where("low <= high")
    wide = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_set(F.struct("high", "low"))).alias("w"))
    pad = lambda name, fill: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get("w", i - 1)[name], F.lit(fill).cast("long")))
    second = placed.drop("low", "last").join(wide, "anchor_id").select(
        "anchor_id", "label", "block", "v", pad("low", 1).alias("low"), pad("high", 0).alias("high"),
        F.array_repeat(F.lit(int(WIDE.max)), positives).alias("last"))
    second = stored(second)
    seeds = _scanned(_meet(_asked(second, extremes, positives, d, True), blocks, True), positives, d, negatives, False)
    # What the own block holds raises each window's lower end to its last kept (score, id).
    inside = F.col("score").between(F.col("low"), F.col("high"))
    spans = windows.select("anchor_id", "low", "high").distinct()
    worst = _ranked(seeds.join(spans, "anchor_id").where(inside), ["anchor_id", "low", "high"], negatives).where(F.col("rank") == negatives)
    raised = spans.join(worst, ["anchor_id", "low", "high"], "left").select(
        "anchor_id", F.coalesce("score", "low").alias("low"), "high", F.coalesce("vec_id", F.lit(int(WIDE.max))).alias("last"))
    wide = raised.groupBy("anchor_id").agg(F.array_sort(F.collect_set(F.struct("high", "low", "last"))).alias("w"))
    third = second.drop("low", "high", "last").join(wide, "anchor_id").select(
        "anchor_id", "label", "block", "v", pad("low", 1).alias("low"), pad("high", 0).alias("high"), pad("last", int(WIDE.max)).alias("last"))
    hits = _scanned(_meet(_asked(third, extremes, positives, d, False), blocks, False), positives, d, negatives, False)
    pairs = hits.join(windows, "anchor_id").where(inside)
    return _ranked(pairs, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same rows in SQL, every anchor against every row.
SQL = """
WITH taken AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM taken a JOIN taken b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
chosen AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS place
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM chosen WHERE place <= 3
"""
