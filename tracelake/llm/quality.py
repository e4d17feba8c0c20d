"""Quality classifier: naive Bayes features under a linear hinge-loss model.

Indicators of hashed byte n-grams (and of how often a word repeats the one before it) are scaled
by the log ratio of their frequencies in the two classes. A linear model with hinge loss is fitted
on the scaled, length-normalised indicators by dual coordinate descent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import carried

#: log2 of the number of hashed features.
BITS = 18
MIX = np.uint32(2654435761)
#: Shares of repeated words from which the repeat indicators are set.
REPEATS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8)
#: A text with this score lies on the separating plane.
CUT = 0.7
SLOPE = 4.0


def features(text: str | None, stamp: np.ndarray) -> np.ndarray:
    """Distinct feature numbers of a whole text; ``stamp`` is scratch space of 2**BITS ints."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    codes = [np.frombuffer(raw, "<u4", (len(raw) - k) // 4, k) for k in range(4) if len(raw) - k >= 4]
    words = text.split()
    if len(words) > 1:
        share = sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1)
        codes.append(np.array([0xFF00FF00 + i for i, least in enumerate(REPEATS) if share >= least], np.uint32))
    if not codes:
        return np.zeros(0, np.int64)
    hashed = ((np.concatenate(codes) * MIX) >> np.uint32(32 - BITS)).astype(np.int64)
    order = np.arange(len(hashed), dtype=stamp.dtype)
    stamp[hashed] = order
    return hashed[stamp[hashed] == order]


@dataclass
class Model:
    """``weight`` already holds the class ratios; ``ratio`` is kept for the normalisation."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        ratio = self.ratio[found]
        norm = max(1.0, float(np.sqrt(ratio @ ratio)))
        margin = float(self.weight[found].sum()) / norm + self.bias
        return float(1 / (1 + np.exp(-np.clip(SLOPE * margin + np.log(CUT / (1 - CUT)), -500, 500))))


def train(samples: list[np.ndarray], labels: np.ndarray, c: float = 1.0, rounds: int = 10) -> Model:
    """Class ratios over ``samples`` and hinge-loss weights by dual coordinate descent.

    With labels of one class only, or none, every score is the smoothed share of label 1.
    """
    size, good = len(labels), int(labels.sum())
    if good in (0, size):
        share = (good + 1) / (size + 2)
        zero = np.zeros(1 << BITS)
        return Model(zero, zero, float((np.log(share / (1 - share)) - np.log(CUT / (1 - CUT))) / SLOPE))
    counts = np.ones((2, 1 << BITS))
    for found, label in zip(samples, labels):
        counts[label, found] += 1
    ratio = np.log(counts[1] / (good + 2)) - np.log(counts[0] / (size - good + 2))
    values = np.split(np.empty(sum(map(len, samples))), np.cumsum([len(found) for found in samples])[:-1])
    for found, value in zip(samples, values):
        row = ratio[found]
        value[:] = row / max(1.0, float(np.sqrt(row @ row)))
    sizes = [float(v @ v) + 1 for v in values]
    sign, dual = 2.0 * labels - 1, np.zeros(size)
    weight, bias = np.zeros(1 << BITS), 0.0
    dice = np.random.default_rng(7)
    for _ in range(rounds):
        for i in dice.permutation(size):
            found, row = samples[i], values[i]
            slack = sign[i] * (weight[found] @ row + bias) - 1
            step = min(max(dual[i] - slack / sizes[i], 0.0), c) - dual[i]
            if step:
                dual[i] += step
                weight[found] += step * sign[i] * row
                bias += step * sign[i]
    return Model(weight * ratio, ratio, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 5000, fold: int = 2) -> Model:
    """Model of ``labels.quality`` from at most ``sample`` labelled documents.

    The rows with the smallest hash of their id are taken among those whose
    ``crc32(doc_id as text) mod 4`` is not ``fold``. Null labels and ids are left out; a document
    labelled more than once counts as its worst label. The sample is the bound on what is
    broadcast and on what reaches the driver; everything else covers all rows.
    """
    known = (labels.select("doc_id", "quality")
             .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .where(F.crc32(F.col("doc_id").cast("string")) % 4 != fold)
             .groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    taken = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")

    def run(batches):
        stamp = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            found = [features(t, stamp).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f.tobytes() for f in found], pa.binary())],
                names=["doc_id", "quality", "found"])

    # A few large arrays go back to the system when they are done with; many small ones would stay with the driver.
    rows = taken.mapInArrow(run, "doc_id bigint, quality int, found binary").toArrow().sort_by([(n, "ascending") for n in ("doc_id", "quality", "found")])
    found = pa.concat_arrays(rows.column("found").chunks or [pa.array([], pa.binary())])
    ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset:found.offset + len(found) + 1] // 4 if len(found) else np.zeros(1, np.int32)
    flat = np.frombuffer(found.buffers()[2], np.int32)[ends[0]:ends[-1]].astype(np.int64) if len(found) else np.zeros(0, np.int64)
    samples = np.split(flat, ends[1:-1] - ends[0])[:len(found)]
    labels = (rows.column("quality").to_numpy() > 0).astype(np.int64)
    del rows, found
    pa.default_memory_pool().release_unused()
    return train(samples, labels)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: label 1 likelier) from each whole text alone.

    A null text counts as empty and gets the score of a text without features. Each row gives one
    row; a column named ``score`` is replaced.
    """
    sent = carried(df.sparkSession, model)
    kept = [f for f in df.schema.fields if f.name != "score"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"])

    def run(batches):
        fitted, stamp = sent(), np.zeros(1 << BITS, np.int32)
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            scores = [fitted.score(features(t, stamp)) for t in batch.column(at[text]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(at[f.name]) for f in kept] + [pa.array(scores, pa.float64())],
                                             names=[f.name for f in kept] + ["score"])

    return df.mapInArrow(run, schema)
