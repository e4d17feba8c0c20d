"""Packing of token sequences: shortest pack first over the length histogram.

Documents are cut into full pieces of ``width`` ids and one rest. Only the number of pieces of
each length matters for the packing, so it runs on the histogram (at most ``width`` entries,
whatever the corpus): lengths go longest first into the emptiest pack that takes them, and packs
of equal content are one pattern with a count. Patterns then own ranges of ranks within each
length; pieces are ranked inside Spark and find their sequence and offset by rank.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.bpe import Library, shipped
from tracelake.llm.common import carried, stored

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def patterns(histogram: dict[int, int], width: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packs, by shortest-pack-first over ``histogram`` (length -> count)."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    spaces: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(space: int, count: int, content: tuple[int, ...]) -> None:
        if not count:
            return
        if not space:
            done.append((count, content))
            return
        if not room[space]:
            heapq.heappush(spaces, -space)
        room[space].append((count, content))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not spaces or -spaces[0] < length:
                each = width // length
                put(width - each * length, left // each, (length,) * each)
                put(width - left % each * length, int(left % each > 0), (length,) * (left % each))
                break
            space = -spaces[0]
            count, content = room[space].pop()
            if not room[space]:
                heapq.heappop(spaces)
            taken = min(left, count)
            put(space, count - taken, content)
            put(space - length, taken, content + (length,))
            left -= taken
    return done + [entry for space in sorted(room) for entry in room[space]]


class Places:
    """Where the piece with a given rank among those of its length goes."""

    def __init__(self, packs: list[tuple[int, tuple[int, ...]]]) -> None:
        rows, next_rank, sequence = [], defaultdict(int), 0
        for count, content in packs:
            offset = 0
            for length in content:
                rows.append((length << 44 | next_rank[length], next_rank[length], sequence, offset))
                next_rank[length] += count
                offset += length
            sequence += count
        rows.sort()
        self.keys, self.ranks, self.sequences, self.offsets = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, length << 44 | rank, "right") - 1
        return self.sequences[at] + rank - self.ranks[at], self.offsets[at]


def cut(df: DataFrame, path: str, width: int, end_id: int = 0) -> DataFrame:
    """Pieces of each document's ids (those of its text, then ``end_id``), at most ``width`` long."""
    ids = shipped(df.sparkSession, path, Library)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        tables = ids()
        for batch in batches:
            columns = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packed = memoryview(tables.encode(text or "") + end)
                total = len(packed) // 4
                for start in range(0, total, width):
                    piece = packed[4 * start:4 * (start + width)]
                    for column, value in zip(columns, (doc, start, len(piece) // 4, zlib.crc32(piece), total)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return df.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(df: DataFrame, path: str, width: int = 1024, end_id: int = 0, per_bucket: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``df`` needs ``doc_id`` and ``text``; other columns are not read. A null or empty text gives
    one piece that holds the end id alone. Repeated rows are packed each by itself; a null
    ``doc_id`` is kept as null. An empty table gives no rows. Texts of any length are cut whole.
    Ranks are taken inside (length, bucket) groups of about ``per_bucket`` pieces and shifted by
    the buckets before, so that one frequent length is spread over many tasks.
    """
    spark = df.sparkSession
    pieces = stored(cut(df, path, width, end_id))
    rows = pieces.count()
    buckets = max(16, -(-rows // per_bucket))
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    # At most one row per length: the histogram is bounded by the width of a sequence.
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = placed.withColumn("own", F.row_number().over(own) - 1).join(shifts, ["length", "bucket"])
    sent = carried(spark, Places(patterns(histogram, width)))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        places = sent()
        for length, rank in batches:
            sequence, offset = places.of(length.to_numpy(np.int64), rank.to_numpy(np.int64))
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    at = place("length", F.col("own") + F.col("shift"))
    return ranked.withColumn("at", at).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")
