"""Records of a few numbers, grouped by a key without a row for each.

Records travel as parts: cells that hold the columns of many records, 16 bits of all of them behind
one another. A task gathers records and writes a part for each segment of the key's range. There are
as many segments as the number of records asks for, so what a worker holds of one does not grow with
the input; only the records of a single key stay together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: What ``parts`` gives.
PARTS = "segment int, data binary"
#: Records that a task gathers before it writes parts, and that a segment has at most if keys are even.
GATHERED, SEGMENT = 1 << 18, 1 << 20
#: log2 of the least and the largest number of segments.
LEAST, MOST = 8, 16


def segments(records: int) -> int:
    """log2 of the number of segments for so many records."""
    return min(MOST, max(LEAST, (max(0, records) // SEGMENT).bit_length()))


def parts(made: Callable, kinds: list, bits: int) -> Callable:
    """A function of batches: the records that ``made`` makes of them, as parts.

    ``made`` yields (key, columns...), the key as unsigned 64-bit numbers whose upper bits are even;
    the columns are sent as ``kinds``, the key only if it is one of them.
    """

    def dealt(held: list) -> pa.RecordBatch:
        key, *columns = (np.concatenate(c) for c in zip(*held))
        segment = (key >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(segment, kind="stable")
        segment = segment[order]
        planes = np.concatenate([np.ascontiguousarray(c[order], k).view(np.uint16).reshape(len(order), -1).T for c, k in zip(columns, kinds)])
        first = np.flatnonzero(np.diff(segment.astype(np.int32), prepend=-1))
        data = [planes[:, a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(order)))]
        return pa.RecordBatch.from_arrays([pa.array(segment[first].astype(np.int32)), pa.array(data, pa.binary())], names=["segment", "data"])

    def run(batches: Iterator[pa.RecordBatch]):
        held, count = [], 0
        for columns in made(batches):
            held.append(columns)
            count += len(columns[0])
            if count >= GATHERED:
                yield dealt(held)
                held, count = [], 0
        if count:
            yield dealt(held)

    return run


def opened(data: list[bytes], kinds: list) -> list[np.ndarray]:
    """The columns of these parts."""
    widths = [np.dtype(k).itemsize // 2 for k in kinds]
    planes = np.concatenate([np.frombuffer(d, np.uint16).reshape(sum(widths), -1) for d in data], axis=1)
    ends = np.cumsum(widths)
    return [np.ascontiguousarray(planes[e - w:e].T).view(k).ravel() for e, w, k in zip(ends, widths, kinds)]


def grouped(dealt: DataFrame, kinds: list, then: Callable, schema: str) -> DataFrame:
    """What ``then`` makes of the records of ``dealt`` (see ``parts``): it takes an iterator of segments, each its columns."""

    def whole(batches: Iterator[pa.RecordBatch]):
        held, now = [], None
        for batch in batches:
            for segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if segment != now and held:
                    yield opened(held, kinds)
                    held = []
                now = segment
                held.append(data)
        if held:
            yield opened(held, kinds)

    return dealt.repartition("segment").sortWithinPartitions("segment").mapInArrow(lambda batches: then(whole(batches)), schema)
