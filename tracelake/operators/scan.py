"""Literal, pattern and signature search over text and binary contents.

Rows of a bounded size (texts, chunks, blocks) are searched where they are; only
the few bytes around chunk edges are ever shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators.ranges import owners_of_offsets

CHUNK_BYTES = 1 << 20
#: Hits that a worker holds before it hands them on.
HITS = 1 << 14

# Kind, leading bytes (hex), how far into the object they sit, grade.
SIGNATURES = (
    ("png", "89504E470D0A1A0A", 0, "validated"),
    ("jpeg", "FFD8FF", 0, "validated"),
    ("gif", "474946383961", 0, "validated"),
    ("gif", "474946383761", 0, "validated"),
    ("zip", "504B0304", 0, "validated"),
    ("gzip", "1F8B08", 0, "validated"),
    ("sqlite", "53514C69746520666F726D6174203300", 0, "validated"),
    ("pdf", "255044462D", 0, "validated"),
    ("dex", "6465780A", 0, "validated"),
    ("elf", "7F454C46", 0, "magic"),
    ("xz", "FD377A585A00", 0, "magic"),
    ("7z", "377ABCAF271C", 0, "magic"),
    ("bzip2", "425A68", 0, "magic"),
    ("mp4", "66747970", 4, "magic"),
    ("ogg", "4F676753", 0, "magic"),
    ("wasm", "0061736D", 0, "magic"),
    ("android-oat", "6F61740A", 0, "magic"),
    ("rar", "526172211A07", 0, "weak"),
)


def _all_offsets(haystack, needle) -> list[int]:
    hits, at = [], haystack.find(needle)
    while at >= 0:
        hits.append(at)
        at = haystack.find(needle, at + 1)
    return hits


def _hits(df: DataFrame, content: str | Column, keep: list[str], fields: dict[str, tuple[str, pa.DataType]],
          found: Callable[[str | bytes | None], Iterable[tuple]]) -> DataFrame:
    """``keep`` and the ``fields`` of every hit that ``found`` gives for a content.

    A worker turns one content at a time into an object and holds at most ``HITS`` hits, however
    many rows Spark sends it at once.
    """
    rows = df.select(F.col(content) if isinstance(content, str) else content, *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    names, types = [*keep, *fields], [kind for _, kind in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]):
        def out(batch, at, hits):
            taken = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns[1:]),
                                               *(pa.array(c, t) for c, t in zip(zip(*hits), types))], names=names)

        for batch in batches:
            at, hits = [], []
            for i, value in enumerate(batch.column(0)):
                for hit in found(value.as_py()):
                    at.append(i)
                    hits.append(hit)
                    if len(at) == HITS:
                        yield out(batch, at, hits)
                        at, hits = [], []
            if at:
                yield out(batch, at, hits)

    return rows.mapInArrow(run, ", ".join([kept, *(f"`{n}` {sql}" for n, (sql, _) in fields.items())]))


def _offsets(haystack: str | bytes | None, needle: str | bytes) -> Iterator[tuple[int]]:
    """Every position of the needle, overlapping ones included."""
    at = -1 if haystack is None else haystack.find(needle)
    while at >= 0:
        yield (at,)
        at = haystack.find(needle, at + 1)


OFFSET = {"offset": ("bigint", pa.int64())}


def search_text(df: DataFrame, text: str, needle: str, keep: list[str]) -> DataFrame:
    """Every occurrence of a literal in every text (zero-based characters), one row per hit."""
    return _hits(df.filter(F.col(text).contains(needle)), text, keep, OFFSET, lambda t: _offsets(t, needle))


def regex_search(df: DataFrame, text: str, pattern: str, keep: list[str]) -> DataFrame:
    """Non-overlapping pattern matches over whole texts with their offsets."""
    compiled = re.compile(pattern)
    return _hits(df, text, keep, OFFSET | {"match": ("string", pa.string())},
                 lambda t: ((m.start(), m.group()) for m in compiled.finditer(t or "")))


def chunk_rows(df: DataFrame, key: str, content: str, size: int = CHUNK_BYTES) -> DataFrame:
    """Contents cut into numbered chunks of a fixed size."""
    last = F.greatest(F.ceil(F.octet_length(content) / size) - 1, F.lit(0)).cast("long")
    numbered = df.select(key, content, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return numbered.select(key, "chunk", F.substring(content, (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("data"))


def search_chunks(chunks: DataFrame, key: str, needle: bytes, size: int = CHUNK_BYTES,
                  start: int = 0, end: int | None = None) -> DataFrame:
    """Absolute offsets of every occurrence of a byte string in chunked contents.

    Chunks are searched without a shuffle; for hits across an edge only the
    ``len(needle) - 1`` bytes on either side are joined.
    """
    if len(needle) > size:
        raise ValueError("the needle must fit in one chunk")
    near = chunks.filter((F.col("chunk") + 1) * size > start)
    near = near if end is None else near.filter(F.col("chunk") * size < end)
    base = F.col("chunk") * size

    def placed(rows: DataFrame) -> DataFrame:
        return _hits(rows, "data", [key, "_base"], OFFSET, lambda data: _offsets(data, needle)).select(key, (F.col("_base") + F.col("offset")).alias("offset"))

    hits = placed(near.select(key, base.alias("_base"), "data"))
    reach = len(needle) - 1
    if reach:
        tails = near.filter(F.octet_length("data") == size).select(key, "chunk", F.substring("data", size - reach + 1, reach).alias("tail"))
        heads = near.select(key, (F.col("chunk") - 1).alias("chunk"), F.substring("data", 1, reach).alias("head"))
        edges = tails.join(heads, [key, "chunk"]).select(
            key, (base + size - reach).alias("_base"), F.concat("tail", "head").alias("data"))
        hits = hits.unionByName(placed(edges))
    inside = F.col("offset") >= start
    return hits.filter(inside if end is None else inside & (F.col("offset") + len(needle) <= end))


def first_hits(hits: DataFrame, order: list[str], k: int) -> DataFrame:
    """First k hits in scan order, flagged when there are more."""
    some = hits.orderBy(*order).limit(k + 1).withColumn("_one", F.lit(1))
    # At most k + 1 rows reach this window.
    placed = some.withColumn("_r", F.row_number().over(W.partitionBy("_one").orderBy(*order)))
    counted = placed.withColumn("truncated", F.count("*").over(W.partitionBy("_one")) > k)
    return counted.filter(F.col("_r") <= k).drop("_one", "_r")


def contexts(df: DataFrame, text: str, needle: str, keep: list[str], around: int = 64, reveal: bool = False) -> DataFrame:
    """Every hit in every text: ``keep``, offset (zero-based characters) and the redacted context."""
    length, mask = 2 * around + len(needle), needle if reveal else "?" * len(needle)

    def found(value: str):
        for at, in _offsets(value, needle):
            start = max(at - around, 0)
            yield at, value[start:start + length].replace(needle, mask)

    return _hits(df.filter(F.col(text).contains(needle)), text, keep, OFFSET | {"context": ("string", pa.string())}, found)


def hit_report(df: DataFrame, text: str, key: str, base: Column, needle: str, extents: DataFrame,
               block_size: int, around: int = 64, reveal: bool = False, by: list[str] = ()) -> DataFrame:
    """Hits with redacted context and the file that owns their place in the image.

    Columns ``by`` (a device, say) are in ``df`` and ``extents``; an offset meets files of its own device only.
    """
    hits = contexts(df.withColumn("_base", base), text, needle, [*by, key, "_base"], around, reveal)
    placed = hits.select(*by, key, (F.col("_base") + F.col("offset")).alias("offset"), "context")
    return owners_of_offsets(placed, extents, block_size, by).select(*by, key, "offset", "context", "path", "file_offset")


def signature_hits(blocks: DataFrame, keep: list[str], data: str = "data", number: str | None = None) -> DataFrame:
    """Every signature occurrence in every block: kind, grade and object start in the block.

    With ``number`` (one of ``keep``: blocks that follow each other in what the others name have numbers
    that do) objects are found whose signature lies across the edge of two blocks, or in the next block
    while the object starts in this one. Only the bytes around edges are joined for that.
    """
    table = [(kind, bytes.fromhex(magic), shift) for kind, magic, shift, _ in SIGNATURES]
    reach = max(len(magic) + shift for _, magic, shift in table) - 1

    @F.pandas_udf("array<struct<kind:string,start:int>>")
    def find(values: pd.Series) -> pd.Series:
        return values.map(lambda blob: [
            {"kind": kind, "start": at - shift} for kind, magic, shift in table
            for at in (_all_offsets(blob, magic) if magic in blob else ()) if at >= shift])

    @F.pandas_udf("array<struct<kind:string,start:int>>")
    def across(tails: pd.Series, heads: pd.Series) -> pd.Series:
        # Starts in the tail, ends in the head.
        return pd.Series([[{"kind": kind, "start": at - shift - len(tail)} for kind, magic, shift in table for at in _all_offsets(tail + head, magic)
                           if 0 <= at - shift < len(tail) < at + len(magic)] for tail, head in zip(tails, heads)], dtype=object)

    grades = F.create_map(*[F.lit(x) for kind, _, _, grade in SIGNATURES if kind != "gif" for x in (kind, grade)],
                          F.lit("gif"), F.lit("validated"))
    hits = blocks.select(*keep, F.explode(find(F.col(data))).alias("h"))
    if number:
        size = F.octet_length(data)
        cut = F.least(size, F.lit(reach))
        tails = blocks.select(*keep, size.alias("_size"), F.substring(data, size - cut + 1, cut).alias("_tail"))
        heads = blocks.select(*keep, F.substring(data, 1, reach).alias("_head")).withColumn(number, F.col(number) - 1)
        edge = tails.join(heads, keep).select(*keep, "_size", F.explode(across("_tail", "_head")).alias("e"))
        hits = hits.unionByName(edge.select(*keep, F.struct(F.col("e.kind").alias("kind"), (F.col("e.start") + F.col("_size")).cast("int").alias("start")).alias("h")))
    return hits.select(*keep, "h.kind", "h.start", grades[F.col("h.kind")].alias("grade"))


def name_summary(entries: DataFrame, k: int = 10) -> DataFrame:
    """Recovered names by kind, with the implausible kinds (outside 0 to 8) counted."""
    return entries.groupBy("kind").agg(
        F.count("*").alias("names"), F.countDistinct("directory").alias("directories"),
        F.count_if(~F.col("kind").between(0, 8)).alias("implausible"))
