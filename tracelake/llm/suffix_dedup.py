"""Removal of byte strings that occur more than once, by difference-cover sampling.

Suffix order is needed only to the depth of the string length k, so the difference-cover scheme is
run to that depth. Positions whose offset in their text lies in a difference cover D modulo v are
sampled; for any two positions there is a shift below v that takes both into the sample. A string
of k bytes that occurs twice therefore has two sampled positions, at one shift, whose next
m = k - v + 1 bytes agree.

1. Sampled positions are named by their m bytes; names that occur once are out.
2. Names are refined: the triple (v-1 bytes before, the m bytes, v-1 bytes after) is named again.
   All starts around two equal triples are repeats, and equal triples need one member from here on.
3. The remaining starts, those not sampled, are merged in by the sampled position they lead to:
   among the members of a name, the starts at shift d are equal where the d bytes before and the
   v-1-d bytes after agree; equal neighbours in that order are repeats.

Equal texts are one text with a count. Strings of m bytes and triples are compared by 64-bit
fingerprints, the bytes around a member by fingerprints of each length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import hidden, sift, stored
from tracelake.llm.hashing import hasher, mixed

def cover(p: int) -> tuple[int, list[int]]:
    """A perfect difference set of p + 1 residues modulo p * p + p + 1, for prime p.

    The exponents of a generator of the field with p**3 elements whose powers lie in a plane.
    """
    v = p * p + p + 1
    for c in range(1, p):
        for b in range(p):
            for a in range(p):
                x, found = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        found.append(i)
                    x = ((x[2] * c) % p, (x[0] + x[2] * b) % p, (x[1] + x[2] * a) % p)
                if len(found) == p + 1 and len({(s - t) % v for s in found for t in found}) == v:
                    return v, found
    raise ValueError("p must be prime")


class Shape:
    """String length k with its cover: modulus v, residues, length m of the named strings."""

    def __init__(self, k: int, p: int) -> None:
        self.k, (self.v, self.residues) = k, cover(p)
        self.m = k - self.v + 1
        if self.m < 1:
            raise ValueError("k must be at least the modulus of the cover")

    def places(self, size: int) -> np.ndarray:
        """Sampled positions of a text of ``size`` bytes whose m bytes lie within it."""
        last = size - self.m
        if size < self.k:
            return np.zeros(0, np.int64)
        at = (np.arange(0, last + 1, self.v)[:, None] + np.array(self.residues)[None]).ravel()
        return at[at <= last]


def texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        yield key, (text or "").encode("utf-8", "surrogatepass")


def sampled(df: DataFrame, shape: Shape) -> DataFrame:
    """(name, text_key, twice): the names of a text's sampled positions, each once per text."""

    def run(batches: Iterator[pa.RecordBatch]):
        tools = hasher()
        for batch in batches:
            names, keys, twice, seen = [], [], [], set()
            for key, raw in texts(batch):
                at = shape.places(len(raw))
                if not len(at) or key in seen:
                    continue
                seen.add(key)
                sums = tools.sums(np.frombuffer(raw, np.uint8))
                found, times = np.unique(tools.between(sums, at, at + shape.m), return_counts=True)
                names.append(found.view(np.int64))
                keys.append(np.full(len(found), key))
                twice.append(times > 1)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (names, keys, twice)], names=["name", "text_key", "twice"])

    return df.select("text_key", "text").mapInArrow(run, "name bigint, text_key bigint, twice boolean")


def around(shape: Shape, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the bytes around sampled positions, cut at the ends of the text."""
    return np.maximum(at - shape.v + 1, 0), np.minimum(at + shape.k, size)


def triples(df: DataFrame, shape: Shape) -> DataFrame:
    """(name, triple, text_key, at, low, high) of the sampled positions whose name is in ``names``.

    ``low`` and ``high`` bound the starts of k-byte strings that lead to the position.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        tools = hasher()
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            out = [[] for _ in range(6)]
            for (key, raw), some in zip(texts(batch), wanted):
                at = shape.places(len(raw))
                sums = tools.sums(np.frombuffer(raw, np.uint8))
                names = tools.between(sums, at, at + shape.m).view(np.int64)
                kept = np.isin(names, np.array(some, np.int64))
                at, names = at[kept], names[kept]
                a, b = around(shape, len(raw), at)
                triple = mixed(mixed(tools.between(sums, a, at)) + tools.between(sums, at, b)).view(np.int64)
                for column, value in zip(out, (names, triple, np.full(len(at), key), at, np.maximum(at - shape.v + 1, 0), np.minimum(at, len(raw) - shape.k))):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out],
                                                 names=["name", "triple", "text_key", "at", "low", "high"])

    return df.select("text_key", "text", "names").mapInArrow(
        run, "name bigint, triple bigint, text_key bigint, at bigint, low bigint, high bigint")


def sides(df: DataFrame, shape: Shape) -> DataFrame:
    """(name, half, part, alone, text_key, at, before, after) of single members of open names.

    Shifts up to the middle need half of the bytes after, the others half of those before: a name's
    members are dealt by that half, so a frequent name is split by what stands around it.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        tools = hasher()
        half = shape.v // 2
        for batch in batches:
            out = [[] for _ in range(8)]
            for (key, raw), marks in zip(texts(batch), batch.column(2).to_pylist()):
                sums = tools.sums(np.frombuffer(raw, np.uint8))
                for mark in marks:
                    at, after = mark["at"], mark["at"] + shape.m
                    before, behind = raw[max(0, at - shape.v + 1):at], raw[after:after + shape.v - 1]
                    # Shifts 0..half have at least half of the bytes after in common, the others half of those before.
                    for side, start, end in ((0, after, after + shape.v - 1 - half), (1, at - half - 1, at)):
                        if start >= 0 and end <= len(raw):
                            part = int(tools.between(sums, np.array([start]), np.array([end])).view(np.int64)[0])
                            for column, value in zip(out, (mark["name"], side, part, mark["alone"], key, at, before, behind)):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (
                pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                names=["name", "half", "part", "alone", "text_key", "at", "before", "after"])

    return df.select("text_key", "text", "marks").mapInArrow(
        run, "name bigint, half int, part bigint, alone boolean, text_key bigint, at bigint, before binary, after binary")


def shifts(name: np.ndarray, side: np.ndarray, before: list[bytes], after: list[bytes], shape: Shape) -> np.ndarray:
    """Row by shift: whether another member of the name has the same string there."""
    tools, w, rows = hasher(), shape.v - 1, len(name)
    left = np.zeros((rows, w), np.uint8)
    right = np.zeros((rows, w), np.uint8)
    ll, rl = np.array([len(b) for b in before]), np.array([len(b) for b in after])
    for i, (b, a) in enumerate(zip(before, after)):
        left[i, :len(b)] = np.frombuffer(b, np.uint8)[::-1]
        right[i, :len(a)] = np.frombuffer(a, np.uint8)
    both = []
    for block in (left, right):
        sums = np.zeros((rows, w + 1), np.uint64)
        np.cumsum(tools.letters[block] * tools.power[:w][None], axis=1, out=sums[:, 1:])
        both.append(sums)
    d = np.arange(w + 1)
    fits = (d[None] <= ll[:, None]) & (w - d[None] <= rl[:, None]) & ((d[None] > w // 2) == (side[:, None] == 1))
    keys = mixed(mixed(both[0] + d.astype(np.uint64)[None]) + both[1][:, ::-1] + name.view(np.uint64)[:, None])
    r, c = np.nonzero(fits)
    values = keys[r, c]
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    hit = np.zeros(len(values), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    out = np.zeros((rows, w + 1), bool)
    out[r[hit], c[hit]] = True
    return out


def merged(members: DataFrame, shape: Shape) -> DataFrame:
    """(text_key, low, high): ranges of starts that are repeats, from members sorted by name."""

    def finish(frame: pd.DataFrame) -> pa.RecordBatch:
        found = shifts(frame["name"].to_numpy(np.int64), frame["half"].to_numpy(), frame["before"].tolist(), frame["after"].tolist(), shape)
        found &= frame["alone"].to_numpy(bool)[:, None]
        edge = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
        r, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        keys, at = frame["text_key"].to_numpy(np.int64)[r], frame["at"].to_numpy(np.int64)[r]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(at - last + 1), pa.array(at - first)], names=["text_key", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]):
        waiting = None
        for batch in batches:
            frame = batch.to_pandas()
            waiting = frame if waiting is None else pd.concat([waiting, frame], ignore_index=True)
            if len(waiting) < 5000:
                continue
            same = ((waiting["name"] == waiting["name"].iloc[-1]) & (waiting["half"] == waiting["half"].iloc[-1])
                    & (waiting["part"] == waiting["part"].iloc[-1])).to_numpy()
            if not same.all():
                yield finish(waiting[~same])
                waiting = waiting[same].reset_index(drop=True)
        if waiting is not None and len(waiting):
            yield finish(waiting)

    dealt = members.repartition("name", "half", "part").sortWithinPartitions("name", "half", "part")
    return dealt.mapInArrow(run, "text_key bigint, low bigint, high bigint")


def removed(size: int, ranges: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """Maximal removed runs (start, end) from ranges of starts (low, high)."""
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        end = high + k
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([low, end])
    return [(a, min(b, size)) for a, b in out]


def repeats(df: DataFrame, k: int = 400, p: int = 13, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, found): ``df`` with ``text_key``, ``n_bytes`` and ``copies``, and per key its ranges of repeats.

    ``found`` has (text_key, text, ranges) for the texts that hold a repeat of another kind than
    whole copies; ``copies`` counts the rows that have exactly this text.
    """
    shape = Shape(k, p)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumn("text_key", F.xxhash64(whole, F.octet_length(whole)))
    distinct = rows.select("text_key", whole.alias("text")).where(F.octet_length("text") >= k)
    by_name = Window.partitionBy("name")
    names = sampled(distinct, shape)
    names = names.withColumn("open", (F.min("text_key").over(by_name) != F.max("text_key").over(by_name)) | F.max("twice").over(by_name))
    wanted = stored(names.where("open").groupBy("text_key").agg(F.collect_set("name").alias("names")))
    held = stored(sift(distinct, "text_key", wanted.select("text_key")).join(wanted.select("text_key"), "text_key").dropDuplicates(["text_key"]))
    marks = triples(held.join(wanted, "text_key"), shape)
    by_triple = Window.partitionBy("name", "triple")
    marks = stored(marks.withColumn("mixed", F.min("triple").over(by_name) != F.max("triple").over(by_name))
                   .withColumn("members", F.count("*").over(by_triple))
                   .withColumn("turn", F.row_number().over(by_triple.orderBy("text_key", "at"))))
    plain = marks.where("members > 1 AND low <= high").select("text_key", "low", "high")
    singles = (marks.where("mixed AND turn = 1").select("text_key", F.struct("name", "at", (F.col("members") == 1).alias("alone")).alias("mark"))
               .groupBy("text_key").agg(F.collect_list("mark").alias("marks")))
    open_ranges = merged(sides(held.join(singles, "text_key"), shape), shape)
    ranges = plain.unionByName(open_ranges).groupBy("text_key").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    return rows, held.join(ranges, "text_key")


def dedup(df: DataFrame, k: int = 400, p: int = 13, text: str = "text") -> DataFrame:
    """``df`` with ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``spans`` of every text.

    Every byte covered by a k-byte string that also starts anywhere else, in the same text or
    another, is removed; strings do not cross texts, overlaps count, and all is judged on the
    input. ``spans`` lists the maximal removed runs as (start, end) byte offsets. Null and empty
    texts have no bytes. Each row gives one row; equal rows are copies of each other, so texts of
    at least k bytes that occur twice are removed whole. Columns with these names are replaced,
    others stay. ``kept`` may end inside a character, so it is binary.
    """
    own, back = hidden(df.drop("kept", "n_bytes", "n_removed", "spans"), [text])
    rows, found = repeats(own, k, p, text)

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            kept, spans, keys = [], [], []
            for (key, raw), ranges in zip(texts(batch), batch.column(2).to_pylist()):
                runs = removed(len(raw), [(r["low"], r["high"]) for r in ranges], k)
                ends = [0, *(b for _, b in runs)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(raw)])))
                spans.append([{"start": a, "end": b} for a, b in runs])
                keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kept, pa.binary()), pa.array(
                spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["text_key", "cut", "cut_spans"])

    cuts = found.select("text_key", "text", "ranges").mapInArrow(cut, "text_key bigint, cut binary, cut_spans array<struct<start:bigint,end:bigint>>")
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    copies = rows.groupBy("text_key").agg(F.count("*").alias("copies")).where("copies > 1").select("text_key", F.lit(True).alias("copied"))
    joined = rows.withColumn("n_bytes", size).join(copies, "text_key", "left").join(cuts, "text_key", "left")
    gone = F.col("copied").isNotNull() & (F.col("n_bytes") >= k)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(gone, whole).otherwise(F.coalesce("cut_spans", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    kept = F.when(gone, F.lit(b"")).otherwise(F.coalesce("cut", F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return joined.withColumn("spans", spans).withColumn("kept", kept).withColumn("n_removed", total).select(*back, "kept", "n_bytes", "n_removed", "spans")
