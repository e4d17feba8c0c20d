"""Where known secrets stand in exported text.

The registry keeps no secret: only its SHA-256, its length and two rolling fingerprints, one of its
first 8, 4, 2 or 1 bytes (the gram) and one of the whole. A text is summed once; at every offset the
fingerprint of the gram is looked up in a bitmap of fixed size and then in the registry, the whole one
only where the gram is known, and SHA-256 decides. No text is cut into words, so a secret is found
with whatever signs, spaces or letters touch it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.rolling import Powers, Rolling, fingerprint

#: Secrets looked for in one pass over the texts (about 60 bytes each are sent to the tasks), and bits of the bitmap.
PASS, BITS = 200_000, 1 << 22
REGISTRY = "sha256 string, n_bytes bigint, gram bigint, whole bigint"


def _gram(size: int) -> int:
    return 8 if size >= 8 else 4 if size >= 4 else 2 if size >= 2 else 1


def secret_registry(secrets: DataFrame, column: str) -> DataFrame:
    """(sha256, n_bytes, gram, whole) of distinct secrets of any length; null and empty ones are left out."""
    def run(batches: Iterator[pd.DataFrame]):
        powers = Powers()
        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        for batch in batches:
            raw = [v.encode("utf-8", "surrogatepass") for v in batch.iloc[:, 0]]
            yield pd.DataFrame({
                "sha256": [hashlib.sha256(r).hexdigest() for r in raw], "n_bytes": [len(r) for r in raw],
                "gram": [signed(fingerprint(r[:_gram(len(r))], powers)) for r in raw], "whole": [signed(fingerprint(r, powers)) for r in raw]})

    value = F.col(column)
    return secrets.where(value.isNotNull() & (value != "")).select(value.alias("s")).distinct().mapInPandas(run, REGISTRY)


class Finder:
    """Registry rows laid out for lookups: by gram size the grams, and the lengths that follow each gram."""

    def __init__(self, rows: list[tuple[str, int, int, int]]) -> None:
        self.digests = {sha for sha, *_ in rows}
        self.whole = np.unique(np.array([w for *_, w in rows], np.int64).view(np.uint64))
        self.powers = Powers()
        self.sizes = {}
        for size in (1, 2, 4, 8):
            mine = sorted({(g & (2 ** 64 - 1), n) for _, n, g, _ in rows if _gram(n) == size})
            if mine:
                grams, first = np.unique(np.array([g for g, _ in mine], np.uint64), return_index=True)
                bits = np.zeros(BITS, bool)
                bits[grams & np.uint64(BITS - 1)] = True
                self.sizes[size] = bits, grams, np.append(first, len(mine)), np.array([n for _, n in mine], np.int64)

    def places(self, data: bytes) -> Iterator[tuple[str, int, int]]:
        """(sha256, offset, length) in bytes of every secret in ``data``, overlapping ones too."""
        text = Rolling(data, self.powers)
        for size, (bits, grams, first, lengths) in self.sizes.items():
            marks = text.all(size)
            at = np.flatnonzero(bits[marks & np.uint64(BITS - 1)])
            row = np.minimum(np.searchsorted(grams, marks[at]), len(grams) - 1)
            known = grams[row] == marks[at]
            at, row = at[known], row[known]
            # Each place is tried with the distinct lengths of its gram, however many secrets share it.
            count = first[row + 1] - first[row]
            start = np.repeat(at, count)
            length = lengths[np.arange(count.sum()) + np.repeat(first[row] - (np.cumsum(count) - count), count)]
            fits = start + length <= len(data)
            start, length = start[fits], length[fits]
            found = text.at(start, length)
            spot = np.minimum(np.searchsorted(self.whole, found), len(self.whole) - 1)
            good = self.whole[spot] == found
            for a, n in zip(start[good].tolist(), length[good].tolist()):
                digest = hashlib.sha256(data[a:a + n]).hexdigest()
                if digest in self.digests:
                    yield digest, a, n


def _passes(registry: DataFrame) -> Iterator[list[tuple]]:
    """The registry in parts of about ``PASS`` rows, one at a time on the driver."""
    parts = -(-registry.count() // PASS)
    slot = F.pmod(F.xxhash64("sha256"), F.lit(max(parts, 1)))
    for part in range(parts):
        yield [tuple(r) for r in registry.where(slot == part).select("sha256", "n_bytes", "gram", "whole").collect()]


def secret_places(texts: DataFrame, registry: DataFrame, text: str, keep: list[str], every: bool = True) -> DataFrame:
    """Rows ``keep`` + (sha256, offset, n_bytes): where known secrets stand, in bytes of the UTF-8 text.

    With ``every=False`` each secret is reported once per text, at its first place. Null texts have
    no rows. Registry rows without fingerprints can't be looked for (see ``leak_audit``). A registry
    larger than ``PASS`` is looked for in several passes over the texts.
    """
    spark = texts.sparkSession
    known = registry.where("n_bytes IS NOT NULL AND gram IS NOT NULL AND whole IS NOT NULL")
    rows = texts.select(*keep, F.encode(text, "UTF-8").alias("_data"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = (schema + ", " if schema else "") + "sha256 string, offset bigint, n_bytes bigint"
    out = None
    for part in _passes(known):
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent):
            finder = Finder(sent.value)
            for batch in batches:
                row, sha, at, size = [], [], [], []
                for i, data in enumerate(batch.column(batch.num_columns - 1)):
                    seen = set()
                    for digest, offset, n in sorted(finder.places(data.as_py() or b""), key=lambda h: h[1:]):
                        if every or digest not in seen:
                            seen.add(digest)
                            row.append(i)
                            sha.append(digest)
                            at.append(offset)
                            size.append(n)
                kept = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sha, pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64())],
                                                 names=[*batch.schema.names[:-1], "sha256", "offset", "n_bytes"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def leak_audit(texts: DataFrame, registry: DataFrame, text: str, artefact: str) -> DataFrame:
    """Known secrets found in exported text, per artefact class, with a verdict.

    A leak is a text that contains a secret, whatever stands around it; ``leaks`` counts (text, secret)
    pairs and ``secrets`` the distinct ones. ``skipped`` counts texts that could not be read (null) and
    ``unchecked`` registry rows that have a digest only. A class without leaks is clean only if both
    are 0, else NOT CHECKED. An empty registry fails. Only hits are shuffled.
    """
    hits = (secret_places(texts, registry, text, [artefact], every=False).groupBy(artefact, "sha256").agg(F.count("*").alias("_n"))
            .groupBy(artefact).agg(F.sum("_n").alias("leaks"), F.count("*").alias("secrets")))
    totals = registry.agg(F.countDistinct("sha256").alias("known"), F.count_if(F.col("n_bytes").isNull() | F.col("gram").isNull() | F.col("whole").isNull()).alias("bare"))
    classes = (texts.groupBy(artefact).agg(F.count("*").alias("texts"), F.count_if(F.col(text).isNull()).alias("skipped"))
               .withColumn("known_secrets", totals.select("known").scalar()).withColumn("unchecked", totals.select("bare").scalar()))
    leaks = F.coalesce("leaks", F.lit(0))
    verdict = (F.when(F.col("known_secrets") == 0, "FAIL: empty registry").when(F.col(artefact) == "evidence", "excluded")
               .when((leaks == 0) & (F.col("unchecked") + F.col("skipped") > 0), "NOT CHECKED").when(leaks == 0, "clean")
               .when(F.col(artefact) == "working", "private mode required").otherwise("FAIL: leak"))
    joined = classes.join(hits.withColumnRenamed(artefact, "_class"), F.col(artefact).eqNullSafe(F.col("_class")), "left")
    return joined.select(artefact, "texts", "skipped", "known_secrets", "unchecked", leaks.alias("leaks"),
                         F.coalesce("secrets", F.lit(0)).alias("secrets"), verdict.alias("verdict"))
