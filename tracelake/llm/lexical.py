"""Ranked lexical search by presence masks.

Documents are reduced to forward rows: their number of terms and the query terms they hold. A task
takes its documents in blocks. Inside a block every query term has a bitmap of the documents that
hold it. For an item, the bitmaps of its terms are laid side by side and turned, so that each
document gets the mask of the item's terms that it holds; documents with equal masks form a group. A
mask's largest possible score is the sum, over its terms, of the largest contribution the term has
in the block. Masks are evaluated by falling largest score until the next one lies below the item's
last kept score; inside a mask all documents are scored. Nothing is skipped that could still count,
ties included, so the answer is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import stored

#: Documents and postings of one block in a task; items are taken in blocks of about so many bytes of text.
BLOCK, POSTINGS, ITEMS = 8192, 4_000_000, 4_000_000
#: Documents scored at once while masks are evaluated.
STEP = 64
HITS = "item_id bigint, doc_id bigint, score bigint"

#: Letters and digits of ASCII and all other characters are parts of terms; A-Z count as a-z.
_PART = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes | str | None) -> list[bytes]:
    """Terms of a text in order, in UTF-8."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    return raw.translate(_PART).split()


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``documents`` documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _reduced(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, held): term count of every document with terms, and its query terms with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        known = sent.value
        for batch in batches:
            ids, sizes, held = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                found = terms(text.as_py())
                if found:
                    mine = [(known[t], n) for t, n in Counter(found).items() if t in known]
                    ids.append(doc)
                    sizes.append(len(found))
                    held.append(np.array(sorted(mine), np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())],
                                             names=["doc_id", "n", "held"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n bigint, held binary")


def _holding(rows: DataFrame, size: int) -> dict[int, int]:
    """How many documents hold each query term; summed inside each task first."""
    def run(batches: Iterator[pa.RecordBatch]):
        count = np.zeros(size, np.int64)
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)[::2]
            count += np.bincount(at, minlength=size)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(count[there])], names=["term", "df"])

    found = rows.select("held").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in found.collect()}


class Block:
    """Some documents with their query terms: contributions by document and by term, and bitmaps by term."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, sizes: np.ndarray, held: list[bytes], weights: np.ndarray, stats: tuple[int, int]) -> None:
        self.ids, self.null = ids, null
        pairs = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2)
        lengths = np.array([len(h) // 16 for h in held], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.term, tf = pairs[:, 0], pairs[:, 1]
        doc = np.repeat(np.arange(len(ids)), lengths)
        total, length = stats
        m = np.array([10 + 90 * int(n) * total // length for n in sizes], np.int64) if total * int(sizes.max(initial=0)) >= 2 ** 56 else 10 + 90 * sizes * total // length
        self.gain = weights[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.argsort(self.term, kind="stable")
        self.present, first = np.unique(self.term[order], return_index=True)
        self.most = np.maximum.reduceat(self.gain[order], first) if len(first) else np.zeros(0, np.int64)
        self.bits = np.zeros((len(self.present), -(-len(ids) // 8)), np.uint8)
        line = np.zeros(len(ids), np.uint8)
        for row, (a, b) in enumerate(zip(first, [*first[1:], len(order)])):
            at = doc[order[a:b]]
            line[at] = 1
            self.bits[row] = np.packbits(line)
            line[at] = 0

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``asked`` marks the item's terms."""
        lengths = self.ends[docs] - self.starts[docs]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[docs] - (ends - lengths), lengths)
        running = np.concatenate([[0], np.cumsum(self.gain[at] * asked[self.term[at]])])
        return running[ends] - running[ends - lengths]

    def groups(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Masks (one row of bits each), documents in the order of masks, and each mask's first and last place there."""
        turned = np.unpackbits(self.bits[rows], axis=1, count=len(self.ids)).T
        held = np.flatnonzero(turned.any(1))
        masks = np.packbits(turned[held], axis=1)
        wide = np.zeros((len(held), -(-masks.shape[1] // 8) * 8), np.uint8)
        wide[:, :masks.shape[1]] = masks
        words = wide.view(np.uint64)
        order = np.lexsort(words.T)
        sorted_words = words[order]
        new = np.flatnonzero(np.concatenate([[True], (sorted_words[1:] != sorted_words[:-1]).any(1)])) if len(held) else np.zeros(0, np.int64)
        return turned[held[order[new]]], held[order], new, np.append(new[1:], len(held))


class Kept:
    """The k best (score, id) of one item; ties go to the smaller id, rows without an id come last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        """The score below which nothing enters."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        best = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.id, self.null = score[best], ids[best], null[best]


def take(block: Block, item: np.ndarray, size: int, kept: Kept) -> int:
    """Add a block's documents that can be among an item's best; returns how many were scored."""
    rows = np.searchsorted(block.present, item)
    rows = rows[(rows < len(block.present)) & (block.present[np.minimum(rows, len(block.present) - 1)] == item)] if len(block.present) else rows[:0]
    if not len(rows) or block.most[rows].sum() < kept.floor():
        return 0
    masks, docs, first, last = block.groups(rows)
    bounds = masks.astype(np.int64) @ block.most[rows]
    asked = np.zeros(size, np.int64)
    asked[item] = 1
    order = np.argsort(-bounds, kind="stable")
    done = at = 0
    while at < len(order) and bounds[order[at]] >= kept.floor():
        end, count = at, 0
        while end < len(order) and count < STEP and bounds[order[end]] >= kept.floor():
            count += last[order[end]] - first[order[end]]
            end += 1
        chosen = np.concatenate([docs[first[g]:last[g]] for g in order[at:end]])
        found = block.scores(chosen, asked)
        good = found >= kept.floor()
        kept.add(found[good], block.ids[chosen[good]], block.null[chosen[good]])
        done += count
        at = end
    return done


def _best(rows: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, stats: tuple[int, int], k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's ``k`` best documents of every item."""
    sent = rows.sparkSession.sparkContext.broadcast((items, weights, stats))

    def blocks(batches: Iterator[pa.RecordBatch]):
        wanted, weigh, about = sent.value
        ids, null, sizes, held, full = [], [], [], [], 0
        for batch in batches:
            for doc, n, mine in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids.append(doc or 0)
                null.append(doc is None)
                sizes.append(n)
                held.append(mine)
                full += len(mine) // 16
                if len(ids) == BLOCK or full >= POSTINGS:
                    yield Block(np.array(ids, np.int64), np.array(null), np.array(sizes, np.int64), held, weigh, about)
                    ids, null, sizes, held, full = [], [], [], [], 0
        if ids:
            yield Block(np.array(ids, np.int64), np.array(null), np.array(sizes, np.int64), held, weigh, about)

    def run(batches: Iterator[pa.RecordBatch]):
        wanted, weigh, _ = sent.value
        best = [Kept(k) for _ in wanted]
        for block in blocks(batches):
            for (_, item), kept in zip(wanted, best):
                take(block, item, len(weigh), kept)
        for (item_id, _), kept in zip(wanted, best):
            if len(kept.score):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(kept.score), item_id, np.int64)), pa.array(kept.id, mask=kept.null), pa.array(kept.score)],
                    names=["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, HITS)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` documents that score highest for each item, above 0.

    ``docs`` has (doc_id, text), ``items`` (item_id, text); other columns are not read. Items without
    an id take no part; of rows that share an ``item_id`` the smallest text stands. Every row of
    ``docs`` is a document of its own, repeated ones too; a null or empty text has no terms and is not
    counted. Rows without a ``doc_id`` are found like others, last among equal scores. Items without
    terms, and any item if no document has terms, give no rows.

    Items are taken in blocks by hash of their id, so that what is broadcast (a block's terms and
    weights) is bounded by ``ITEMS`` bytes of text or by a single longer item, whatever their number.
    """
    spark = docs.sparkSession
    asked = items.where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // ITEMS)
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for part in range(parts):
        block = [(r["item_id"], sorted(set(terms(r["text"])))) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, found in block for t in found}))}
        if not vocabulary:
            continue
        rows = stored(_reduced(docs, vocabulary))
        total, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            continue
        holding = _holding(rows, len(vocabulary))
        weights = np.array([weight(total, holding.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        wanted = [(i, np.array([vocabulary[t] for t in found], np.int64)) for i, found in sorted(block) if found]
        hits = _best(rows, wanted, weights, (total, length), k)
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = out.unionByName(best.select("item_id", "rank", "doc_id", "score"))
    return out


#: The same search in SQL, document by document.
SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row_number() OVER () AS r, doc_id, found, CAST(len(found) AS BIGINT) AS n FROM cut WHERE len(found) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(found) AS term FROM docs) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, whole GROUP BY term, docs),
items AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
scored AS (
  SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // length))))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN docs USING (r), whole
  GROUP BY item_id, r),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place
  FROM scored JOIN docs USING (r) WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""
