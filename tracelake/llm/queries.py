"""Registered queries of this subpackage, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, hard_negatives, html_text, lexical, licenses, ngram_join, packing, passages, quality, suffix_dedup, surrogates, topk, tree_index
from tracelake.llm.common import read
from tracelake.session import prepare

VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file; the package that brings them is installed on the driver."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of at least 50 words that repeats an earlier one, with the one that is kept."""
    docs = passages.identified(read(prepare(spark), sf_dir, "documents").select("doc_id", "text"))
    return passages.find(docs).select(
        "doc_id", "first_word", "n_words", "kept_doc_id", "kept_first_word", "kept_words", "similarity")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of 5-word shingles and the component of its near duplicates."""
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return ngram_join.link(docs).select("doc_id", "n_shingles", "component_id")


def op3_topk(spark: SparkSession, sf_dir: str, k: int = 20, every: int = 20) -> DataFrame:
    """The best inner products of every 20th vector with all others, exactly."""
    return topk.top_k(read(prepare(spark), sf_dir, "embeddings").select("vec_id", "embedding"), k, every)


def op4_quality(spark: SparkSession, sf_dir: str, fold: int = 2) -> DataFrame:
    """Quality score of every document; learned from labels outside the held-out fold only."""
    spark = prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), fold=fold)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == fold, F.lit(False))
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    spark = prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, path or vocabulary())
    return coded.select("doc_id", "n_tokens", F.sha2("packed_ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op6_surrogates(spark: SparkSession, sf_dir: str, key: str = "surrogate-key") -> DataFrame:
    """Every document with surrogates for personal data, and what was replaced."""
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, key).select("doc_id", "text", F.col("n_entities").cast("long").alias("n_entities"), "kinds")


def op7_ann(spark: SparkSession, sf_dir: str, k: int = 10, every: int = 100) -> DataFrame:
    """The nearest vectors found for every 100th vector."""
    return tree_index.search(read(prepare(spark), sf_dir, "embeddings").select("vec_id", "embedding"), k, every)


def op8_packing(spark: SparkSession, sf_dir: str, path: str | None = None, width: int = 1024) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most ``width`` tokens."""
    spark = prepare(spark)
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), path or vocabulary(), width)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(prepare(spark), sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 400 bytes."""
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                           F.sha2("kept", 256).alias("kept_sha256"), F.col("kept").try_cast("string").alias("text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector's positives; every seventh vector has the next label."""
    rows = read(prepare(spark), sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases, labels and a score of every document."""
    docs = licenses.scan(read(prepare(spark), sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return docs.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min("base_places.first_word").alias("first_word"),
        F.array_max("base_places.first_word").alias("last_word"), joined(F.col("base_places.label")).alias("base_labels"),
        joined(F.concat(F.col("base_places.label"), F.col("found.label"))).alias("labels"), "score")


def op13_lexical(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The documents that score highest for every benchmark item."""
    spark = prepare(spark)
    return lexical.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"), k)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_passages": op1_passages,
    "op2_ngram_join": op2_ngram_join,
    "op3_topk": op3_topk,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_surrogates": op6_surrogates,
    "op7_ann": op7_ann,
    "op8_packing": op8_packing,
    "op9_html": op9_html,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_licenses": op12_licenses,
    "op13_lexical": op13_lexical,
}
ORACLES: dict[str, str] = {"op11_hard_negatives": hard_negatives.SQL, "op13_lexical": lexical.SQL}
