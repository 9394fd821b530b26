"""The queries op1 to op13: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.llm import bpe, gracehash, jaccard, langid, negatives, packing, pages, suffixes, toxicity, trie, urls, vectors
from loomcast.llm.common import table


def in_fold(divisor: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text leaves this rest."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == rest


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage of at least 50 words that a document shares with an earlier one, in words."""
    found = suffixes.repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), least=50)
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("start").alias("start_word"),
        (F.col("stop") - F.col("start")).alias("n_words"),
        F.col("other").alias("first_doc_id"),
        (F.col("start") - F.col("diag")).alias("first_start_word"),
    )


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.near_duplicates(rows, least=0.95)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~in_fold(5, 0)))
    return toxicity.score(docs.withColumn("held_out", in_fold(5, 0)), model).select("doc_id", "held_out", "score", "predicted")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~in_fold(3, 1)))
    named = langid.identify(docs.select("doc_id", "text", in_fold(3, 1).alias("held_out")), model)
    return named.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.top_k(rows, F.col("vec_id") % 20 == 0, k=20)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.extract(raw).select("page_id", "url", "text", "n_chars")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(found).select("page_id", "host", "path", "rule", "verdict")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed(docs)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and text packed into sequences, with a checksum in place of the ids."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"), size=5, percent=75)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gracehash.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("keep").alias("keep_id"), "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_dedup, op2_near_vectors, op3_toxicity, op4_language, op5_top_k, op6_html_text, op7_url_filters,
        op8_packing, op9_jaccard_join, op10_bpe, op11_exact_dedup,
        op12_prefix_trie, op13_hard_negatives,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_url_filters": urls.ORACLE,
        "op11_exact_dedup": gracehash.ORACLE,
        "op12_prefix_trie": trie.ORACLE,
        "op13_hard_negatives": negatives.ORACLE,
    }
