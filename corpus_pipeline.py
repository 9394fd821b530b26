"""The corpus pipeline: five stages over `documents`, each by one of the operators in loomcast.llm.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the columns of docs.  Stages but the last keep
documents with null or empty texts, unless they are rejected by the rule of the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.llm import jaccard, langid, suffixes, toxicity
from loomcast.llm.common import join_few, stored, table, unused
from loomcast.llm.queries import in_fold, packed


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5.  The model learns from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~in_fold(5, 0)))
    points, label = unused(docs.columns, "_score", "_toxic")
    scored = toxicity.score(docs, model, names=(points, label))
    return scored.where(F.col(label) == 0).select(*docs.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model doesn't reject: with letters, and not far from every language it has learned."""
    model = langid.fit(docs.where(~in_fold(3, 1)))
    lang, points, rejected = unused(docs.columns, "_lang", "_score", "_rejected")
    named = langid.identify(docs, model, names=(lang, points, rejected))
    return named.where(~F.col(rejected)).select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies, and all that are in none.

    Of rows that repeat doc_id and text one stays.  Different texts that share a doc_id are documents of their own; of
    those in one group the one with the smaller hash stays.  Rows with a null doc_id stay.
    """
    shared = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not shared.head(1):
        groups = jaccard.join(docs.select("doc_id", "text"))
        gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again, number = unused(docs.columns, "_again", "_number")
    marked = join_few(docs, stored(shared.withColumn(again, F.lit(True))), "doc_id", "left")
    keyed = marked.withColumn(number, F.when(F.col(again), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long")))
    groups = jaccard.join(keyed.select(number, "text"), key=number).select(number, "component_id")
    ids = groups.join(keyed.select(number, "doc_id"), number).distinct()
    first = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", number)).alias("first"))
    gone = ids.join(first, "component_id").where(F.col(number) != F.col("first")[number]).select(number).distinct()
    left = stored(keyed.join(gone, number, "left_anti"))
    return left.where(F.col(again).isNull()).union(left.where(again).dropDuplicates([number])).select(*docs.columns)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document has."""
    return suffixes.cut(docs, suffixes.repeated(docs.select("doc_id", "text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each token piece with its sequence and its place there."""
    return packed(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxic_out), ("language", languages), ("near_copies", near_copies_out), ("repeats", repeats_out), ("packing", packing)]

#: The stages learn models, find connected groups and encode tokens, which SQL doesn't express; tests hold them to
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
