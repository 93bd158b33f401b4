"""Corpus pipeline: quality, near duplicates, repeated strings, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and is written
before the next one starts. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoweave.llm import decontaminate, mixing, parity_join, pu_quality, suffix
from genoweave.llm.common import table
from genoweave.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WEIGHTS = (5, 2, 1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts; labels of held-out rows are not read."""
    docs = docs.select(*COLUMNS)
    labels = table(spark, sf_dir, "labels").filter(~pu_quality.held_out())
    return pu_quality.keep_good(docs, pu_quality.train(docs.filter(~pu_quality.held_out()), labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id; of equal rows under one id, one."""
    docs = docs.select(*COLUMNS)
    linked = cut_lineage(parity_join.link(docs.select("doc_id", "text")))
    losers = linked.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(losers, "doc_id", "left_anti").select(*COLUMNS)
    again = cut_lineage(linked.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if again.limit(1).count():
        once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)
    return kept


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes that an earlier document holds; a text of which nothing is left goes."""
    left = suffix.dedup(docs.select(*COLUMNS), ("lang", "source"), whole_chars=True)
    left = left.filter("n_bytes = 0 or octet_length(kept) > 0")
    text = F.col("kept").cast("string")
    return left.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised or not."""
    docs = docs.select(*COLUMNS)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document that the mixture takes, and the words they come to."""
    mixed = mixing.mix(docs, list(WEIGHTS))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("benchmark_leaks", benchmark_leaks), ("mixture", mixture)]

#: No stage but the last can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    return reduce(lambda docs, stage: cut_lineage(stage[1](spark, docs, sf_dir)), STAGES, table(spark, sf_dir, "documents"))
