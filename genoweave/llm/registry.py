"""Queries of the operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoweave.llm import byte_gru, debruijn, decision_list, decontaminate, hard_negatives, mixing, parity_join, pu_quality, suffix, templates, toivonen, url_markov, warc
from genoweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"), 0)


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), [5, 2, 1])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.extract(table(spark, folder, "pages"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    return pu_quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    return parity_join.link(table(spark, folder, "documents"))


def op7_debruijn(spark: SparkSession, folder: str) -> DataFrame:
    return debruijn.digest(debruijn.remove(table(spark, folder, "documents")))


def op8_url_markov(spark: SparkSession, folder: str) -> DataFrame:
    return url_markov.judge(table(spark, folder, "pages"), url_markov.RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    judged = decision_list.judge(table(spark, folder, "documents"), table(spark, folder, "labels").filter(~pu_quality.held_out()))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.digest(suffix.dedup(table(spark, folder, "documents")))


def op11_toivonen(spark: SparkSession, folder: str) -> DataFrame:
    return toivonen.mine(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine(table(spark, folder, "embeddings"))


def op13_byte_gru(spark: SparkSession, folder: str) -> DataFrame:
    return byte_gru.identify(table(spark, folder, "documents"))


QUERIES = (op1_warc, op2_mixing, op3_templates, op4_decontaminate, op5_pu_quality, op6_parity_join, op7_debruijn, op8_url_markov, op9_decision_list, op10_suffix, op11_toivonen, op12_hard_negatives, op13_byte_gru)
ORACLES = {"op1_warc": warc.SQL, "op2_mixing": mixing.SQL, "op8_url_markov": url_markov.sql(url_markov.RULES), "op11_toivonen": toivonen.SQL, "op12_hard_negatives": hard_negatives.SQL}


def load() -> tuple[dict[str, Query], dict[str, str]]:
    return {f.__name__: f for f in QUERIES}, dict(ORACLES)
