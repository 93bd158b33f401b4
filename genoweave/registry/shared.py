"""Typed forms of the views for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.functions import genotype as fg
from genoweave.operators import reads as ord_


def filters_of(flt):
    return F.when(flt == ".", F.array().cast("array<string>")).otherwise(F.array(flt))


def calls(v) -> DataFrame:
    """v_calls with arrays; AD is absent on every eighth call."""
    df = v("v_calls").withColumnRenamed("gt", "gt_text")
    return (
        df.withColumn("gt", fg.parse_gt(F.col("gt_text")))
        .withColumn("phased", fg.is_phased(F.col("gt_text")))
        .withColumn("filters", filters_of(F.col("flt")))
        .withColumn("alts", F.array("alt"))
        .withColumn("ad", F.when(F.col("src_row") % 8 != 3, F.array("ad0", "ad1")))
        .withColumn("pl", F.array("pl0", "pl1", "pl2"))
    )


AD_SQL = "src_row%8<>3"


def multi(v) -> DataFrame:
    df = v("v_multi").withColumnRenamed("gt", "gt_text")
    two = F.col("n_alts") == 2
    return df.select(
        "contig", "pos", "src_row", "ref", "flt", "gt_text", "dp", "gq",
        F.when(two, F.array("alt", "alt2")).otherwise(F.array("alt")).alias("alts"),
        fg.parse_gt(F.col("gt_text")).alias("gt"), fg.is_phased(F.col("gt_text")).alias("phased"), filters_of(F.col("flt")).alias("filters"),
        F.when(two, F.array("ad0", "ad1", "ad2")).otherwise(F.array("ad0", "ad1")).alias("ad"),
        F.when(two, F.array("pl0", "pl1", "pl2", "pl3", "pl4", "pl5")).otherwise(F.array("pl0", "pl1", "pl2")).alias("pl"),
    )


def annotated(v) -> DataFrame:
    return (
        v("v_annotated")
        .withColumn("gts", F.array(fg.parse_gt(F.col("gt"))))
        .withColumn("clnsig", F.array("clnsig"))
        .withColumn("review", F.array("review"))
    )


def reads(v, walk: bool = True) -> DataFrame:
    return ord_.prepare_reads(v("v_sam").drop("shape"), walk)


def exons(v) -> DataFrame:
    return v("v_exons").withColumnRenamed("e_start", "start").withColumnRenamed("e_end", "end")


def svs(v) -> DataFrame:
    return v("v_sv").withColumnRenamed("flt", "filter").withColumnRenamed("sv_end", "end").withColumn("svlen", F.lit(None).cast("long"))


def mosaic(v) -> tuple[DataFrame, DataFrame]:
    df = v("v_mosaic")
    names = {"len": "length", "lod_conc": "lod_baf_conc", "lod_phase": "lod_baf_phase", "typ": "type"}
    return df.withColumnsRenamed(names), v("v_mosaic_stats")


def bins(v, clean: bool = True) -> DataFrame:
    return v("v_clean" if clean else "v_bins").withColumnsRenamed({"b_start": "start", "b_end": "end"})


def seq_records(v) -> DataFrame:
    return v("v_reads").filter(F.length("seq") > 0).select(F.concat(F.lit("doc"), F.col("doc_id")).alias("contig"), "seq")
