"""Mosaic-call gates, waterfall, ablation and review counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Gate names in the order they apply.
GATES = (
    "sample_qc",
    "not_CNP",
    "marker_spacing_or_phase_concordance",
    "bdev_precision_or_strong_phase",
    "not_germline_like_gain",
)
# Regions reviewed apart (GRCh38, half-open).
SPECIAL_REGIONS = (("MHC", "chr6", 27518931, 33480487), ("KIR", "chr19", 54071492, 54992731))


def _strong(lod):
    """A LOD that is a number above ten; literal nan is a state of its own."""
    return lod.isNotNull() & ~F.isnan(lod) & (lod > 10)


def gate_columns(calls: DataFrame, stats: DataFrame) -> DataFrame:
    """Join sample statistics and add the five boolean gates; a call without statistics fails the sample gate."""
    c = F.col
    joined = calls.join(stats.select("sample_id", "call_rate", "baf_auto"), "sample_id", "left")
    gates = {
        "sample_qc": F.coalesce(~((c("call_rate") < 0.97) | (c("baf_auto") > 0.03)), F.lit(False)),
        "not_CNP": ~c("type").startswith("CNP"),
        "marker_spacing_or_phase_concordance": (F.instr("chrom", "X") > 0) & (c("computed_gender") == "M")
        | (c("bdev") < 0.1) | (c("n50_hets") < 200000) | _strong(c("lod_baf_conc")),
        "bdev_precision_or_strong_phase": (c("bdev_se").isNotNull() & ~F.isnan("bdev_se")) | _strong(c("lod_baf_phase")),
        "not_germline_like_gain": (c("rel_cov") < 2.1) | (c("bdev") < 0.05)
        | ((c("length") > 500000) & (c("bdev") < 0.1) & (c("rel_cov") < 2.5))
        | ((c("length") > 5000000) & (c("bdev") < 0.15)),
    }
    out = joined
    for name in GATES:
        out = out.withColumn(name, gates[name])
    first = F.coalesce(*[F.when(~F.col(g), F.lit(g)) for g in GATES], F.lit("none"))
    failed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(g), F.lit(g)) for g in GATES])), ";")
    mask = sum(((~F.col(g)).cast("int") * F.lit(1 << i) for i, g in enumerate(GATES)), F.lit(0))
    return out.withColumn("first_failed_gate", first).withColumn("failed_gates", failed).withColumn("failed_mask", mask)


def waterfall(gated: DataFrame) -> DataFrame:
    """before / excluded / after per gate in order, from one histogram of first failures."""
    # Five expressions over one row of counts.
    row = gated.agg(F.count("*").alias("all"), *[F.count_if(F.col("first_failed_gate") == g).alias(g) for g in GATES])
    steps, before = [], F.col("all")
    for i, g in enumerate(GATES):
        after = before - F.col(g)
        steps.append(F.struct(F.lit(i).alias("step"), F.lit(g).alias("gate"), before.alias("before"), F.col(g).alias("excluded"), after.alias("after")))
        before = after
    return row.select(F.explode(F.array(*steps)).alias("s")).select("s.*")


def ablation_counts(gated: DataFrame) -> DataFrame:
    """Retained calls for every subset of disabled gates.

    Calls first collapse to at most 32 failure patterns; only those meet the 32 subsets.
    """
    patterns = gated.groupBy("failed_mask").agg(F.count("*").alias("calls"))
    every = patterns.withColumn("disabled", F.explode(F.sequence(F.lit(0), F.lit((1 << len(GATES)) - 1))))
    kept = F.col("failed_mask").bitwiseAND(F.bitwise_not(F.col("disabled"))) == 0
    return every.groupBy("disabled").agg(F.sum(F.when(kept, F.col("calls")).otherwise(0)).alias("retained"))


def ablation_members(gated: DataFrame, call_id: str) -> DataFrame:
    """(disabled subset, retained call) pairs: the listing behind the counts."""
    disabled = F.explode(F.filter(F.sequence(F.lit(0), F.lit((1 << len(GATES)) - 1)), lambda d: F.col("failed_mask").bitwiseAND(F.bitwise_not(d)) == 0))
    return gated.select(disabled.alias("disabled"), call_id)


def gate_failures(gated: DataFrame) -> DataFrame:
    """Failing calls per gate, overall and outside copy-number polymorphisms."""
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), (~F.col(g)).alias("fails")) for g in GATES]))
    return (
        gated.select(pairs.alias("p"), F.col("type").startswith("CNP").alias("cnp"))
        .groupBy(F.col("p.gate").alias("gate"))
        .agg(F.count_if(F.col("p.fails")).alias("failing_all"), F.count_if(F.col("p.fails") & ~F.col("cnp")).alias("failing_non_cnp"))
    )


def special_tags(calls: DataFrame, start: str, end: str, chrom: str = "chrom") -> DataFrame:
    """Names of special regions a call overlaps; the list is two fixed rows, so no join is needed."""
    hits = [
        F.when((F.col(chrom) == c) & (F.col(start) < b) & (F.col(end) > a), F.lit(name)) for name, c, a, b in SPECIAL_REGIONS
    ]
    return calls.withColumn("special_regions", F.array_join(F.array_compact(F.array(*hits)), ";"))


def review_counters(calls: DataFrame) -> DataFrame:
    """Summary counters of reviewed calls (``masked_fraction``, overlap counts included)."""
    c = F.col
    return calls.agg(
        F.count("*").alias("calls"),
        F.count_if(~F.isnan("lod_baf_phase") & (c("lod_baf_phase") > 5)).alias("phase_lod_gt5"),
        F.count_if(~F.isnan("lod_baf_phase") & (c("lod_baf_phase") > 10)).alias("phase_lod_gt10"),
        F.count_if(c("n_hets") == 0).alias("zero_het_calls"),
        F.count_if(c("n_hets") < 10).alias("below_10_het_calls"),
        F.count_if(c("masked_fraction") > 0.5).alias("majority_masked"),
        F.count_if(c("rd_segments") > 0).alias("rd_overlapping"),
        F.count_if(c("rd_joint_segments") > 0).alias("rd_joint_supported"),
    )
