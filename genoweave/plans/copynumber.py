"""Depth and allele-fraction windows to reviewed segments; mosaic-call review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.operators import copynumber as cn
from genoweave.operators import mosaic
from genoweave.operators.intervals import Span, merge_intervals, overlap_bases, overlap_join
from genoweave.session import cut_lineage


def corrected_bins(bins: DataFrame, k: int = 200) -> DataFrame:
    """Clean bins with GC-corrected relative depth ``rd``; needs the four mask fractions."""
    clean = cn.mask_bins(bins).filter("clean")
    return cn.relative_depth(cn.nearest_gc_depth(clean, k))


def follow_up(bins: DataFrame) -> dict[str, DataFrame]:
    """Noise, whole-chromosome screen, reviewed segments and the power grid of clean bins.

    ``bins``: sample, chrom, start, end, rd, bafdev, hets. They are written once, as several
    passes read them.
    """
    kept = cut_lineage(bins)
    centres = cut_lineage(cn.noise(kept, ["sample"], "rd", "rd").join(cn.noise(kept, ["sample"], "bafdev", "baf"), "sample"))
    found = cn.segments(cn.flag_bins(cn.local_shift(kept, centres)))
    lengths = kept.select("sample").distinct().withColumn("n", F.explode(F.array(*[F.lit(n) for n in cn.LENGTHS])))
    groups = cut_lineage(cn.placement_groups(kept, lengths))
    thresholds = cn.empirical_thresholds(groups, centres)
    return {
        "centres": centres,
        "chromosomes": cn.whole_chromosome(kept),
        "segments": cn.review_segments(found, kept, centres),
        "power": cn.power_grid(groups, centres, thresholds),
    }


def review_mosaic(calls: DataFrame, stats: DataFrame, masks: DataFrame, segments: DataFrame) -> DataFrame:
    """Gated mosaic calls with masked bases, special regions and overlapping segments.

    ``calls``: call_id, chrom, c_start, c_end and call fields. ``masks``: m_chrom, m_start, m_end.
    ``segments``: s_chrom, s_start, s_end, joint_support.
    """
    gated = mosaic.special_tags(mosaic.gate_columns(calls, stats), "c_start", "c_end")
    merged = merge_intervals(masks.select("m_chrom", "m_start", "m_end"), ["m_chrom"], "m_start", "m_end")
    span = Span("chrom", "c_start", "c_end")
    masked = overlap_bases(gated, ["call_id"], merged, span, Span("m_chrom", "m_start", "m_end"), "masked_bp")
    met = overlap_join(gated.select("call_id", "chrom", "c_start", "c_end"), segments, span, Span("s_chrom", "s_start", "s_end"))
    per = met.groupBy("call_id").agg(F.count("*").alias("rd_segments"), F.count_if("joint_support").alias("rd_joint_segments"))
    zero = F.lit(0)
    return (
        masked.join(per, "call_id", "left")
        .withColumn("rd_segments", F.coalesce("rd_segments", zero)).withColumn("rd_joint_segments", F.coalesce("rd_joint_segments", zero))
        .withColumn("masked_fraction", F.bround(F.col("masked_bp") / F.col("length"), 6))
    )
