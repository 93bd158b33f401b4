"""Genotype states, call quality and eligibility reasons; missing never reads as zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_gt(text: Column) -> Column:
    """'0/1' to [0, 1]; '.' stays NULL inside the array."""
    return F.transform(F.split(text, "[/|]"), lambda a: a.try_cast("int"))


def is_phased(text: Column) -> Column:
    return F.instr(text, "|") > 0


def parse_ints(text: Column) -> Column:
    return F.when(text.isNotNull() & (text != "."), F.transform(F.split(text, ","), lambda a: a.try_cast("int")))


def has_missing(gt: Column) -> Column:
    return gt.isNull() | F.exists(gt, lambda a: a.isNull())


def nonref_count(gt: Column) -> Column:
    return F.size(F.filter(gt, lambda a: a.isNotNull() & (a > 0)))


def called_alt(gt: Column) -> Column:
    """An ALT is explicitly called, also inside a partial genotype; never NULL."""
    return F.coalesce(nonref_count(gt) > 0, F.lit(False))


def genotype_state(gt: Column) -> Column:
    nonref = nonref_count(gt)
    return (
        F.when(has_missing(gt), "missing_or_partial")
        .when(nonref == 0, "reference")
        .when(F.size(gt) == 1, "hemizygous_alt")
        .when(nonref == F.size(gt), "homozygous_alt")
        .otherwise("heterozygous_alt")
    )


def cohort_state(gts: Column) -> Column:
    """One state over all samples of a row; no samples reads as complete reference."""
    partial = F.exists(gts, has_missing)
    every = (F.size(gts) > 0) & ~F.exists(gts, lambda g: has_missing(g) | (nonref_count(g) == 0))
    return (
        F.when(every, "complete_nonreference")
        .when(partial, "partial_or_missing")
        .otherwise("complete_reference")
    )


def cohort_called_alt(gts: Column) -> Column:
    """Every sample calls an ALT explicitly."""
    return (F.size(gts) > 0) & ~F.exists(gts, lambda g: ~called_alt(g))


def alt_present_text(gt: Column) -> Column:
    return F.exists(F.split(gt, "[/|]"), lambda a: ~a.isin("0", "."))


def gt_text(gt: Column, phased: Column) -> Column:
    alleles = gt.cast("array<string>")
    return F.when(phased, F.array_join(alleles, "|", ".")).otherwise(F.array_join(alleles, "/", "."))


def pl_index(gt: Column) -> Column:
    """Triangular likelihood index of a complete diploid genotype."""
    low, high = F.array_min(gt), F.array_max(gt)
    complete = (F.size(gt) == 2) & ~has_missing(gt)
    return F.when(complete, (high * (high + 1) / 2 + low).cast("int"))


def _complete(values: Column) -> Column:
    return values.isNotNull() & ~F.exists(values, lambda v: v.isNull())


def het_pl_gap(pl: Column) -> Column:
    """min(PL of both homozygotes) - PL of the het, only where the het is the best state."""
    ok = _complete(pl) & (F.size(pl) == 3)
    gap = F.least(pl[0], pl[2]) - pl[1]
    return F.when(ok & (pl[1] == F.array_min(pl)), gap)


def filter_label(filters: Column) -> Column:
    """PASS, dot (no filter applied) or the joined filter names; dot is never PASS."""
    return F.when(F.size(filters) == 0, "dot").otherwise(F.array_join(filters, ";"))


def filter_class(flt: Column) -> Column:
    """dot / pass / other of FILTER text."""
    return F.when(flt == ".", "dot").when(flt == "PASS", "pass").otherwise("other")


def call_quality(gt: Column, ad: Column, pl: Column, dp: Column, gq: Column, filters: Column) -> Column:
    """Depth, balance, likelihood margin and threshold checks, each TRUE, FALSE or NULL."""
    state = genotype_state(gt)
    usable = F.filter(ad, lambda v: v.isNotNull() & (v >= 0))
    ad_sum = F.when(F.size(ad) > 0, F.aggregate(usable, F.lit(0), lambda s, v: s + v))
    depth = F.coalesce(dp, ad_sum)
    second = F.get(ad, F.lit(1))
    alt_depth = F.when(second >= 0, second)
    balance = F.when(ad_sum > 0, alt_depth / ad_sum)
    index = pl_index(gt)
    scored = _complete(pl) & (F.size(pl) > 0) & index.isNotNull() & (index < F.size(pl))
    ordered = F.array_sort(pl)
    margin = F.when(scored & (F.size(pl) > 1), F.get(ordered, F.lit(1)) - F.get(ordered, F.lit(0)))
    called = called_alt(gt)
    return F.struct(
        state.alias("genotype_state"),
        ((state == "missing_or_partial") & called).alias("requires_original_genotype_review"),
        depth.alias("depth"),
        F.when(dp.isNotNull(), "FORMAT/DP").when(ad_sum.isNotNull(), "sum(FORMAT/AD)").alias("depth_source"),
        alt_depth.alias("alt_depth"),
        balance.alias("allele_balance"),
        F.when(scored, F.get(pl, index) == F.array_min(pl)).alias("called_pl_is_min"),
        margin.alias("pl_margin"),
        called.alias("called_alt_present"),
        (~state.isin("missing_or_partial", "reference")).alias("complete_nonreference"),
        (filter_label(filters) == "PASS").alias("filter_pass"),
        (depth >= 10).alias("depth_at_least_10"),
        (gq >= 20).alias("gq_at_least_20"),
        (margin >= 20).alias("pl_margin_at_least_20"),
        F.when(state == "heterozygous_alt", balance.between(0.2, 0.8)).alias("het_balance_ok"),
    )


def _first_reason(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that fires, NULL when none does; NULL conditions do not fire."""
    return F.coalesce(*[F.when(F.coalesce(fires, F.lit(False)), F.lit(name)) for fires, name in rules])


def _is_simple_het(gt: Column) -> Column:
    return F.coalesce((F.size(gt) == 2) & (F.array_join(F.array_sort(gt), "") == "01"), F.lit(False)) & ~has_missing(gt)


def phasing_reason(
    gt: Column,
    filters: Column,
    qual: Column,
    dp: Column,
    gq: Column,
    ad: Column,
    pl: Column,
    ref: Column,
    alts: Column,
    min_qual: float | None = None,
    min_dp: int | None = None,
    min_gq: int | None = None,
    min_pl_gap: int | None = None,
    min_ad: int | None = None,
    depth_from_ad: bool = False,
) -> Column:
    """Why a call is no phasing marker (NULL = keep); the first failing rule is named."""
    depth = dp
    if depth_from_ad:
        valid = _complete(ad) & ~F.exists(ad, lambda v: v < 0)
        depth = F.coalesce(dp, F.when(valid, F.aggregate(ad, F.lit(0), lambda s, v: s + v)))
    never = F.lit(False)
    weak_gq = never
    if min_gq is not None:
        weak_gq = gq.isNull() | (gq < min_gq)
        if min_pl_gap is not None:
            gap = het_pl_gap(pl)
            weak_gq = weak_gq & (gap.isNull() | (gap < min_pl_gap))
    low_ad = never
    if min_ad is not None:
        first, second = F.get(ad, F.lit(0)), F.get(ad, F.lit(1))
        low_ad = ad.isNotNull() & (first.isNull() | second.isNull() | (first < min_ad) | (second < min_ad))
    alt = F.get(alts, F.lit(0))
    return _first_reason(
        (~_is_simple_het(gt), "gt_not_called_diploid_ref_alt"),
        ((F.size(filters) > 0) & (F.array_join(F.array_distinct(filters), ";") != "PASS"), "filter_not_pass"),
        (never if min_qual is None else qual.isNull() | (qual < min_qual), "qual_below_minimum"),
        (never if min_dp is None else depth.isNull() | (depth < min_dp), "dp_below_minimum_or_missing"),
        (weak_gq, "gq_or_pl_below_minimum_or_missing"),
        (low_ad, "ad_below_minimum"),
        (F.size(alts) != 1, "not_biallelic"),
        (~(ref.rlike("^[ACGT]+$") & alt.rlike("^[ACGT]+$")), "alleles_not_acgt"),
        ((F.length(ref) == F.length(alt)) & ((F.length(ref) > 1) | (ref == alt)), "not_snv_or_indel"),
    )


def baf_reason(gt: Column, filters: Column, qual: Column, ad: Column, pl: Column, ref: Column, alts: Column) -> Column:
    """Why a call gives no B-allele fraction (NULL = accepted het SNV)."""
    alt = F.get(alts, F.lit(0))
    total = F.get(ad, F.lit(0)) + F.get(ad, F.lit(1))
    gap = F.least(F.get(pl, F.lit(0)), F.get(pl, F.lit(2))) - F.get(pl, F.lit(1))
    complete_pl = _complete(pl) & (F.size(pl) == 3)
    return _first_reason(
        ((F.length(ref) != 1) | (F.size(alts) != 1) | (F.length(alt) != 1), "not_biallelic_snv"),
        ((F.size(F.array_except(filters, F.array(F.lit("PASS"), F.lit(".")))) > 0)
         | (F.coalesce(qual, F.lit(0.0)) < 30), "filter_or_qual"),
        (~_is_simple_het(gt), "not_fully_called_het"),
        (~F.coalesce(_complete(ad) & (F.size(ad) == 2), F.lit(False)), "missing_ad"),
        (~total.between(20, 120) | (F.least(ad[0], ad[1]) < 3), "depth_or_allele_support"),
        (~F.coalesce(complete_pl & (gap >= 20), F.lit(False)), "weak_or_missing_genotype_likelihood"),
    )


def pgx_reason(gt: Column, dp: Column, gq: Column, rgq: Column, min_depth: int = 10, min_quality: int = 20) -> Column:
    """Why a pharmacogene call is rejected; RGQ stands in for GQ at homozygous reference only."""
    hom_ref = ~has_missing(gt) & (nonref_count(gt) == 0)
    quality = F.coalesce(gq, F.when(hom_ref, rgq))
    return _first_reason(
        (has_missing(gt), "rejected_missing"),
        (dp.isNull() | (dp < min_depth), "rejected_depth"),
        (quality.isNull() | (quality < min_quality), "rejected_quality"),
    )


def scoring_call(gt: Column, filters: Column, alts: Column) -> Column:
    """PASS or unfiltered, biallelic, complete diploid 0/1 genotype."""
    passed = (F.size(filters) == 0) | F.array_contains(filters, "PASS")
    diploid = (F.size(gt) == 2) & ~F.exists(gt, lambda a: a.isNull() | ~a.isin(0, 1))
    return F.coalesce(passed & (F.size(alts) == 1) & diploid, F.lit(False))


def sanitize_qual(text: Column) -> Column:
    """QUAL text with non-finite numbers replaced by '.'; anything unreadable stops the job."""
    number = text.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return (
        F.when(text == ".", text)
        .when(finite, text)
        .when(number.isNotNull(), F.lit("."))
        .otherwise(F.raise_error(F.concat(F.lit("invalid QUAL: "), text)))
    )
