"""Clinical terms, categories, labels and small text normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The catalogue's classification words.
PATHOGENIC_TERMS = ("pathogenic", "likely_pathogenic", "pathogenic/likely_pathogenic")
UNCERTAIN_TERMS = (
    "uncertain_significance",
    "uncertain_significance/likely_benign",
    "uncertain_significance/likely_pathogenic",
)


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def terms(values: Column) -> Column:
    """Lower-cased, underscored, distinct terms; NULL, '.' and '' are no terms."""
    kept = F.filter(values, lambda v: v.isNotNull() & ~v.isin(".", ""))
    return F.coalesce(
        F.array_distinct(F.transform(kept, lambda v: F.replace(F.lower(v), F.lit(" "), F.lit("_")))),
        F.array().cast("array<string>"),
    )


def is_pathogenic(term_set: Column) -> Column:
    return F.arrays_overlap(term_set, _words(PATHOGENIC_TERMS))


def is_uncertain(term_set: Column) -> Column:
    return F.arrays_overlap(term_set, _words(UNCERTAIN_TERMS))


def is_conflicting(term_set: Column) -> Column:
    return F.exists(term_set, lambda t: F.instr(t, "conflict") > 0)


def categories(term_set: Column) -> Column:
    """PLP, VUS and conflicting may hold together; other stands alone."""
    named = F.array_compact(
        F.array(
            F.when(is_pathogenic(term_set), "PLP"),
            F.when(is_uncertain(term_set), "VUS"),
            F.when(is_conflicting(term_set), "conflicting"),
        )
    )
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("other")))


def gene_symbols(geneinfo: Column) -> Column:
    """'A:1|B:2' to sorted distinct symbols."""
    parts = F.filter(F.split(F.coalesce(geneinfo, F.lit("")), r"\|"), lambda g: g != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda g: F.substring_index(g, ":", 1))))


def percent_to_fraction(text: Column) -> Column:
    """Exact decimal fraction of a percentage; missing stays missing."""
    return F.when(text.isNotNull() & (text != ""), text.cast("decimal(30,15)") / F.lit(100).cast("decimal(3,0)"))


def phase_rule(phase: Column, confirmed: Column) -> Column:
    return (
        F.when(phase == "cis_supported", "nominated_pair_not_biallelic; independent_single_allele_effects_retained")
        .when(
            (phase == "trans_supported") & F.coalesce(confirmed, F.lit(False)),
            "biallelic_genotype_supported; clinical_fit_requires_separate_assessment",
        )
        .otherwise("biallelic_causality_not_established")
    )


def sv_review_class(large_span: Column, technical: Column, cds_bp: Column) -> Column:
    return (
        F.when(large_span, "broad_unvalidated_span")
        .when(technical & (cds_bp > 0), "coding_or_breakpoint_candidate")
        .when(technical, "exonic_nonCDS_or_intragenic_candidate")
        .otherwise("weak_technical_support")
    )


def mosaic_review_class(kind: Column, n_hets: Column) -> Column:
    return (
        F.when(kind.startswith("CNP"), "known_CNP_context_not_mCA_evidence")
        .when((kind == "Loss") & (n_hets == 0), "loss_without_heterozygous_support")
        .otherwise("gain_germline_like_or_mapping_context_unresolved")
    )
