"""Polygenic raw sums, score-file eligibility and pharmacogene summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoweave.functions import coords

# Weight types and reasons.
RAW_RATIO_TYPES = ("or", "hr", "odds ratio", "hazard ratio")
NON_ADDITIVE = ("haplo", "diplo", "non-add", "interaction")
COMPLEX_REASON = "unsupported_haplotype_diplotype_or_interaction_model"


def model_reason(metadata: DataFrame) -> DataFrame:
    """Why a score model is not run (NULL = eligible), from its header fields."""
    kind = F.lower(F.trim(F.coalesce("weight_type", F.lit(""))))
    odd = F.lit(False)
    for marker in NON_ADDITIVE:
        odd = odd | (F.instr(kind, marker) > 0)
    reason = F.when(~F.col("hmpos_build").eqNullSafe(F.lit("GRCh38")), "harmonized_build_missing_or_mismatched").when(
        kind.isin(*RAW_RATIO_TYPES) | odd, "unsupported_nonadditive_or_or_only_weight_type"
    )
    return metadata.withColumn("model_reason", reason)


def row_class(rows: DataFrame) -> DataFrame:
    """malformed, nonfinite, excluded (not autosomal) or valid, with the numeric weight."""
    def blank(c):
        return F.coalesce(F.col(c), F.lit("")) == ""
    number = F.col("effect_weight").try_cast("double")
    missing = blank("hm_chr") | blank("hm_pos") | blank("effect_allele") | blank("effect_weight")
    label = (
        F.when(missing | number.isNull(), "malformed")
        .when(F.isnan(number) | (F.abs(number) == F.lit(float("inf"))), "nonfinite")
        .when(~coords.is_autosome(F.col("hm_chr")), "excluded")
        .otherwise("valid")
    )
    return (
        rows.withColumn("row_class", label)
        .withColumn("chrom", coords.chrom_key(F.col("hm_chr")))
        .withColumn("effect", F.upper("effect_allele"))
        .withColumn("weight", number)
    )


def is_complex_model() -> Column:
    """A row that marks its model as haplotype, diplotype or interaction."""
    yes = F.lit(False)
    for c in ("is_haplotype", "is_diplotype", "is_interaction"):
        yes = yes | F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).isin("true", "1", "yes")
    return yes


def unique_positions(variants: DataFrame) -> DataFrame:
    """Variants whose (chrom, pos) occurs once; positions seen twice are dropped entirely."""
    seen = variants.groupBy("chrom", "pos").agg(F.count("*").alias("_n"), F.first("variant_id").alias("variant_id"),
                                                F.first("alleles").alias("alleles"), F.first("dosage_of").alias("dosage_of"))
    return seen.filter("_n = 1").drop("_n")


def resolve_duplicates(rows: DataFrame, model: str = "model", keys: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """Identical (effect, weight) copies collapse; a position with different ones goes entirely.

    One aggregate per (model, position): min and max of the pair tell whether they agree, so no
    list of copies is built.
    """
    pair = F.struct("effect", "weight_text")
    per = rows.groupBy(model, *keys).agg(
        F.min(pair).alias("_lo"), F.max(pair).alias("_hi"), F.count("*").alias("copies"), F.min("weight").alias("weight")
    )
    return per.withColumn("ambiguous", F.col("_lo") != F.col("_hi")).select(
        model, *keys, F.col("_lo.effect").alias("effect"), "weight", "copies", "ambiguous"
    )


def match_scores(rows: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Score rows joined to genotyped positions, with ambiguity decided before the allele check.

    ``rows``: model, chrom, pos, effect, weight, weight_text. ``genotypes``: chrom, pos, alleles
    (array), counts (map allele -> copies).
    """
    present = rows.join(genotypes.select("chrom", "pos"), ["chrom", "pos"], "left_semi")
    decided = resolve_duplicates(present)
    joined = decided.join(genotypes, ["chrom", "pos"])
    return joined.withColumn("allele_known", F.array_contains("alleles", F.col("effect"))).withColumn(
        "dosage", F.when(F.col("allele_known"), F.coalesce(F.try_element_at("counts", F.col("effect")), F.lit(0)))
    )


def raw_sums(matched: DataFrame) -> DataFrame:
    """Sum of dosage x weight per model over retained rows; NULL when nothing matched, never imputed."""
    used = F.col("allele_known") & ~F.col("ambiguous")
    return matched.groupBy("model").agg(
        F.sum(F.when(used, F.col("dosage") * F.col("weight"))).alias("raw_sum"),
        F.count_if(used).alias("matched"),
        F.count_if(F.col("ambiguous")).alias("ambiguous_positions"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(~F.col("allele_known") & ~F.col("ambiguous")).alias("allele_mismatch"),
    )


def row_counters(classed: DataFrame, model: str = "model") -> DataFrame:
    return classed.groupBy(model).agg(
        F.count("*").alias("source_rows"),
        *[F.count_if(F.col("row_class") == c).alias(c) for c in ("malformed", "nonfinite", "excluded", "valid")],
    )


def gene_report(calls: DataFrame) -> DataFrame:
    """Rows, distinct diplotypes and distinct phenotypes per gene."""
    def named(c):
        return F.count_distinct(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)))
    return calls.groupBy("gene").agg(F.count("*").alias("rows"), named("diplotype").alias("diplotypes"), named("phenotype").alias("phenotypes"))


def missing_positions(lines: DataFrame, text: str = "value") -> DataFrame:
    gene = F.regexp_extract(text, r"PX=([^;\t]*)", 1)
    return lines.filter(F.instr(text, "PX=") > 0).groupBy(gene.alias("gene")).agg(F.count("*").alias("missing"))
