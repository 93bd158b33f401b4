"""Molecular tracks and junctions in long form, REF against ALT."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoweave.operators.intervals import Span, merge_intervals, overlap_join
from genoweave.session import guard

# Feature names of an importance row, in file order.
FEATURES = (
    "MERGED_SPLICING", "MAX_ABS_ATAC", "MAX_ABS_CONTACT_MAPS", "MAX_ABS_DNASE", "MAX_ABS_CHIP_TF",
    "MAX_ABS_CHIP_HISTONE", "MAX_ABS_CAGE", "MAX_ABS_PROCAP", "MAX_ABS_RNA_SEQ", "MAX_ABS_POLYADENYLATION",
    "ALPHAMISSENSE", "CACTUS_241_WAY", "PROTEIN_TERMINATION", "START_LOST", "STOP_LOST",
    "PHASTCONS_470_WAY", "IS_INSERTION", "IS_DELETION",
)


def genomic_junctions(junctions: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """Sequence-relative junctions (no contig) moved to genome coordinates of their interval.

    ``metadata``: keys, m_chrom, m_start, m_end. A relative junction outside the interval fails.
    """
    joined = junctions.join(metadata, keys, "left")
    relative = F.col("chrom").isNull() | (F.col("chrom") == "")
    inside = ~relative | ((F.col("start") >= 0) & (F.col("end") <= F.col("m_end") - F.col("m_start")))
    checked = guard(joined, inside, "junction outside its interval")
    return (
        checked.withColumn("start", F.when(relative, F.col("start") + F.col("m_start")).otherwise(F.col("start")))
        .withColumn("end", F.when(relative, F.col("end") + F.col("m_start")).otherwise(F.col("end")))
        .withColumn("chrom", F.when(relative, F.col("m_chrom")).otherwise(F.col("chrom")))
        .drop("m_chrom", "m_start", "m_end")
    )


def align_junctions(ref: DataFrame, alt: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer alignment; a value returned on one side only keeps a NULL delta."""
    r = ref.select(*keys, F.col("value").alias("ref_value"), F.lit(True).alias("_r"))
    a = alt.select(*keys, F.col("value").alias("alt_value"), F.lit(True).alias("_a"))
    joined = r.join(a, keys, "full_outer")
    no = F.lit(False)
    return joined.select(
        *keys, "ref_value", "alt_value", (F.col("alt_value") - F.col("ref_value")).alias("delta"),
        F.coalesce("_r", no).alias("returned_in_ref"), F.coalesce("_a", no).alias("returned_in_alt"),
    )


def junction_summary(aligned: DataFrame, keys: list[str]) -> DataFrame:
    both = F.col("returned_in_ref") & F.col("returned_in_alt")
    return aligned.groupBy(*keys).agg(
        F.count("*").alias("junction_rows"), F.count_if(both).alias("matched"), F.count_if(~both).alias("unmatched"),
        F.max(F.abs("delta")).alias("max_abs_delta"), F.count_if(F.abs("delta") > 1).alias("abs_delta_above_1"),
    )


def comparable_tracks(ref_meta: DataFrame, alt_meta: DataFrame) -> DataFrame:
    """Tracks present and equal in interval, resolution and length on both sides; else the job fails."""
    fields = ["chrom", "start", "end", "resolution", "positions"]
    def side(df, name):
        return df.select("scenario", "track", F.struct(*fields).alias(f"_{name}"))
    joined = side(ref_meta, "r").join(side(alt_meta, "a"), ["scenario", "track"], "full_outer")
    checked = guard(joined, F.col("_r").eqNullSafe(F.col("_a")), "REF and ALT tracks are not comparable")
    return checked.select("scenario", "track", "_r.*")


def compare_tracks(values: DataFrame, keys: list[str], gene_start: int | None = None, gene_end: int | None = None) -> DataFrame:
    """REF and ALT sums, their ratio and max / mean absolute delta per track inside a gene.

    ``values``: keys, coord, side ('ref' or 'alt'), value. Both sides meet by one partial
    aggregate per (keys, coord) instead of a join.
    """
    kept = values
    if gene_start is not None:
        kept = kept.filter(F.col("coord").between(gene_start, gene_end))
    per = kept.groupBy(*keys, "coord").agg(
        F.sum(F.when(F.col("side") == "ref", F.col("value"))).alias("r"), F.sum(F.when(F.col("side") == "alt", F.col("value"))).alias("a")
    )
    delta = F.col("a") - F.col("r")
    return per.groupBy(*keys).agg(
        F.sum("r").alias("ref_sum"), F.sum("a").alias("alt_sum"), F.max(F.abs(delta)).alias("max_abs_delta"),
        F.avg(F.abs(delta)).alias("mean_abs_delta"), F.count("*").alias("positions"),
    ).withColumn("sum_ratio", F.when(F.col("ref_sum") > 0, F.col("alt_sum") / F.col("ref_sum")))


def exon_means(values: DataFrame, exons: DataFrame, keys: list[str]) -> DataFrame:
    """Mean REF and ALT over exonic positions, their ratio and log ratio with a 0.001 pseudo-count.

    ``values``: keys, contig, coord (0-based), side, value. ``exons``: e_contig, e_start, e_end closed.
    """
    merged = merge_intervals(exons.select("e_contig", "e_start", "e_end"), ["e_contig"], "e_start", "e_end", slack=1)
    points = values.withColumn("_one", F.col("coord") + 1)
    met = overlap_join(points, merged, Span("contig", "_one", "_one", closed=True), Span("e_contig", "e_start", "e_end", closed=True))
    def mean(side):
        return F.avg(F.when(F.col("side") == side, F.col("value")))
    out = met.groupBy(*keys).agg(F.count_distinct("coord").alias("exonic_bases"), mean("ref").alias("ref_mean"), mean("alt").alias("alt_mean"))
    return out.withColumn("alt_ref_ratio", F.try_divide("alt_mean", "ref_mean")).withColumn(
        "ln_ratio", F.log(F.col("alt_mean") + 0.001) - F.log(F.col("ref_mean") + 0.001)
    )


def ratio_range(means: DataFrame, keys: list[str]) -> DataFrame:
    return means.groupBy(*keys).agg(
        F.min("alt_ref_ratio").alias("min_ratio"), F.max("alt_ref_ratio").alias("max_ratio"), F.count("*").alias("tracks")
    )


def score_summary(scores: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Rows, target rows, largest absolute scores and extreme quantiles per modality."""
    hit = F.col("gene") == target
    mag = F.abs("score")
    return scores.groupBy(*keys).agg(
        F.count("*").alias("all_rows"), F.count_if(hit).alias("target_rows"), F.max(mag).alias("max_abs_all"),
        F.max(F.when(hit, mag)).alias("max_abs_target"), F.max_by("gene", F.struct(mag, "gene")).alias("top_gene"),
        F.count_if(F.abs("quantile") > 0.995).alias("high_quantile_rows"),
        F.count_if(hit & (F.abs("quantile") > 0.995)).alias("target_high_quantile_rows"),
    )


def top_scores(scores: DataFrame, keys: list[str], k: int, tie: list[str], salts: int = 32) -> DataFrame:
    """Top k by absolute score per group, ties in the given order.

    A first cut keeps the best k of every (group, salt), so a group with most of the rows is cut
    in parallel before its k x salts survivors meet; Spark also prunes ranks before the shuffle.
    """
    order = [F.abs("score").desc(), *[F.col(t).asc() for t in tie]]
    salted = scores.withColumn("_salt", F.pmod(F.xxhash64(*tie), F.lit(salts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col("rank") <= k)
    final = first.drop("rank", "_salt").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return final.filter(F.col("rank") <= k)


def feature_contributions(rows: DataFrame, keys: list[str], features: tuple[str, ...] = FEATURES, k: int = 5) -> DataFrame:
    """Wide feature columns to (feature, score, rank) with the k largest absolute values per row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score")) for f in features]))
    long = rows.select(*keys, pairs.alias("p")).select(*keys, "p.feature", "p.score")
    # 18 rows per allele, so the rank needs no salt.
    order = Window.partitionBy(*keys).orderBy(F.abs("score").desc(), F.col("feature").asc())
    return long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def track_inventory(values: DataFrame) -> DataFrame:
    """Returned tracks per scenario and mode; a track without values is 'not returned', not absent."""
    seen = values.groupBy("scenario", "mode", "track").agg(F.count("value").alias("values_returned"))
    meaning = F.when(F.col("values_returned") == 0, "no returned values, not absence").otherwise("returned")
    return seen.withColumn("meaning", meaning)


def label_coordinates(rows: DataFrame, limits: dict[str, tuple[str, str]]) -> DataFrame:
    """Attach what coordinates mean per scenario; an unknown scenario fails the job.

    ``limits`` is a short fixed list written by hand: scenario -> (system, validity).
    """
    system, validity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (s, v) in limits.items():
        system = F.when(F.col("scenario") == name, F.lit(s)).otherwise(system)
        validity = F.when(F.col("scenario") == name, F.lit(v)).otherwise(validity)
    labelled = rows.withColumn("coordinate_system", system).withColumn("metric_validity", validity)
    return guard(labelled, F.col("coordinate_system").isNotNull(), "scenario without coordinate limits")


def array_audit(values: DataFrame, keys: list[str]) -> DataFrame:
    """Values per array and how many are not finite."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == F.lit(float("inf")))
    return values.groupBy(*keys).agg(F.count("*").alias("values"), F.count_if(bad).alias("not_finite"))
