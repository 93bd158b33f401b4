"""Depth and allele-fraction windows, masks, noise, segments and calibration.

Frames are keyed by ``sample``. A group (sample), (sample, chrom) or (sample, length) holds the
1 Mb bins of one genome, about 3,000 rows, so windows and exact percentiles inside it are
bounded by the genome, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoweave.functions import genotype as fg
from genoweave.functions import sequence as fs
from genoweave.operators.intervals import Span, asof_join
from genoweave.session import guard

# Screening limits.
MASKS = (
    ("unique_fraction", "low_unique_mappability", lambda c: c < 0.85),
    ("segdup_fraction", "segmental_duplication", lambda c: c > 0.10),
    ("gap_fraction", "assembly_gap", lambda c: c > 0.01),
    ("centromere_fraction", "centromere", lambda c: c > 0),
)
LENGTHS = (3, 4, 5, 10, 20)
FRACTIONS = (0.05, 0.10, 0.20, 0.30, 0.50)


def gc_windows(
    regions: DataFrame, min_length: int = 500000, min_called: float = 0.99, low: float = 0.25, high: float = 0.65
) -> DataFrame:
    """Windows with depth per called base, GC and the reason a window is left out.

    ``regions``: chrom, start, end, depth, seq.
    """
    acgt = fs.acgt_fraction(F.col("seq"))
    gc = fs.gc_fraction(F.col("seq"))
    reason = F.when((F.length("seq") < min_length) | (acgt < min_called), "short_or_gap_rich_window").when(
        ~F.coalesce(gc.between(low, high), F.lit(False)), "extreme_gc_window"
    )
    return (
        regions.withColumn("acgt_fraction", acgt)
        .withColumn("gc", gc)
        .withColumn("reason", reason)
        .withColumn("depth", F.when(acgt > 0, F.col("depth") / acgt))
        .drop("seq")
    )


def mask_bins(bins: DataFrame) -> DataFrame:
    """Add mask_reasons and clean from the four mask fractions."""
    reasons = F.array_compact(F.array(*[F.when(fails(F.col(c)), F.lit(name)) for c, name, fails in MASKS]))
    return bins.withColumn("mask_reasons", reasons).withColumn("clean", F.size("mask_reasons") == 0)


def nearest_gc_depth(bins: DataFrame, k: int = 200, block: int = 512) -> DataFrame:
    """Median depth of the k windows nearest in GC on other chromosomes, ties by input order.

    No window meets every other window: for each chromosome left out, the remaining windows are
    numbered upwards from each GC and downwards below it; a window then reads only the next k
    numbers on either side, from at most two blocks. Needs sample, chrom, ordinal, gc, depth.
    """
    chroms = bins.groupBy("sample").agg(F.collect_set("chrom").alias("_chroms"))
    others = (
        bins.join(chroms, "sample")
        .withColumn("_out", F.explode(F.filter("_chroms", lambda c: c != F.col("chrom"))))
        .select("sample", "_out", "gc", "ordinal", "depth", F.lit(1).alias("_entry"))
    )
    asks = bins.select("sample", F.col("chrom").alias("_out"), "gc", "ordinal", F.lit(None).cast("double").alias("depth"), F.lit(0).alias("_entry"))
    both = others.unionByName(asks)
    group = Window.partitionBy("sample", "_out")
    def side(gc_order: Column, entry_first: bool) -> DataFrame:
        mark = F.col("_entry").desc() if entry_first else F.col("_entry").asc()
        along = group.orderBy(gc_order, mark, F.col("ordinal").asc()).rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn("_n", F.sum("_entry").over(along))
    pairs = None
    # Upwards an equal GC counts as above (asks first); downwards it is already passed (entries first).
    for frame in (side(F.col("gc").asc(), False), side(F.col("gc").desc(), True)):
        entry = frame.filter("_entry = 1").select("sample", "_out", "_n", F.col("gc").alias("_gc"), F.col("ordinal").alias("_o"), F.col("depth").alias("_d"))
        entry = entry.withColumn("_block", F.floor(F.col("_n") / block))
        ask = frame.filter("_entry = 0").select("sample", "_out", "gc", "ordinal", F.col("_n").alias("_at"))
        ask = ask.withColumn(
            "_block", F.explode(F.sequence(F.floor((F.col("_at") + 1) / block), F.floor((F.col("_at") + k) / block)))
        )
        met = ask.join(entry, ["sample", "_out", "_block"]).filter(F.col("_n").between(F.col("_at") + 1, F.col("_at") + k))
        pairs = met if pairs is None else pairs.unionByName(met)
    near = Window.partitionBy("sample", "_out", "ordinal").orderBy(F.abs(F.col("_gc") - F.col("gc")), "_o")
    picked = pairs.withColumn("_rank", F.row_number().over(near)).filter(F.col("_rank") <= k)
    expected = picked.groupBy("sample", "ordinal").agg(F.percentile("_d", F.lit(0.5)).alias("expected_depth"))
    return bins.join(expected, ["sample", "ordinal"], "left")


def relative_depth(bins: DataFrame, out: str = "rd") -> DataFrame:
    """Depth over its GC expectation, then over the sample's median ratio."""
    ratio = bins.withColumn("_ratio", F.try_divide("depth", "expected_depth"))
    centre = ratio.groupBy("sample").agg(F.percentile("_ratio", F.lit(0.5)).alias("_centre"))
    return ratio.join(centre, "sample").withColumn(out, F.col("_ratio") / F.col("_centre")).drop("_ratio", "_centre")


def baf_calls(calls: DataFrame) -> DataFrame:
    """Add the rejection reason and, for accepted hets, the B-allele fraction."""
    reason = fg.baf_reason(*[F.col(c) for c in ("gt", "filters", "qual", "ad", "pl", "ref", "alts")])
    return calls.withColumn("reason", reason).withColumn(
        "baf", F.when(reason.isNull(), F.col("ad")[1] / (F.col("ad")[0] + F.col("ad")[1]))
    )


def window_baf(hets: DataFrame, windows: DataFrame, window_span: Span) -> DataFrame:
    """Het count and median |BAF - 0.5| per window; windows without hets keep NULL.

    Windows of several samples that lie at one place all get what the calls say of that place.
    Depth is 20 to 120, so a window has few thousand distinct fractions to keep.
    """
    place = [window_span.contig, window_span.start, window_span.end]
    met = asof_join(hets.select("contig", "pos", "baf"), windows.select(*place).distinct(), "contig", "pos", window_span)
    per = met.groupBy(*place).agg(
        F.count("*").alias("het_count"), F.percentile(F.abs(F.col("baf") - 0.5), F.lit(0.5)).alias("median_abs_baf")
    )
    return windows.join(per, place, "left").withColumn("het_count", F.coalesce("het_count", F.lit(0)))


def chromosome_summary(windows: DataFrame, keys: list[str], ratio: str) -> DataFrame:
    """Median and index-based 10th/90th percentile of window ratios."""
    ordered = F.array_sort(F.collect_list(ratio))
    def pick(share):
        return F.element_at("_all", (F.floor((F.size("_all") - 1) * share) + 1).cast("int"))
    return (
        windows.groupBy(*keys)
        .agg(F.count("*").alias("windows"), F.percentile(ratio, F.lit(0.5)).alias("median_ratio"), ordered.alias("_all"))
        .select(*keys, "windows", "median_ratio", pick(0.1).alias("window_p10"), pick(0.9).alias("window_p90"))
    )


def baf_histogram(hets: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    slot = F.least(F.lit(bins - 1), F.floor(F.col("baf") * bins)).cast("int")
    return hets.groupBy(*keys, slot.alias("slot")).agg(F.count("*").alias("hets"))


def noise(bins: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Median and 1.4826 x MAD of a bin measure per key."""
    centre = bins.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias(f"{name}_center"))
    spread = (
        bins.join(centre, keys)
        .groupBy(*keys)
        .agg((F.lit(1.4826) * F.percentile(F.abs(F.col(value) - F.col(f"{name}_center")), F.lit(0.5))).alias(f"{name}_noise"))
    )
    return centre.join(spread, keys)


def whole_chromosome(bins: DataFrame, threshold: float = 0.03) -> DataFrame:
    """Per chromosome medians of clean bins and whether the RD shift exceeds the threshold."""
    centre = bins.groupBy("sample").agg(F.percentile("rd", F.lit(0.5)).alias("_centre"))
    per = bins.groupBy("sample", "chrom").agg(
        F.count("*").alias("clean_bins"),
        F.percentile("rd", F.lit(0.5)).alias("median_rd"),
        F.percentile("bafdev", F.lit(0.5)).alias("median_bafdev"),
    )
    return (
        per.join(centre, "sample")
        .withColumn("rd_shift", F.col("median_rd") - F.col("_centre"))
        .withColumn("candidate", F.abs("rd_shift") > threshold)
        .drop("_centre")
    )


def coverage_pattern(regions: DataFrame, par: DataFrame, centre: DataFrame) -> DataFrame:
    """Median X and Y depth outside the pseudo-autosomal parts over the autosomal median.

    ``regions``: sample, chrom (chrX/chrY), start, end, depth, masked_bp. ``par``: p_chrom,
    p_start, p_end. ``centre``: sample, autosomal_depth.
    """
    span = F.col("end") - F.col("start")
    kept = regions.filter((span >= 500000) & (F.col("masked_bp") / span <= 0.05)).withColumn(
        "mid", F.floor((F.col("start") + F.col("end")) / 2)
    )
    inside = kept.join(
        par, (F.col("chrom") == F.col("p_chrom")) & (F.col("mid") >= F.col("p_start")) & (F.col("mid") < F.col("p_end")), "left_semi"
    ).select("sample", "chrom", "start").distinct().withColumn("_par", F.lit(True))
    parts = kept.join(inside, ["sample", "chrom", "start"], "left").withColumn("part", F.when(F.col("_par"), "PAR").otherwise("nonPAR"))
    ratio = parts.groupBy("sample", "chrom", "part").agg(F.percentile("depth", F.lit(0.5)).alias("_m"))
    ratio = ratio.join(centre, "sample").withColumn("ratio", F.col("_m") / F.col("autosomal_depth"))
    def of(c):
        return F.max(F.when((F.col("chrom") == c) & (F.col("part") == "nonPAR"), F.col("ratio")))
    wide = ratio.groupBy("sample").agg(of("chrX").alias("x_ratio"), of("chrY").alias("y_ratio"))
    label = (
        F.when(F.col("x_ratio").between(0.35, 0.65) & (F.col("y_ratio") >= 0.20), "XY-like coverage")
        .when(F.col("x_ratio").between(0.80, 1.20) & (F.col("y_ratio") < 0.10), "XX-like coverage")
        .otherwise("unresolved coverage ploidy pattern")
    )
    return wide.withColumn("pattern", label)


def placement_groups(bins: DataFrame, lengths: DataFrame, gap: int = 100000) -> DataFrame:
    """Mean RD and BAF of every run of n neighbouring clean bins, for each n in ``lengths``.

    A run breaks where the gap to the previous bin exceeds ``gap``. Rows are numbered once inside
    their run; prefix sums give every sliding mean, so no group of bins is collected.
    """
    along = Window.partitionBy("sample", "chrom").orderBy("start")
    runs = bins.withColumn("_jump", F.coalesce(F.col("start") - F.lag("end").over(along) > gap, F.lit(True)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_jump").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("sample", "chrom", "_run").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    summed = runs.select(
        "sample", "chrom", "_run", "start",
        F.count("*").over(inside).alias("_i"),
        F.sum("rd").over(inside).alias("_rd"),
        F.sum(F.coalesce("bafdev", F.lit(0.0))).over(inside).alias("_baf"),
        F.count("bafdev").over(inside).alias("_known"),
    )
    ends = summed.join(lengths, "sample").filter(F.col("_i") >= F.col("n"))
    begin = summed.select("sample", "chrom", "_run", (F.col("_i") + 1).alias("_first"), F.col("_rd").alias("_rd0"), F.col("_baf").alias("_baf0"), F.col("_known").alias("_known0"))
    met = ends.withColumn("_first", F.col("_i") - F.col("n") + 1).join(begin, ["sample", "chrom", "_run", "_first"], "left")
    zero = F.lit(0)
    mean_rd = (F.col("_rd") - F.coalesce("_rd0", zero)) / F.col("n")
    known = F.col("_known") - F.coalesce("_known0", zero)
    mean_baf = F.when(known == F.col("n"), (F.col("_baf") - F.coalesce("_baf0", zero)) / F.col("n"))
    return met.select("sample", "chrom", "n", "start", mean_rd.alias("mean_rd"), mean_baf.alias("mean_baf"))


def empirical_thresholds(groups: DataFrame, centres: DataFrame, p: float = 0.995) -> DataFrame:
    """Per length: quantile of the absolute mean shift, with a floor for RD and BAF."""
    joined = groups.join(centres, "sample")
    rd = F.percentile(F.abs(F.col("mean_rd") - F.col("rd_center")), F.lit(p))
    baf = F.percentile(F.abs(F.col("mean_baf") - F.col("baf_center")), F.lit(p))
    return joined.groupBy("sample", "n").agg(
        F.count("*").alias("placements"),
        F.greatest(F.coalesce(rd, F.lit(0.0)), F.lit(0.01)).alias("rd_threshold"),
        F.when(F.count("mean_baf") > 0, F.greatest(baf, F.lit(0.002))).alias("baf_threshold"),
    )


def power_grid(groups: DataFrame, centres: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Share of placements beyond the threshold after an injected shift, per event and fraction."""
    events = []
    for f in FRACTIONS:
        events.append(("mosaic_loss", f, -f / 2))
        events.append(("mosaic_gain", f, f / 2))
        events.append(("copy_neutral_loh", f, f / 2))
    grid = F.explode(F.array(*[F.struct(F.lit(e).alias("event"), F.lit(f).alias("fraction"), F.lit(s).alias("shift")) for e, f, s in events]))
    joined = groups.join(centres, "sample").join(thresholds, ["sample", "n"]).withColumn("_g", grid)
    event, shift = F.col("_g.event"), F.col("_g.shift")
    rd, baf = F.col("mean_rd") - F.col("rd_center"), F.col("mean_baf") - F.col("baf_center")
    detected = (
        F.when(event == "mosaic_loss", rd + shift < -F.col("rd_threshold"))
        .when(event == "mosaic_gain", rd + shift > F.col("rd_threshold"))
        .otherwise(baf + shift > F.col("baf_threshold"))
    )
    return joined.groupBy("sample", "n", event.alias("event"), F.col("_g.fraction").alias("fraction")).agg(
        F.avg(detected.cast("double")).alias("power")
    )


def _median_of(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def local_shift(bins: DataFrame, centres: DataFrame, reach: int = 2200000) -> DataFrame:
    """Centred five-bin medians of clean bins that also lie within ``reach``, minus the centre."""
    around = Window.partitionBy("sample", "chrom").orderBy("start").rowsBetween(-2, 2)
    near = F.collect_list(F.struct("start", "rd", "bafdev")).over(around)
    staged = bins.join(centres, "sample").withColumn("_near", near)
    local = F.filter("_near", lambda b: F.abs(b["start"] - F.col("start")) <= reach)
    rd = _median_of(F.transform(local, lambda b: b["rd"]))
    baf = _median_of(F.filter(F.transform(local, lambda b: b["bafdev"]), lambda v: v.isNotNull()))
    return staged.withColumn("rd_shift", rd - F.col("rd_center")).withColumn(
        "baf_shift", F.coalesce(baf - F.col("baf_center"), F.lit(0.0))
    ).drop("_near")


def flag_bins(shifts: DataFrame) -> DataFrame:
    """loss_like, gain_like or copy_neutral_loh_like (only where RD is neutral), else NULL."""
    rd_cut = F.greatest(F.lit(0.03), 3 * F.col("rd_noise") / F.sqrt(F.lit(5.0)))
    baf_cut = F.greatest(F.lit(0.005), 3 * F.col("baf_noise") / F.sqrt(F.lit(5.0)))
    flag = (
        F.when(F.col("rd_shift") < -rd_cut, "loss_like")
        .when(F.col("rd_shift") > rd_cut, "gain_like")
        .when(F.col("baf_shift") > baf_cut, "copy_neutral_loh_like")
    )
    return shifts.withColumn("flag", flag)


def segments(flagged: DataFrame, gap: int = 100000, minimum: int = 3) -> DataFrame:
    """Runs of equally flagged neighbouring bins; unflagged bins break runs too."""
    along = Window.partitionBy("sample", "chrom").orderBy("start")
    same = F.col("flag").eqNullSafe(F.lag("flag").over(along)) & (F.col("start") - F.lag("end").over(along) <= gap)
    numbered = flagged.withColumn("_break", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn(
        "_seg", F.sum("_break").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        numbered.filter("flag is not null")
        .groupBy("sample", "chrom", "_seg", F.col("flag").alias("label"))
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"),
            F.percentile("rd", F.lit(0.5)).alias("median_rd"), F.percentile("bafdev", F.lit(0.5)).alias("median_bafdev"),
            F.sum("hets").alias("het_count"), F.avg("rd").alias("mean_rd"), F.avg("bafdev").alias("mean_bafdev"),
        )
        .filter(F.col("n") >= minimum)
        .drop("_seg")
    )


def review_segments(found: DataFrame, bins: DataFrame, centres: DataFrame) -> DataFrame:
    """Compare every segment with placements of its own length."""
    lengths = found.select("sample", "n").distinct()
    thresholds = empirical_thresholds(placement_groups(bins, lengths), centres)
    joined = found.join(thresholds, ["sample", "n"], "left").join(centres, "sample")
    rd_ok = F.abs(F.col("mean_rd") - F.col("rd_center")) > F.col("rd_threshold")
    baf_ok = F.coalesce(F.col("mean_bafdev") - F.col("baf_center") > F.col("baf_threshold"), F.lit(False))
    return (
        joined.withColumn("passes_rd", F.coalesce(rd_ok, F.lit(False)))
        .withColumn("passes_baf", baf_ok)
        .withColumn("joint_support", F.col("passes_rd") & F.col("passes_baf"))
        .select(*found.columns, "rd_threshold", "baf_threshold", "passes_rd", "passes_baf", "joint_support")
    )


# Copies of the two haplotypes per cell state.
COPIES = {"AB": (1, 1), "AAB": (2, 1), "ABB": (1, 2), "A": (1, 0), "B": (0, 1)}


def copies_of(state: Column, haplotype: int) -> Column:
    """Copies of haplotype A (0) or B (1) in a cell state; unknown states have none."""
    out = F.lit(0)
    for name, pair in COPIES.items():
        out = F.when(state == name, F.lit(pair[haplotype])).otherwise(out)
    return out


def mixture_expectations(mixtures: DataFrame) -> DataFrame:
    """Expected copies, relative depth and B fraction of cell mixtures.

    ``mixtures``: scenario, state, fraction; each scenario's fractions must sum to one.
    """
    summed = mixtures.groupBy("scenario").agg(
        F.sum("fraction").alias("_all"),
        F.sum(F.col("fraction") * copies_of(F.col("state"), 0)).alias("a_copies"),
        F.sum(F.col("fraction") * copies_of(F.col("state"), 1)).alias("b_copies"),
    )
    total = F.col("a_copies") + F.col("b_copies")
    checked = guard(summed, F.abs(F.col("_all") - 1.0) <= 1e-12, "cell fractions must sum to one")
    return checked.select("scenario", "a_copies", "b_copies", (total / 2).alias("relative_rd"), F.try_divide(F.col("b_copies"), total).alias("baf_b"))


def cell_enumeration(counts: DataFrame) -> DataFrame:
    """The same from integer cell counts: scenario, state, cells."""
    summed = counts.groupBy("scenario").agg(
        F.sum("cells").alias("_n"),
        F.sum(F.col("cells") * copies_of(F.col("state"), 0)).alias("_a"),
        F.sum(F.col("cells") * copies_of(F.col("state"), 1)).alias("_b"),
    )
    both = F.col("_a") + F.col("_b")
    return summed.select(
        "scenario", F.try_divide("_a", "_n").alias("a_copies"), F.try_divide("_b", "_n").alias("b_copies"),
        F.try_divide(both, 2 * F.col("_n")).alias("relative_rd"), F.try_divide(F.col("_b"), both).alias("baf_b"),
    )
