"""Depth and allele-fraction windows, noise, segments, calibration, mosaic gates, mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from genoweave.functions import clinical
from genoweave.functions import sequence as fs
from genoweave.operators import copynumber as cn
from genoweave.operators import mosaic
from genoweave.operators.intervals import Span
from genoweave.registry import shared
from genoweave.registry.core import query


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("F22_gc_windows", """select reason, count(*) n, round(sum(gc),4) gc_sum, round(sum(depth),4) depth_sum from (select case when length(t)<500 or a/length(t)<0.2 then 'short_or_gap_rich_window' when g/a not between 0.3 and 0.4 then 'extreme_gc_window' else 'kept' end reason, g/nullif(a,0) gc, n_chars/(a/length(t)) depth
 from (select *, length(regexp_replace(upper(t),'[^ACGT]','','g'))*1.0e0 a, length(regexp_replace(upper(t),'[^GC]','','g')) g from (select n_chars, regexp_replace(text,'[^A-Za-z]','','g') t from documents)) where a>0) group by reason""")
def f22(v):
    # Documents stand in for windows: shorter and less called than 1 Mb of genome, hence the limits.
    t = v.table("documents").select(F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"), F.col("n_chars").cast("double").alias("depth"))
    w = cn.gc_windows(t, min_length=500, min_called=0.2, low=0.3, high=0.4).filter("acgt_fraction > 0")
    return w.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("n"), F.round(F.sum("gc"), 4).alias("gc_sum"), F.round(F.sum("depth"), 4).alias("depth_sum"))


@query("G22_gc_fraction", "select doc_id, round(length(regexp_replace(seq,'[^GC]','','g'))*1.0e0/length(seq),6) gc from v_reads where length(seq)>0")
def g22(v):
    return v("v_reads").filter("length(seq) > 0").select("doc_id", F.round(fs.gc_fraction(F.col("seq")), 6).alias("gc"))


@query("J13_nearest_gc", """select sample, ordinal, round(quantile_cont(d,0.5),6) expected from (select a.sample, a.ordinal, b.depth d, row_number() over (partition by a.sample, a.ordinal order by abs(b.gc-a.gc), b.ordinal) r
 from v_bins a join v_bins b on a.sample=b.sample and a.chrom<>b.chrom) where r<=200 group by 1,2""")
def j13(v):
    return cn.nearest_gc_depth(shared.bins(v, clean=False)).select("sample", "ordinal", F.round("expected_depth", 6).alias("expected"))


ACCEPTED = """(select contig, pos, ad1*1.0e0/(ad0+ad1) baf from v_calls where flt<>'LowQual' and qual>=30 and gt in ('0/1','0|1') and src_row%8<>3 and ad0+ad1 between 20 and 120 and least(ad0,ad1)>=3 and least(pl0,pl2)-pl1>=20)"""


def hets(v):
    return cn.baf_calls(shared.calls(v)).filter("reason is null")


@query("A5_window_baf", f"""select sample, chrom, b_start, count(baf) het_count, round(quantile_cont(abs(baf-0.5),0.5),6) median_abs_baf from v_bins left join {ACCEPTED} on contig=chrom and pos-1>=b_start and pos-1<b_end group by 1,2,3""")
def a5(v):
    w = shared.bins(v, clean=False).select("sample", "chrom", "start", "end")
    out = cn.window_baf(hets(v), w, Span("chrom", "start", "end"))
    return out.select("sample", "chrom", F.col("start").alias("b_start"), "het_count", F.round("median_abs_baf", 6).alias("median_abs_baf"))


@query("A6_chromosome_summary", """select sample, chrom, count(*) windows, round(quantile_cont(rd,0.5),6) median_ratio, round(list_sort(list(rd))[cast(floor(0.1*(count(*)-1)) as int)+1],6) window_p10, round(list_sort(list(rd))[cast(floor(0.9*(count(*)-1)) as int)+1],6) window_p90 from v_clean group by 1,2""")
def a6(v):
    return cn.chromosome_summary(shared.bins(v), ["sample", "chrom"], "rd").select("sample", "chrom", "windows", *r6("median_ratio", "window_p10", "window_p90"))


@query("A6_baf_histogram", f"select contig, cast(least(19,floor(baf*20)) as int) slot, count(*) hets from {ACCEPTED} group by 1,2")
def a6b(v):
    return cn.baf_histogram(hets(v), ["contig"])


def centres(v):
    b = shared.bins(v)
    return cn.noise(b, ["sample"], "rd", "rd").join(cn.noise(b, ["sample"], "bafdev", "baf"), "sample")


@query("A7_median_mad", "select sample, round(rd_center,6) rd_center, round(rd_noise,6) rd_noise, round(baf_center,6) baf_center, round(baf_noise,6) baf_noise from v_centres")
def a7(v):
    return centres(v).select("sample", *r6("rd_center", "rd_noise", "baf_center", "baf_noise"))


@query("A7_exact_quantiles", "select o_orderpriority pr, round(quantile_cont(o_totalprice,0.005),6) p005, round(quantile_cont(o_totalprice,0.5),6) p50, round(quantile_cont(o_totalprice,0.995),6) p995 from orders group by 1")
def a7b(v):
    from genoweave.operators.quantiles import order_statistics

    o = v.table("orders").withColumnRenamed("o_orderpriority", "pr")
    return order_statistics(o, ["pr"], "o_totalprice", {"p005": 0.005, "p50": 0.5, "p995": 0.995}).select("pr", *r6("p005", "p50", "p995"))


@query("T7_order_statistics", """select contig, s[1] vmin, s[cast(floor(0.5*(n-1)) as int)+1] vmedian, s[cast(floor(0.99*(n-1)) as int)+1] vp99, s[n] vmax from (select rname contig, list_sort(list(cast(abs(tlen) as double))) s, count(*) n from v_sam group by 1)""")
def t7(v):
    from genoweave.operators.quantiles import order_statistics

    t = v("v_sam").select(F.col("rname").alias("contig"), F.abs("tlen").alias("t"))
    return order_statistics(t, ["contig"], "t", {"vmin": 0.0, "vmedian": 0.5, "vp99": 0.99, "vmax": 1.0}, linear=False)


@query("A8_whole_chromosome", """select sample, chrom, count(*) clean_bins, round(quantile_cont(rd,0.5),6) median_rd, round(quantile_cont(bafdev,0.5),6) median_bafdev, abs(quantile_cont(rd,0.5)-rd_center)>0.03 candidate from v_clean join v_centres using (sample) group by sample, chrom, rd_center""")
def a8(v):
    return cn.whole_chromosome(shared.bins(v)).select("sample", "chrom", "clean_bins", *r6("median_rd", "median_bafdev"), "candidate")


SEX = "(select l_returnflag sample, case when l_suppkey%2=0 then 'chrX' else 'chrY' end chrom, (l_orderkey%160)*1000000 s, count(*)*case when l_suppkey%2=0 then 0.5e0 else 0.3e0 end depth, (count(*)%4)*20000 masked from lineitem group by l_returnflag, l_suppkey%2, l_orderkey%160)"


@query("A9_coverage_pattern", f"""select sample, round(x,6) x_ratio, round(y,6) y_ratio, case when x between 0.35 and 0.65 and y>=0.2 then 'XY-like coverage' when x between 0.8 and 1.2 and y<0.1 then 'XX-like coverage' else 'unresolved coverage ploidy pattern' end pattern
 from (select sample, quantile_cont(depth,0.5) filter (where chrom='chrX')/c x, quantile_cont(depth,0.5) filter (where chrom='chrY')/c y from {SEX} join (select l_returnflag sample, count(*)/320.0e0 c from lineitem group by 1) using (sample)
 where masked/1000000.0<=0.05 and not (chrom='chrX' and (s+500000 between 10000 and 2781478 or s+500000 between 155701383 and 156030894)) and not (chrom='chrY' and (s+500000 between 10000 and 2781478 or s+500000 between 56887903 and 57217414)) group by sample, c)""")
def a9(v):
    li = v.table("lineitem")
    x = F.col("l_suppkey") % 2 == 0
    reg = li.groupBy(F.col("l_returnflag").alias("sample"), F.when(x, "chrX").otherwise("chrY").alias("chrom"), ((F.col("l_orderkey") % 160) * 1000000).alias("start")).agg(F.count("*").alias("n"))
    reg = reg.select("sample", "chrom", "start", (F.col("start") + 1000000).alias("end"), (F.col("n") * F.when(F.col("chrom") == "chrX", 0.5).otherwise(0.3)).alias("depth"), ((F.col("n") % 4) * 20000).alias("masked_bp"))
    centre = li.groupBy(F.col("l_returnflag").alias("sample")).agg((F.count("*") / 320.0).alias("autosomal_depth"))
    par = v.spark.createDataFrame([("chrX", 10000, 2781479), ("chrX", 155701383, 156030895), ("chrY", 10000, 2781479), ("chrY", 56887903, 57217415)], "p_chrom string, p_start long, p_end long")
    return cn.coverage_pattern(reg, par, centre).select("sample", *r6("x_ratio", "y_ratio"), "pattern")


def lengths(v):
    return shared.bins(v).select("sample").distinct().withColumn("n", F.explode(F.array(*[F.lit(n) for n in cn.LENGTHS])))


def placements(v):
    return cn.placement_groups(shared.bins(v), lengths(v))


@query("W1_placement_groups", "select sample, chrom, n, b_start, round(mean_rd,6) mean_rd, round(mean_baf,6) mean_baf from v_placements")
def w1(v):
    return placements(v).select("sample", "chrom", "n", F.col("start").alias("b_start"), *r6("mean_rd", "mean_baf"))


@query("W2_empirical_threshold", "select sample, n, placements, round(rd_threshold,6) rd_threshold, round(baf_threshold,6) baf_threshold from v_thresholds")
def w2(v):
    return cn.empirical_thresholds(placements(v), centres(v)).select("sample", "n", "placements", *r6("rd_threshold", "baf_threshold"))


@query("W3_local_shift", "select sample, chrom, b_start, round(rd_shift,6) rd_shift, round(baf_shift,6) baf_shift from v_shifts")
def w3(v):
    return cn.local_shift(shared.bins(v), centres(v)).select("sample", "chrom", F.col("start").alias("b_start"), *r6("rd_shift", "baf_shift"))


def flags(v):
    return cn.flag_bins(cn.local_shift(shared.bins(v), centres(v)))


@query("W4_bin_flags", "select sample, flag, count(*) n from v_flags group by 1,2")
def w4(v):
    return flags(v).groupBy("sample", "flag").agg(F.count("*").alias("n"))


@query("W5_segments", "select sample, chrom, label, s, e, n, round(median_rd,6) median_rd, round(median_bafdev,6) median_bafdev, cast(het_count as bigint) het_count from v_segments")
def w5(v):
    return cn.segments(flags(v)).select("sample", "chrom", "label", F.col("start").alias("s"), F.col("end").alias("e"), "n", *r6("median_rd", "median_bafdev"), "het_count")


@query("W6_segment_review", """with numbered as (select *, row_number() over (partition by sample, chrom, run order by b_start) i from v_runs),
 groups as (select a.sample, n, avg(b.rd) m_rd, case when count(b.bafdev)=n then avg(b.bafdev) end m_baf from numbered a join (select distinct sample, n from v_segments) using (sample)
   join numbered b on a.sample=b.sample and a.chrom=b.chrom and a.run=b.run and b.i between a.i-n+1 and a.i where a.i>=n group by a.sample, a.chrom, a.run, a.i, n),
 th as (select sample, n, greatest(coalesce(quantile_cont(abs(m_rd-rd_center),0.995),0),0.01) rt, case when count(m_baf)>0 then greatest(quantile_cont(abs(m_baf-baf_center),0.995),0.002) end bt from groups join v_centres using (sample) group by 1,2)
 select sample, chrom, s "start", n, round(rt,6) rd_threshold, round(bt,6) baf_threshold, abs(mean_rd-rd_center)>rt passes_rd, coalesce(mean_bafdev-baf_center>bt,false) passes_baf,
  abs(mean_rd-rd_center)>rt and coalesce(mean_bafdev-baf_center>bt,false) joint_support from v_segments join th using (sample,n) join v_centres using (sample)""")
def w6(v):
    return cn.review_segments(cn.segments(flags(v)), shared.bins(v), centres(v)).select("sample", "chrom", "start", "n", *r6("rd_threshold", "baf_threshold"), "passes_rd", "passes_baf", "joint_support")


EVENTS = "(select unnest(['mosaic_loss','mosaic_gain','copy_neutral_loh']) event), (select unnest([0.05,0.1,0.2,0.3,0.5]) fraction)"


@query("W7_power_grid", f"""select sample, n, event, cast(fraction as double) fraction, round(avg(cast(case event when 'mosaic_loss' then mean_rd-rd_center-fraction/2 < -rd_threshold when 'mosaic_gain' then mean_rd-rd_center+fraction/2>rd_threshold
 else mean_baf-baf_center+fraction/2>baf_threshold end as int)),6) power from v_placements join v_centres using (sample) join v_thresholds using (sample,n), {EVENTS} group by 1,2,3,4""")
def w7(v):
    g, c = placements(v), centres(v)
    return cn.power_grid(g, c, cn.empirical_thresholds(g, c)).select("sample", "n", "event", "fraction", *r6("power"))


def gated(v):
    calls, stats = shared.mosaic(v)
    return mosaic.gate_columns(calls, stats)


@query("F20_mosaic_gates", "select call_id, g0, g1, g2, g3, g4 from v_gates")
def f20(v):
    return gated(v).select("call_id", *[F.col(g).alias(f"g{i}") for i, g in enumerate(mosaic.GATES)])


@query("A26_waterfall", """with f as (select case when not g0 then 0 when not g1 then 1 when not g2 then 2 when not g3 then 3 when not g4 then 4 else 9 end f from v_gates)
 select step, (select count(*) from f where f>=step) "before", (select count(*) from f where f=step) excluded, (select count(*) from f where f>step) "after" from (select unnest([0,1,2,3,4]) step)""")
def a26(v):
    return mosaic.waterfall(gated(v)).select("step", "before", "excluded", "after")


MASK = "(cast(not g0 as int)+2*cast(not g1 as int)+4*cast(not g2 as int)+8*cast(not g3 as int)+16*cast(not g4 as int))"


@query("A27_ablation", f"select cast(d as int) disabled, cast(sum(case when {MASK} & ~cast(d as int) = 0 then 1 else 0 end) as bigint) retained from v_gates, (select unnest(range(32)) d) group by d")
def a27(v):
    return mosaic.ablation_counts(gated(v))


@query("A27_ablation_members", f"select cast(d as int) disabled, call_id from v_gates, (select unnest(range(32)) d) where {MASK} & ~cast(d as int) = 0")
def a27b(v):
    return mosaic.ablation_members(gated(v), "call_id")


@query("A28_gate_failures", " union all ".join(f"select '{g}' gate, count(*) filter (where not g{i}) failing_all, count(*) filter (where not g{i} and typ not like 'CNP%') failing_non_cnp from v_gates" for i, g in enumerate(mosaic.GATES)))
def a28(v):
    return mosaic.gate_failures(gated(v))


@query("F23_special_regions", "select special_regions, count(*) n from (select case when chrom='chr6' and c_start<33480487 and c_end>27518931 then 'MHC' when chrom='chr19' and c_start<54992731 and c_end>54071492 then 'KIR' else '' end special_regions from v_mosaic) group by 1")
def f23(v):
    calls, _ = shared.mosaic(v)
    return mosaic.special_tags(calls, "c_start", "c_end").groupBy("special_regions").agg(F.count("*").alias("n"))


@query("A44_review_counters", """select count(*) calls, count(*) filter (where not isnan(lod_phase) and lod_phase>5) phase_lod_gt5, count(*) filter (where not isnan(lod_phase) and lod_phase>10) phase_lod_gt10, count(*) filter (where n_hets=0) zero_het_calls,
 count(*) filter (where n_hets<10) below_10_het_calls, count(*) filter (where (call_id%10)/10.0>0.5) majority_masked, count(*) filter (where call_id%3>0) rd_overlapping, count(*) filter (where call_id%9=1) rd_joint_supported from v_mosaic""")
def a44(v):
    calls, _ = shared.mosaic(v)
    c = calls.withColumn("masked_fraction", (F.col("call_id") % 10) / 10.0).withColumn("rd_segments", F.col("call_id") % 3).withColumn("rd_joint_segments", (F.col("call_id") % 9 == 1).cast("int"))
    return mosaic.review_counters(c)


@query("G31_review_labels", """select case when typ like 'CNP%' then 'known_CNP_context_not_mCA_evidence' when typ='Loss' and n_hets=0 then 'loss_without_heterozygous_support' else 'gain_germline_like_or_mapping_context_unresolved' end label, count(*) n from v_mosaic group by 1""")
def g31(v):
    calls, _ = shared.mosaic(v)
    return calls.groupBy(clinical.mosaic_review_class(F.col("type"), F.col("n_hets")).alias("label")).agg(F.count("*").alias("n"))


MIX = """(select k scenario, a, b, c, 1000-a-b-c rest from (select o_orderkey k, (o_orderkey*7)%300 a, (o_orderkey*11)%300 b, (o_orderkey*13)%300 c from orders))"""


@query("A43_mixture", f"""select scenario, round((rest+2*a+b+c)/1000.0,6) a_copies, round((rest+a+2*b)/1000.0,6) b_copies, round((2*rest+3*a+3*b+c)/2000.0,6) relative_rd, round((rest+a+2*b)*1.0e0/(2*rest+3*a+3*b+c),6) baf_b from {MIX}""")
def a43(v):
    k = F.col("o_orderkey")
    part = {"AAB": (k * 7) % 300, "ABB": (k * 11) % 300, "A": (k * 13) % 300}
    rest = F.lit(1000) - part["AAB"] - part["ABB"] - part["A"]
    states = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), n.alias("cells")) for s, n in {**part, "AB": rest}.items()]))
    counts = v.table("orders").select(k.alias("scenario"), states.alias("s")).select("scenario", "s.*")
    cells = cn.cell_enumeration(counts)
    mixed = cn.mixture_expectations(counts.withColumn("fraction", F.col("cells") / 1000.0))
    # Both ways must agree; the SQL twin works from the integers.
    both = cells.join(mixed.select("scenario", F.col("relative_rd").alias("_m")), "scenario").filter("abs(relative_rd - _m) < 1e-9")
    return both.select("scenario", *r6("a_copies", "b_copies", "relative_rd", "baf_b"))
