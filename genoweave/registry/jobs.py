"""Composite jobs end to end over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from genoweave.functions import genotype as fg
from genoweave.operators import panels, tracks
from genoweave.plans import copynumber as plan_cn
from genoweave.plans import panels as plan_panels
from genoweave.plans import reads as plan_reads
from genoweave.plans import structural as plan_sv
from genoweave.plans import variants as plan_calls
from genoweave.registry import alignments, copies, geometry, notes, phasing, scoring, shared, tracking, variants
from genoweave.registry.core import query
from genoweave.sources import text


@query("X1_normalise_calls", f"select reason, count(*) records, count(*) filter (where reason='match') normalised, cast(0 as bigint) unbalanced from ({variants.REF_AUDIT}) group by reason")
def x1(v):
    records = shared.seq_records(v)
    chunks = text.chunk_sequences(records, step=64)
    c = v("v_anchored").select("contig", "pos", "src_row", "ref", F.array("alt").alias("alts"), fg.parse_gt(F.lit("0/1")).alias("gt"), F.lit(False).alias("phased"), F.array(F.lit(1), F.lit(2)).alias("ad"),
                               F.array(F.lit(9), F.lit(0), F.lit(9)).alias("pl"), F.lit(3).alias("dp"), F.lit(30).alias("gq"))
    out = plan_calls.normalise_calls(c, records.select("contig", F.col("contig").alias("target")), chunks, step=64)
    n = out["normalised"].agg(F.count("*").alias("_n")).withColumn("_k", F.lit(1))
    bad = out["unbalanced"].agg(F.count("*").alias("unbalanced")).withColumn("_k", F.lit(1))
    both = out["reasons"].withColumn("_k", F.lit(1)).join(n, "_k").join(bad, "_k")
    return both.select("reason", "records", F.when(F.col("reason") == "match", F.col("_n")).otherwise(F.lit(0)).alias("normalised"), "unbalanced")


@query("X2_prepare_catalog", "select 'catalog' part, count(*) n from v_calls where src_row%7=0 union all select 'unsupported', count(*) from v_calls where src_row%7<>0 union all select 'unbalanced', 0")
def x2(v):
    ref = v("v_calls").select(F.col("contig").alias("target")).distinct().withColumn("target_length", F.lit(5000000).cast("long"))
    sites = v("v_calls").select(F.when(F.col("src_row") % 7 == 0, F.regexp_replace("contig", "chr", "")).otherwise(F.concat("contig", F.lit("_alt"))).alias("contig"), "pos", "ref", F.array("alt").alias("alts"), "src_row")
    out = plan_calls.prepare_catalog(sites, variants.contig_table(v), ref)
    frames = [out[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k in ("catalog", "unsupported", "unbalanced")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("X3_clinical_report", variants.strata_sql())
def x3(v):
    cat = v("v_catalog").withColumn("clnsig", F.array("clnsig")).withColumn("review", F.array("review"))
    return plan_calls.clinical_report(shared.calls(v), cat)["strata"]


@query("X4_route_triage", f"select count(source_state) source, count(core_state) core, count(*) union_all, count(*) filter (where source_state is not null and core_state is not null) exact_in_both, count(*) filter (where source_state=core_state) state_concordant from {variants.ROUTES}")
def x4(v):
    from genoweave.operators import alleles

    cat = v("v_catalog").withColumn("clnsig", F.array("clnsig"))
    core = v("v_core").withColumn("gt", fg.parse_gt(F.col("gt")))
    return plan_calls.triage(alleles.annotate_exact(shared.calls(v), cat), alleles.annotate_exact(core, cat))[1]


@query("X5_partial_lineage")
def x5(v):
    coding = panels.coding_intervals(shared.exons(v)).select(F.col("contig").alias("c_contig"), F.col("coding_start").alias("c_start"), F.col("coding_end").alias("c_end"), "gene", "tx")
    core = v("v_core").withColumn("gt", fg.parse_gt(F.col("gt")))
    return plan_calls.partial_lineage(shared.multi(v), core, coding, v("v_catalog"))


@query("X6_panel_report")
def x6(v):
    tx = shared.exons(v).select("gene", "tx").distinct().select("gene", "tx", (F.col("tx") % 3 == 0).alias("is_mane"), F.lit(True).alias("is_canonical"))
    return plan_panels.panel_report(v("v_alleles"), shared.exons(v), tx)


@query("X7_copy_number_follow_up", """select sample, chrom, s "start", e "end", label, n from v_segments""")
def x7(v):
    return plan_cn.follow_up(shared.bins(v))["segments"].select("sample", "chrom", "start", "end", "label", "n")


@query("X7_gc_corrected_bins", """with e as (select sample, ordinal, quantile_cont(d,0.5) x from (select a.sample, a.ordinal, b.depth d, row_number() over (partition by a.sample, a.ordinal order by abs(b.gc-a.gc), b.ordinal) r from v_clean a join v_clean b on a.sample=b.sample and a.chrom<>b.chrom) where r<=200 group by 1,2),
 q as (select sample, ordinal, depth/x ratio from v_clean join e using (sample, ordinal)), c as (select sample, quantile_cont(ratio,0.5) m from q group by 1) select sample, ordinal, round(ratio/m,6) rd from q join c using (sample)""")
def x7b(v):
    b = v("v_bins").withColumnsRenamed({"b_start": "start", "b_end": "end"})
    b = b.withColumn("unique_fraction", F.when(F.col("n") % 9 == 0, 0.5).otherwise(1.0))
    b = b.withColumn("segdup_fraction", F.lit(0.0)).withColumn("gap_fraction", F.lit(0.0)).withColumn("centromere_fraction", F.lit(0.0))
    return plan_cn.corrected_bins(b).select("sample", "ordinal", F.round("rd", 6).alias("rd"))


@query("X8_mosaic_review", f"""select m.call_id, cast(coalesce(sum(least(c_end,e)-greatest(c_start,s)) filter (where s is not null),0) as bigint) masked_bp, case when not g0 then 'sample_qc' when not g1 then 'not_CNP' when not g2 then 'marker_spacing_or_phase_concordance' when not g3 then 'bdev_precision_or_strong_phase' when not g4 then 'not_germline_like_gain' else 'none' end first_failed_gate
 from v_gates m left join ({geometry.MASK_MERGED}) k on m_chrom=chrom and s<c_end and c_start<e group by all""")
def x8(v):
    calls, stats = shared.mosaic(v)
    segs = v("v_genes").select(F.col("g_contig").alias("s_chrom"), F.col("g_start").alias("s_start"), F.col("g_end").alias("s_end"), (F.col("gene_id") % 2 == 0).alias("joint_support"))
    return plan_cn.review_mosaic(calls, stats, v("v_masks"), segs).select("call_id", "masked_bp", "first_failed_gate")


@query("X9_sv_candidates")
def x9(v):
    from genoweave.registry import structures

    p = F.when(F.col("gene") % 11 == 0, "core").when(F.col("gene") % 2 == 0, "nonspecific").otherwise("direct")
    c = plan_sv.prioritised_candidates(shared.svs(v), structures.genes(v), structures.exons(v), p)
    return c.select("id", "gene", "relation", "exon_bp", "cds_bp", "technical_gate", "review_class")


@query("X10_target_callability")
def x10(v):
    x = shared.exons(v).withColumn("gene", F.concat("gene", F.lit("_"), "tx"))
    return plan_sv.target_callability(alignments.depth_long(v), x, ("q0", "q20", "q60"))


@query("X11_breakpoint_evidence", f"select rname, \"cluster\", id sv_id from (select rname, min(\"left\") \"cluster\" from {alignments.CLUSTERED} group by rname, g) join v_sv on chrom=rname and abs(pos%5000-\"cluster\")<=10")
def x11(v):
    s = v("v_sv").select(F.col("id").alias("sv_id"), F.col("chrom").alias("sv_contig"), (F.col("pos") % 5000).alias("sv_pos"))
    return plan_reads.breakpoint_evidence(shared.reads(v), s)["matching_calls"]


@query("X12_locus_reconstruction")
def x12(v):
    r = v("v_reads").select(F.col("doc_id").alias("template"), "seq")
    return plan_reads.reconstruct_locus(r, k=25, quality=None, min_length=30)


@query("X13_fragment_phase")
def x13(v):
    reference = phasing.marker_sites(v).select("contig", "pos", F.col("ref").alias("ref_base"))
    t = phasing.marker_sites(v)
    het = t.filter("pos % 2 = 0")
    r = shared.reads(v, walk=False).withColumn("molecule", F.col("qname"))
    return plan_reads.fragment_phase(r, het, reference, t)["components"]


@query("X14_profile_comparison", "select model, min(rnk) best_rank, min(rnk) filter (where profile='view')-min(rnk) filter (where profile='click') view_minus_click, min(rnk) filter (where profile='error')-min(rnk) filter (where profile='view') error_minus_view from v_ranks where profile in ('click','view','error') group by model")
def x14(v):
    from genoweave.operators import annotate

    r = v("v_ranks").withColumnRenamed("rnk", "rank")
    return annotate.wide_ranks(r, notes.PROFILES, (("view_minus_click", "view", "click"), ("error_minus_view", "error", "view"))).select("model", "best_rank", "view_minus_click", "error_minus_view")


@query("X16_polygenic_sums", scoring.RAW)
def x16(v):
    return scoring.a29(v)


@query("X18_profile_tracks", f"select track, count(*) filter (where in_ref and in_alt) matched, count(*) filter (where not (in_ref and in_alt)) unmatched, cast(sum(rv) as double) ref_sum, cast(sum(av) as double) alt_sum from {tracking.OUTER} group by track")
def x18(v):
    s = tracks.junction_summary(tracking.aligned(v), ["track"]).select("track", "matched", "unmatched")
    t = tracks.compare_tracks(tracking.long_values(v), ["track"]).select("track", "ref_sum", "alt_sum")
    return s.join(t, "track")


@query("X19_mixture_table", f"select count(*) scenarios, round(avg((2*rest+3*a+3*b+c)/2000.0),6) mean_rd from {copies.MIX}")
def x19(v):
    return copies.a43(v).agg(F.count("*").alias("scenarios"), F.round(F.avg("relative_rd"), 6).alias("mean_rd"))


@query("X15_candidate_dossier", """select p_partkey id, case when p_partkey%2=0 then 'M' else 'C' end||':c.'||cast(p_partkey as varchar) hgvs_c, case when p_partkey%7=0 then 'exact_normalized_allele_match' else 'no_exact_record_in_snapshot' end catalog_status from part""")
def x15(v):
    from genoweave.operators import annotate

    a = notes.allele_rows(v)
    cat = a.filter("id % 7 = 0").select("contig", "pos", "ref", "alt", F.col("id").alias("allele_id"), F.lit("Benign").alias("clnsig"))
    return annotate.candidate_dossier(a, notes.primary(v), notes.frequencies(v), cat).select("id", "hgvs_c", "catalog_status")


@query("X17_screen_summary", """select 'pgx_accepted' what, count(*) n from v_calls where gt not in ('1/.','./.') and dp>=10 and coalesce(gq, case when gt='0/0' then pl0 end)>=20 union all select 'mtdna_positions', count(*) from (select distinct site_contig, site, site_ref from v_site_bases)
 union all select 'pair_names', count(*) from (select qname from v_spans where unm and mate_unm and not flag%4096>=2048 group by qname)""")
def x17(v):
    from genoweave.operators import mtdna, reads

    reason = fg.pgx_reason(F.col("gt"), F.col("dp"), F.col("gq"), F.col("pl0"))
    pgx = shared.calls(v).filter(reason.isNull()).agg(F.lit("pgx_accepted").alias("what"), F.count("*").alias("n"))
    mt = mtdna.depth_summary(alignments.decoded(v)).select(F.lit("mtdna_positions").alias("what"), F.col("positions_reported").alias("n"))
    pairs = reads.unmapped_pairs(v("v_sam")).agg(F.lit("pair_names").alias("what"), F.count("*").alias("n"))
    return pgx.unionByName(mt).unionByName(pairs)


@query("S21_site_recount", "select count(*) records, count(*) filter (where n_alts=2) multiallelic_sites, count(*) filter (where gt='0/0') hom_ref from v_multi")
def s21(v):
    from genoweave.operators import strata

    return strata.site_statistics(shared.multi(v)).select("records", "multiallelic_sites", "hom_ref")
