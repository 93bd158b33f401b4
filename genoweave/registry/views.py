"""Genomic-shaped views over the given tables, written once for Spark and for the SQL check.

Every view is a plain projection or aggregate of a whole table. ``{arr}`` is the array literal
of the engine at hand; table names stand for the Parquet files.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    # Calls: one per order.
    "v_calls": """
select 'chr'||cast(o_custkey%22+1 as varchar(9)) contig, (o_orderkey*7919)%5000000+1 pos, o_orderkey src_row,
  substr('ACGT',cast(o_orderkey%4+1 as int),1) ref, substr('CGTA',cast(o_orderkey%4+1 as int),1) alt,
  substr('GTAC',cast(o_orderkey%4+1 as int),1) alt2,
  case o_orderkey%6 when 0 then '0/1' when 1 then '1/1' when 2 then '0/0' when 3 then '1/.' when 4 then './.' else '0|1' end gt,
  case o_orderstatus when 'F' then '.' when 'O' then 'PASS' else 'LowQual' end flt, o_totalprice/5000 qual, o_orderpriority pr,
  case when o_orderkey%11=0 then null else cast((o_orderkey*13)%60 as int) end dp,
  case when o_orderkey%9=0 then null else cast((o_orderkey*7)%60 as int) end gq,
  cast((o_orderkey*5)%50 as int) ad0, cast((o_orderkey*3)%45 as int) ad1,
  cast((o_orderkey*17)%90 as int) pl0, cast(case when o_orderkey%6 in (0,5) then 0 else (o_orderkey*19)%90 end as int) pl1,
  cast((o_orderkey*23)%90 as int) pl2
from orders""",
    # Multiallelic records: every fifth call lists two ALTs.
    "v_multi": """
select contig, pos, src_row, ref, alt, alt2, flt, case when src_row%5=0 then 2 else 1 end n_alts,
  case when src_row%5<>0 then gt when src_row%4=0 then '1/2' when src_row%4=1 then '0/2' when src_row%4=2 then '2/.' else '1|2' end gt,
  dp, gq, ad0, ad1, cast((src_row*11)%20 as int) ad2, pl0, pl1, pl2, cast((src_row*29)%90 as int) pl3, cast((src_row*31)%90 as int) pl4,
  cast((src_row*37)%90 as int) pl5
from v_calls""",
    # Alleles with insertions, deletions, complex and symbolic ALTs.
    "v_alleles": """
select contig, pos, src_row, gt,
  case src_row%10 when 0 then 'AT' when 1 then 'A' when 2 then 'ATG' when 3 then 'A' when 4 then 'CAGAG' when 5 then 'TTA' when 6 then 'GATC' when 7 then 'ACGT' else ref end ref,
  case src_row%10 when 0 then 'A' when 1 then 'AG' when 2 then 'ACG' when 3 then '<DEL>' when 4 then 'CAG' when 5 then 'TTA' when 6 then 'CATG' when 7 then 'ATT' else alt end alt
from v_calls""",
    "v_core": """
select contig,pos,src_row,ref,alt, case gt when '0/1' then '1/1' when '1/1' then '0/1' when '1/.' then '0/1'
  when './.' then '0/0' else gt end gt, flt from v_calls where src_row%3<>0""",
    "v_catalog": """
select contig,pos,ref,alt,src_row allele_id, case pr when '1-URGENT' then 'Pathogenic' when '2-HIGH' then 'Likely_pathogenic'
  when '3-MEDIUM' then 'Uncertain_significance' when '4-NOT SPECIFIED' then 'Conflicting_classifications_of_pathogenicity'
  else 'Benign' end clnsig, case when src_row%15=0 then '.' else 'reviewed_by_'||cast(src_row%4 as varchar(9)) end review
from v_calls where src_row%5=0""",
    "v_annotated": """
select c.contig, c.pos, c.src_row, c.ref, c.alt, c.gt, c.flt, k.allele_id, k.clnsig, k.review
from v_calls c left join v_catalog k on c.contig=k.contig and c.pos=k.pos and c.ref=k.ref and c.alt=k.alt""",
    "v_state": """
select *, case when gt in ('1/.','./.') then 'missing_or_partial' when gt='0/0' then 'reference' when gt='1/1' then 'homozygous_alt'
  else 'heterozygous_alt' end state, gt not in ('0/0','./.') called from v_annotated""",
    "v_core_state": """
select c.*, k.allele_id, k.clnsig, case when c.gt in ('1/.','./.') then 'missing_or_partial' when c.gt='0/0' then 'reference' when c.gt='1/1' then 'homozygous_alt'
  else 'heterozygous_alt' end state, c.gt not in ('0/0','./.') called
from v_core c left join v_catalog k on c.contig=k.contig and c.pos=k.pos and c.ref=k.ref and c.alt=k.alt""",
    # Genes and three-exon transcripts: one per part.
    "v_genes": """
select 'chr'||cast(p_partkey%22+1 as varchar(9)) g_contig, p_partkey gene_id, p_brand gene,
  (p_partkey*104729)%5000000 g_start, (p_partkey*104729)%5000000+p_size*2000 g_end from part""",
    "v_exons": """
select 'chr'||cast(p_partkey%22+1 as varchar(9)) contig, p_partkey tx, p_brand gene, case when p_partkey%2=0 then 1 else -1 end strand,
  (p_partkey*104729)%5000000+i*p_size*600+1 e_start, (p_partkey*104729)%5000000+i*p_size*600+p_size*200 e_end,
  (p_partkey*104729)%5000000+p_size*100+1 cds_start, (p_partkey*104729)%5000000+p_size*1300 cds_end, i exon_index
from (select *, 0 i from part union all select *, 1 i from part union all select *, 2 i from part) x""",
    "v_masks": """
select 'chr'||cast(p_partkey%22+1 as varchar(9)) m_chrom, (p_partkey*7001)%60000000 m_start, (p_partkey*7001)%60000000+p_size*3000 m_end from part""",
    # Copy-number bins of three samples.
    "v_bins": """
select l_returnflag sample, 'chr'||cast(l_suppkey%22+1 as varchar(9)) chrom, (l_orderkey%60)*1000000 b_start, (l_orderkey%60)*1000000+1000000 b_end,
  count(*) n, sum(l_quantity)/count(*) depth, 0.25+(((l_orderkey%60)*7+(l_suppkey%22)*13)%40)/100.0e0 gc,
  case when count(*)%7=0 then null else sqrt(sum(l_linenumber)%50+1.0e0)/170 end bafdev, count(*)%20 hets,
  (l_orderkey%60)*100+l_suppkey%22 ordinal
from lineitem group by l_returnflag, l_suppkey%22, l_orderkey%60""",
    "v_clean": """
select sample, chrom, b_start, b_end, depth/25.0e0 rd, bafdev, hets, ordinal, depth, gc from v_bins where n%9<>0""",
    # Structural calls: one per customer.
    "v_sv": """
select 'chr'||cast(c_custkey%22+1 as varchar(9)) chrom, (c_custkey*15485863)%5000000+1 pos, c_custkey id,
  case when c_custkey%3=2 then 'LowQual' else 'PASS' end flt,
  case c_custkey%4 when 0 then 'DEL' when 1 then 'DUP' when 2 then 'INV' else 'BND' end svtype,
  (c_custkey*15485863)%5000000+1+case when c_custkey%97=0 then 12000000 else (c_custkey%40)*900 end sv_end,
  'chr'||cast((c_custkey*7)%22+1 as varchar(9)) chr2, (c_custkey*32452843)%5000000+1 pos2,
  case c_custkey%5 when 0 then '0/1' when 1 then '1/1' when 2 then '0/0' when 3 then './.' else '0|1' end gt,
  c_custkey%17 pe, case when c_custkey%8=0 then null else c_custkey%13 end sr, c_custkey%61 mapq, (c_custkey*3)%61 srmapq, (c_custkey*7)%50 gq,
  case when c_custkey%6=0 then 'LowQual' else 'PASS' end ft, case when c_custkey%10=0 then null else c_custkey%4 end rdcn
from customer""",
    "v_mosaic": """
select o_orderkey call_id, 'S'||cast(o_custkey%40 as varchar(9)) sample_id, case when o_custkey%2=0 then 'M' else 'F' end computed_gender,
  case when o_orderkey%23=0 then 'chrX' else 'chr'||cast(o_orderkey%22+1 as varchar(9)) end chrom,
  (o_orderkey*104729)%60000000 c_start, (o_orderkey*104729)%60000000+(o_orderkey%1000)*20000+1 c_end, (o_orderkey%1000)*20000+1 len,
  (o_orderkey%37)/100.0e0 bdev, (o_orderkey%50)*10000 n50_hets,
  case when o_orderkey%6=0 then cast('nan' as double) else cast((o_orderkey*7)%30 as double) end lod_conc,
  case when o_orderkey%5=0 then cast('nan' as double) else 0.01e0 end bdev_se,
  case when o_orderkey%4=0 then cast('nan' as double) else cast((o_orderkey*11)%30 as double) end lod_phase,
  1.5e0+(o_orderkey%20)/10.0e0 rel_cov, case o_orderkey%7 when 0 then 'CNP_Loss' when 1 then 'Gain' when 2 then 'CN-LOH' else 'Loss' end typ,
  o_orderkey%25 n_hets
from orders""",
    "v_mosaic_stats": """
select 'S'||cast(s_suppkey as varchar(9)) sample_id, 0.95e0+(s_suppkey%5)/100.0e0 call_rate, (s_suppkey%8)/200.0e0 baf_auto from supplier where s_suppkey<40""",
    # Reads: one per line item, five CIGAR shapes.
    "v_sam": """
select 'T'||cast(l_orderkey as varchar(20)) qname,
  cast(1+case when l_linenumber%2=0 then 64 else 128 end+case when l_suppkey%2=1 then 16 else 0 end+case when l_suppkey%3=0 then 32 else 0 end
   +case when l_partkey%29=0 then 1024 else 0 end+case when l_partkey%31=0 then 2048 else 0 end+case when l_partkey%37=0 or l_orderkey%41=0 then 4 else 0 end
   +case when l_partkey%23=0 or l_orderkey%41=0 then 8 else 0 end as int) flag,
  'chr'||cast(l_suppkey%3+1 as varchar(9)) rname, (l_partkey*31)%5000+1 pos, cast(l_quantity as int)+10 mapq, l_linenumber%5 shape,
  case l_linenumber%5 when 0 then '50M' when 1 then '10S40M' when 2 then '30M5I15M' when 3 then '20M3D30M' else '30M20S' end cigar,
  case when l_partkey%13=0 then 'chr9' else '=' end mate_rname, (l_suppkey*37)%5000+1 mate_pos, (l_partkey*7)%3000-1500 tlen,
  substr(repeat('ACGTTGCAAGCTTTACCGGA',5), cast((l_partkey+l_suppkey)%20+1 as int), 50) seq,
  substr(repeat('IIIIIIII5IIII!II',6), cast(l_suppkey%16+1 as int), 50) qual,
  case when l_partkey%19=0 then 'chr1,'||cast(l_partkey%5000 as varchar(9))||',+,50M,'||cast(l_suppkey%60 as varchar(9))||',0;' else '' end sa,
  cast((l_partkey*3)%200 as int) s1, cast((l_partkey*5)%200 as int) s2, (l_partkey*100000+l_suppkey)*10+l_linenumber ordinal
from lineitem""",
    "v_shapes": """
select * from (values (0,0,0,50),(1,0,10,40),(2,0,0,30),(2,30,35,15),(3,0,0,20),(3,23,20,30),(4,0,0,30)) t(shape,b_ref,b_query,b_len)""",
    "v_spans": """
select r.*, case shape when 0 then 50 when 1 then 40 when 2 then 45 when 3 then 53 else 30 end ref_len,
  case shape when 1 then 40 when 4 then 30 else 50 end aligned,
  flag%32>=16 rev, flag%8>=4 unm, flag%16>=8 mate_unm, (flag%2048>=1024 or flag%4096>=2048) notprim
from v_sam r""",
    "v_sites": """
select 'chr'||cast(s_suppkey%3+1 as varchar(9)) site_contig, (s_suppkey*53)%5000+1 site, substr('ACGT',cast(s_suppkey%4+1 as int),1) site_ref,
  substr('CGTA',cast(s_suppkey%4+1 as int),1) site_alt from supplier""",
    "v_site_bases": """
select s.site_contig, s.site, s.site_ref, s.site_alt, r.qname, r.ordinal, r.mapq, r.rev, r.unm, r.notprim, r.pos,
  substr(r.seq, cast(b.b_query+s.site-(r.pos+b.b_ref)+1 as int), 1) base, ascii(substr(r.qual, cast(b.b_query+s.site-(r.pos+b.b_ref)+1 as int), 1))-33 bq
from v_spans r join v_shapes b on r.shape=b.shape join v_sites s on s.site_contig=r.rname and s.site>=r.pos+b.b_ref and s.site<r.pos+b.b_ref+b.b_len""",
    "v_depth": """
select 'chr'||cast(l_suppkey%3+1 as varchar(9)) chrom, (l_partkey*3)%5000+1 pos, count(*) q0, sum(case when l_quantity>=20 then 1 else 0 end) q20,
  sum(case when l_quantity>=40 then 1 else 0 end) q60 from lineitem group by l_suppkey%3, (l_partkey*3)%5000""",
    "v_targets": """
select 'iv'||cast(s_suppkey as varchar(9)) label, 'chr'||cast(s_suppkey%4+1 as varchar(9)) i_chrom, (s_suppkey*211)%4500+1 i_start, (s_suppkey*211)%4500+100+s_suppkey i_end from supplier""",
    # Sequences: called bases of every document.
    "v_reads": """
select doc_id, lang, regexp_replace(upper(text),'[^ACGT]',''{g}) seq from documents""",
    "v_anchored": """
select 'doc'||cast(o_orderkey%500 as varchar(9)) contig, (o_orderkey*7919)%400+1 pos, o_orderkey src_row,
  case when o_orderkey%13=0 then 'R' when o_orderkey%5=0 then 'a' else substr('ACGT',cast(o_orderkey%4+1 as int),1) end ref,
  substr('CGTA',cast(o_orderkey%4+1 as int),1) alt from orders""",
    "v_scores": """
select l_suppkey%10 model, l_orderkey position, l_orderkey%24+1 chrom_no,
  case when l_returnflag='A' then 'A' when l_returnflag='N' then 'C' else 'G' end effect_allele, cast(l_discount*100 as int) weight100 from lineitem""",
    "v_tracks": """
select event_type track, event_id%2 side, cast(floor(value*10) as bigint) coord, count(*) v from events group by event_type, event_id%2, cast(floor(value*10) as bigint)""",
    "v_ranks": """
select event_type profile, user_id model, min(event_id) rnk, max(value) score from events group by event_type, user_id""",
}


# Views only the SQL check reads: the same facts worked out another way.
ORACLE_VIEWS: dict[str, str] = {
    "v_span": r"""
select src_row, contig, pos, ref, alt, gt, p, s, case when length(ref)-p-s>0 then pos+p else greatest(pos,pos+p-1) end s_start,
  case when length(ref)-p-s>0 then pos+length(ref)-s-1 else greatest(pos,pos+p-1)+1 end s_end
from (select *, len(list_filter(range(1, least(length(ref),length(alt))-p+1), lambda i: right(ref,cast(i as int))=right(alt,cast(i as int)))) s
  from (select *, len(list_filter(range(1, least(length(ref),length(alt))+1), lambda i: substr(ref,1,cast(i as int))=substr(alt,1,cast(i as int)))) p
    from v_alleles where regexp_matches(ref,'^[ACGTNacgtn]+$') and regexp_matches(alt,'^[ACGTNacgtn]+$')))""",
    "v_runs": """
select *, sum(jump) over (partition by sample, chrom order by b_start) run from (select *, case when b_start-lag(b_end) over (partition by sample, chrom order by b_start)<=100000 then 0 else 1 end jump from v_clean)""",
    "v_centres": """
select sample, rd_center, baf_center, 1.4826*quantile_cont(abs(rd-rd_center),0.5) rd_noise, 1.4826*quantile_cont(abs(bafdev-baf_center),0.5) baf_noise from v_clean join
  (select sample, quantile_cont(rd,0.5) rd_center, quantile_cont(bafdev,0.5) baf_center from v_clean group by sample) using (sample) group by sample, rd_center, baf_center""",
    "v_placements": " union all ".join(
        f"""select sample, chrom, {n} n, b_start, mean_rd, mean_baf from (select sample, chrom, b_start, avg(rd) over w mean_rd, case when count(bafdev) over w={n} then avg(bafdev) over w end mean_baf, count(*) over w c
from v_runs window w as (partition by sample, chrom, run order by b_start rows between {n - 1} preceding and current row)) where c={n}"""
        for n in (3, 4, 5, 10, 20)
    ),
    "v_thresholds": """
select sample, n, count(*) placements, greatest(quantile_cont(abs(mean_rd-rd_center),0.995),0.01) rd_threshold, case when count(mean_baf)>0 then greatest(quantile_cont(abs(mean_baf-baf_center),0.995),0.002) end baf_threshold
from v_placements join v_centres using (sample) group by sample, n""",
    "v_shifts": """
select sample, chrom, b_start, b_end, rd, bafdev, hets, rd_center, baf_center, rd_noise, baf_noise, quantile_cont(o_rd,0.5)-rd_center rd_shift, coalesce(quantile_cont(o_baf,0.5)-baf_center,0) baf_shift from (
 select a.*, b.rd o_rd, b.bafdev o_baf from (select *, row_number() over (partition by sample, chrom order by b_start) i from v_clean) a
 join (select sample, chrom, b_start, rd, bafdev, row_number() over (partition by sample, chrom order by b_start) i from v_clean) b
 on a.sample=b.sample and a.chrom=b.chrom and abs(a.i-b.i)<=2 and abs(a.b_start-b.b_start)<=2200000) join v_centres using (sample)
group by sample, chrom, b_start, b_end, rd, bafdev, hets, rd_center, baf_center, rd_noise, baf_noise""",
    "v_flags": """
select *, case when rd_shift < -greatest(0.03,3*rd_noise/sqrt(5)) then 'loss_like' when rd_shift > greatest(0.03,3*rd_noise/sqrt(5)) then 'gain_like'
  when baf_shift > greatest(0.005,3*baf_noise/sqrt(5)) then 'copy_neutral_loh_like' end flag from v_shifts""",
    "v_segments": """
select sample, chrom, flag label, min(b_start) s, max(b_end) e, count(*) n, quantile_cont(rd,0.5) median_rd, quantile_cont(bafdev,0.5) median_bafdev, sum(hets) het_count, avg(rd) mean_rd, avg(bafdev) mean_bafdev from (
 select *, sum(brk) over (partition by sample, chrom order by b_start) seg from (select *, case when flag is not distinct from lag(flag) over w and b_start-lag(b_end) over w<=100000 then 0 else 1 end brk from v_flags window w as (partition by sample, chrom order by b_start)))
where flag is not null group by sample, chrom, flag, seg having count(*)>=3""",
    "v_gates": """
select m.*, not (call_rate<0.97 or baf_auto>0.03) g0, typ not like 'CNP%' g1,
 (chrom like '%X%' and computed_gender='M') or bdev<0.1 or n50_hets<200000 or (not isnan(lod_conc) and lod_conc>10) g2,
 not isnan(bdev_se) or (not isnan(lod_phase) and lod_phase>10) g3,
 rel_cov<2.1 or bdev<0.05 or (len>500000 and bdev<0.1 and rel_cov<2.5) or (len>5000000 and bdev<0.15) g4
from v_mosaic m join v_mosaic_stats using (sample_id)""",
    "v_parts": """
select id, svtype, 'span' part, chrom p_chrom, pos-1 p_start, greatest(pos, sv_end) p_end from v_sv where svtype<>'BND' union all
select id, svtype, 'breakpoint', chrom, pos-1, pos from v_sv union all
select id, svtype, 'breakpoint', chr2, pos2-1, pos2 from v_sv where svtype='BND' union all
select id, svtype, 'breakpoint', chrom, sv_end-1, sv_end from v_sv where svtype<>'BND'""",
    "v_contacts": """
select id, svtype, gene_id, bool_or(part='breakpoint') bp, bool_or(part='span') sp from v_parts join v_genes on p_chrom=g_contig and p_start<g_end and g_start<p_end group by id, svtype, gene_id""",
}


def _fill(text: str, spark_engine: bool) -> str:
    return text.replace("{g}", "" if spark_engine else ",'g'")


def _needs(text: str) -> list[str]:
    """Views a text refers to, dependencies first."""
    ordered: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\bv_[a-z0-9_]+\b", body):
            text = VIEWS.get(name) or ORACLE_VIEWS.get(name)
            if text and name not in ordered:
                visit(text)
                ordered.append(name)

    visit(text)
    return ordered


def with_views(sql: str) -> str:
    """SQL text for the check tool with the views it names spelled out."""
    ctes = [f"{name} as ({_fill(VIEWS.get(name) or ORACLE_VIEWS[name], False)})" for name in _needs(sql)]
    body = sql.strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(ctes) + ",\n" + body[len("with recursive "):]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body


class Views:
    """Frames over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        names = _needs(f"select * from {name}")
        def bind(text):
            return re.sub(
                rf"\b(from|join)\s+({'|'.join(TABLES)})\b", lambda m: f"{m.group(1)} parquet.`{self.folder}/{m.group(2)}.parquet`", _fill(text, True)
            )
        ctes = ",\n".join(f"{n} as ({bind(VIEWS[n])})" for n in names)
        return self.spark.sql(f"with {ctes} select * from {name}")
