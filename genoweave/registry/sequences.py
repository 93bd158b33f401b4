"""Sequence chunks, k-mers, unitigs, probes, translation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from genoweave.functions import sequence as fs
from genoweave.operators import kmers, transcripts
from genoweave.registry import shared
from genoweave.registry.core import query
from genoweave.session import cut_lineage, shared_folder
from genoweave.sources import fasta, text

RC = "translate(reverse({0}),'ACGT','TGCA')"


def canon(c):
    return f"least({c}, {RC.format(c)})"


DOCS = "(select 'doc'||cast(doc_id as varchar) contig, doc_id, lang, seq from v_reads where length(seq)>0)"


def kmer_rows(k):
    return f"(select contig, doc_id, i pos, substr(seq,cast(i as int),{k}) kmer from (select *, unnest(range(1,length(seq)-{k}+2)) i from {DOCS} where length(seq)>={k}))"


def chunks(v, step=500):
    return text.chunk_sequences(shared.seq_records(v), step=step)


@query("S15_fasta_chunks", f"select contig, i chunk_id, substr(seq, cast(i*500+1 as int), 500) seq from (select *, unnest(range(0, (length(seq)-1)//500+1)) i from {DOCS})")
def s15(v):
    # Written as FASTA files first: soft-masked lines of 60 bases, a third of them with carriage returns.
    lines = F.expr("regexp_replace(lower(seq), '(.{60})', if(length(seq) % 3 = 0, '$1\r\n', '$1\n'))")
    path = f"{shared_folder(v.spark)}/genoweave-{uuid.uuid4().hex}"
    shared.seq_records(v).select(F.concat(F.lit(">"), F.concat_ws(" ", "contig", F.lit("from text")), F.lit("\n"), lines).alias("value")).write.text(path)
    return fasta.read_fasta(v.spark, path, step=500).select("contig", "chunk_id", "seq")


@query("K1_read_kmers", f"""select kmer, count(*) n, count(distinct qname) templates from (select qname, {canon('substr(seq,cast(i as int),11)')} kmer from (select qname, seq, qual, unnest(range(1,41)) i from v_sam)
 where len(list_filter(range(0,11), lambda j: ascii(substr(qual,cast(i+j as int),1))<53))=0) group by kmer""")
def k1(v):
    r = v("v_sam").withColumn("template", F.col("qname"))
    return kmers.kmer_counts(r, 11)


def doc_kmers(v, k=31):
    r = v("v_reads").select(F.col("doc_id").alias("template"), "seq")
    return kmers.read_kmers(r, k, quality=None)


COUNTED = f"(select kmer, count(*) templates from (select distinct doc_id, {canon('kmer')} kmer from {kmer_rows(31)}) group by kmer having count(*)>=3)"


@query("K2_template_kmer_counts", f"select kmer, templates from {COUNTED}")
def k2(v):
    return kmers.template_counts(doc_kmers(v))


EDGES = f"(select distinct edge from (select kmer edge from {COUNTED} union all select {RC.format('kmer')} from {COUNTED}))"


@query("K3_debruijn_degrees", f"""select o out_degree, i in_degree, count(*) nodes from (select node, sum(o) o, sum(i) i from (select substr(edge,1,30) node, 1 o, 0 i from {EDGES} union all select substr(edge,2,30), 0, 1 from {EDGES}) group by node) group by 1,2""")
def k3(v):
    d = kmers.node_degrees(kmers.oriented_edges(kmers.template_counts(doc_kmers(v))))
    return d.groupBy("out_degree", "in_degree").agg(F.count("*").alias("nodes"))


@query("K4_unitigs")
def k4(v):
    return kmers.unitigs(cut_lineage(kmers.template_counts(doc_kmers(v))), minimum_length=40)


# Probes tile every document: 31 bases at every 25th with 50 on either side.
PROBES = f"(select distinct {canon('substr(seq,cast(o+51 as int),31)')} canonical from (select *, unnest(range(0,length(seq)-131+1,25)) o from {DOCS} where length(seq)>=131))"


def probes(v):
    return kmers.tile_probes(chunks(v), 31, flank=50)


@query("K5_reference_counts", f"""with h as (select p.canonical, contig, pos from {PROBES} p join (select contig, pos, {canon('kmer')} canonical from {kmer_rows(31)}) k on k.canonical=p.canonical), r as (select *, row_number() over (partition by canonical order by contig, pos) i from h)
 select canonical, count(*) occurrences, string_agg(contig||':'||cast(pos as varchar), ',' order by contig, pos) filter (where i<=10) first_positions from r group by canonical""")
def k5(v):
    return kmers.reference_counts(probes(v), chunks(v), 31)


@query("K6_tile_probes", f"""select contig, start, canonical, round_even(length(regexp_replace(s,'[^GC]','','g'))/31.0e0,4) gc, round_even(length(regexp_replace(w,'[^GC]','','g'))/131.0e0,4) window_gc from (
 select contig, o+51 start, substr(seq,cast(o+51 as int),31) s, {canon('substr(seq,cast(o+51 as int),31)')} canonical, substr(seq,cast(o+1 as int),131) w from (select *, unnest(range(0,length(seq)-131+1,25)) o from {DOCS} where length(seq)>=131))""")
def k6(v):
    return kmers.tile_probes(chunks(v), 31, flank=50).select("contig", "start", "canonical", "gc", "window_gc")


@query("K6_junction_probes", f"""select contig name, o "offset", {canon('substr(seq,cast(101+o as int),31)')} canonical from (select *, unnest(range(-21,-9)) o from {DOCS} where length(seq)>=100) where length(substr(seq,cast(101+o as int),31))=31""")
def k6b(v):
    h = shared.seq_records(v).filter("length(seq) >= 100").withColumnsRenamed({"contig": "name", "seq": "sequence"})
    return kmers.junction_probes(h, 31, 100).select("name", F.col("offset").cast("long").alias("offset"), "canonical")


@query("K7_probe_templates", f"""select p.canonical, count(*) templates_mapq0, count(*) filter (where doc_id%61>=20) templates_mapq20, count(*) filter (where doc_id%61>=60) templates_mapq60 from {PROBES} p join (select distinct doc_id, {canon('kmer')} canonical from {kmer_rows(31)}) k on k.canonical=p.canonical group by 1""")
def k7(v):
    r = v("v_reads").select(F.col("doc_id").alias("template"), "seq", (F.col("doc_id") % 61).alias("mapq"))
    return kmers.probe_templates(r, probes(v), 31, quality=None)


NEEDLE = "TTGCAAGCT"


@query("K8_spanning_match", f"""select strand, count(*) n, count(distinct qname) templates from (select qname, qual, '+' strand, strpos(seq,'{NEEDLE}') spot from v_sam union all select qname, qual, '-', strpos(seq,{RC.format(repr(NEEDLE))}) from v_sam)
 where spot>0 and len(list_filter(range(0,9), lambda j: ascii(substr(qual,cast(spot+j as int),1))<53))=0 group by strand""")
def k8(v):
    hit = kmers.spanning_reads(v("v_sam"), F.lit(NEEDLE))
    return hit.groupBy(F.col("match_strand").alias("strand")).agg(F.count("*").alias("n"), F.count_distinct("qname").alias("templates"))


# Needles of 12 to 200 bases at every 40th base of every document; a document's last ones are cut short.
NEEDLES = f"(select doc_id*100000+o needle_id, w from (select doc_id, o, substr(seq,cast(o+1 as int),cast(12+(doc_id*31+o)%189 as int)) w from (select *, unnest(range(0,length(seq)-11,40)) o from {DOCS} where length(seq)>=12)))"


@query("K9_exact_flank_hits", f"""select needle_id, strand, count(*) hits, sum(pos) pos_sum from (select n.needle_id, strand, k.pos from (select needle_id, '+' strand, w from {NEEDLES} union all select needle_id, '-', {RC.format('w')} from {NEEDLES}) n
 join (select seq, i pos, substr(seq,cast(i as int),12) kmer from (select *, unnest(range(1,length(seq)-10)) i from {DOCS} where length(seq)>=12)) k on k.kmer=substr(n.w,1,12) and substr(k.seq,cast(k.pos as int),length(n.w))=n.w) group by 1,2""")
def k9(v):
    r = v("v_reads").filter("length(seq) >= 12").select("doc_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 12, F.lit(40))).alias("o"))
    width = (F.lit(12) + (F.col("doc_id") * 31 + F.col("o")) % 189).cast("int")
    needles = r.select((F.col("doc_id") * 100000 + F.col("o")).alias("needle_id"), F.substring("seq", F.col("o") + 1, width).alias("needle"))
    return kmers.exact_hits(needles, chunks(v)).groupBy("needle_id", "strand").agg(F.count("*").alias("hits"), F.sum("pos").alias("pos_sum"))


# Boundaries at every 60th base of every document, a deletion of three bases at each.
BOUNDS = f"(select doc_id*100000+o id, substr(seq,cast(o+1 as int),240) l, substr(seq,cast(o+4 as int),240) r from (select *, unnest(range(0,length(seq)-242,60)) o from {DOCS} where length(seq)>=243))"


@query("K10_breakpoint_shifts", f"""select id, min(d) min_shift, max(d) max_shift, count(*) shifts from (select *, unnest(range(-20,21)) d from {BOUNDS})
 where substr(l,1,cast(120+d as int))||substr(r,cast(121+d as int)) = substr(l,1,120)||substr(r,121) group by 1""")
def k10(v):
    r = v("v_reads").filter("length(seq) >= 243").select("doc_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 243, F.lit(60))).alias("o"))
    w = r.select((F.col("doc_id") * 100000 + F.col("o")).alias("id"), F.substring("seq", F.col("o") + 1, F.lit(240)).alias("left_text"), F.substring("seq", F.col("o") + 4, F.lit(240)).alias("right_text"))
    out = kmers.breakpoint_shifts(w, reach=20)
    return out.select("id", F.col("min_shift").cast("long").alias("min_shift"), F.col("max_shift").cast("long").alias("max_shift"), "shifts")


@query("K11_local_haplotypes", f"select doc_id id, seq ref_haplotype, substr(seq,1,20)||'GATTACA'||substr(seq,23) alt_haplotype from {DOCS} where length(seq)>=30")
def k11(v):
    w = v("v_reads").filter("length(seq) >= 30").select(F.col("doc_id").alias("id"), F.col("seq").alias("text"), F.lit(20).alias("offset"), F.substring("seq", 21, 2).alias("ref"), F.lit("GATTACA").alias("alt"))
    return kmers.local_haplotypes(w)


TRANSLATE = "array_to_string(list_transform(range(0,length(c)//3), lambda i: substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', cast(16*(strpos('TCAG',substr(c,cast(i*3+1 as int),1))-1)+4*(strpos('TCAG',substr(c,cast(i*3+2 as int),1))-1)+strpos('TCAG',substr(c,cast(i*3+3 as int),1)) as int), 1)), '')"


@query("G20_translate", f"select doc_id, length(p) residues, strpos(p,'*') first_stop, p protein from (select doc_id, {TRANSLATE} p from (select doc_id, substr(seq,1,cast(length(seq)//3*3 as int)) c from {DOCS} where length(seq)>=3))")
def g20(v):
    c = F.expr("substring(seq, 1, cast(length(seq) div 3 * 3 as int))")
    p = v("v_reads").filter("length(seq) >= 3").select("doc_id", fs.translate_cds(c).alias("protein"))
    return p.select("doc_id", F.length("protein").cast("long").alias("residues"), F.coalesce(fs.first_stop(F.col("protein")), F.lit(0)).cast("long").alias("first_stop"), "protein")


@query("G20_codon_edit", f"""select doc_id, (length(c)//3+1)//2 codon, substr({TRANSLATE}, cast((length(c)//3+1)//2 as int), 1) before, 'W' "after" from (select doc_id, substr(seq,1,cast(length(seq)//3*3 as int)) c from {DOCS} where length(seq)>=9)
 where substr({TRANSLATE}, cast((length(c)//3+1)//2 as int), 1)<>'W'""")
def g20b(v):
    r = v("v_reads").filter("length(seq) >= 9").select("doc_id", F.expr("substring(seq, 1, cast(length(seq) div 3 * 3 as int))").alias("c"))
    codon = F.expr("cast((length(c) div 3 + 1) div 2 as int)")
    d = fs.protein_differences(fs.translate_cds(F.col("c")), fs.translate_cds(fs.edit_codon(F.col("c"), codon, F.lit("TGG"))))
    return r.select("doc_id", F.explode(d).alias("d")).select("doc_id", F.col("d.position").cast("long").alias("codon"), "d.before", "d.after")


def doc_exons(v):
    d = v("v_reads").filter("length(seq) >= 130")
    parts = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in ((10, 40), (60, 90), (100, 130))]))
    return d.select(F.concat(F.lit("doc"), "doc_id").alias("contig"), F.col("doc_id").alias("tx"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1).alias("strand"), parts.alias("p")).select("contig", "tx", "strand", "p.*")


MRNA = f"(select doc_id tx, case when doc_id%2=0 then m else {RC.format('m')} end mrna, m from (select doc_id, substr(seq,11,30)||substr(seq,61,30)||substr(seq,101,30) m from {DOCS} where length(seq)>=130))"


@query("G21_transcript_assembly", f"select tx, mrna, substr(mrna,1,30)||substr(mrna,61) skipped from {MRNA}")
def g21(v):
    x = doc_exons(v)
    t = transcripts.assemble(x, chunks(v, 50), step=50)
    s = transcripts.skip_exon(t, transcripts.exon_offsets(x), 2).select("tx", F.col("mrna").alias("skipped"))
    return t.select("tx", "mrna").join(s, "tx")


@query("G21_coding_effects", f"""select tx, 65 pos, case when tx%2=0 then 35 else 56 end cdna, substr(mrna,cast(((case when tx%2=0 then 35 else 56 end)-1)//3*3+1 as int),3) ref_codon from {MRNA}""")
def g21b(v):
    x = doc_exons(v)
    t = transcripts.assemble(x, chunks(v, 50), step=50).withColumn("cds_from", F.lit(1)).withColumn("cds_to", F.lit(90))
    e = v("v_reads").filter("length(seq) >= 130").select(F.col("doc_id").alias("tx"), F.lit(65).alias("pos"), F.substring("seq", 65, 1).alias("ref"))
    e = e.withColumn("alt", F.when(F.col("ref") == "A", "C").otherwise("A"))
    return transcripts.coding_effects(t.drop("contig", "exons"), transcripts.exon_offsets(x), e).select("tx", "pos", "cdna", "ref_codon")


@query("A38_gc_matched_dosage", f"""with p as (select lang region, doc_id%2=0 ctl, length(seq)%50 v, cast(floor(round_even(length(regexp_replace(seq,'[^GC]','','g'))*1.0e0/length(seq),4)/0.05) as int) g from {DOCS}), c as (select g, quantile_cont(v,0.5) m, count(*) n from p where ctl group by g)
 select region, count(*) probes, quantile_cont(v,0.5) median_count, count(*) filter (where n>=10 and m>0) gc_matched_probes, round(quantile_cont(v/m,0.5) filter (where n>=10 and m>0),6) median_ratio from p left join c using (g) group by region""")
def a38(v):
    gc = F.bround(fs.gc_fraction(F.col("seq")), 4)
    p = v("v_reads").filter("length(seq) > 0").select(F.col("lang").alias("region"), (F.col("doc_id") % 2 == 0).alias("is_control"), (F.length("seq") % 50).alias("n"), gc.alias("window_gc"))
    return kmers.gc_matched_dosage(p, ["region"], "n").select("region", "probes", "median_count", "gc_matched_probes", F.round("median_ratio", 6).alias("median_ratio"))


@query("G4_left_align")
def g4(v):
    from genoweave.operators import alleles

    # read for the calls, the text and what is not moved, so the bases are drawn from the documents once
    rec = cut_lineage(shared.seq_records(v).filter("length(seq) >= 2"))
    # A one-base deletion and insertion at every tenth base of each document, counted from its end;
    # the text is cut in one pass, each piece begins at such a base.
    size = F.length("seq")
    head = F.when(size > 11, (size - 1) % 10 + 1).otherwise(1)
    pieces = F.transform(F.regexp_extract_all(F.expr("substring(seq, _head)"), F.lit("(?s).{1,10}"), 0), lambda x: F.substring(x, 1, 2))
    c = rec.withColumn("_head", head).select("contig", "_head", size.alias("_size"), F.posexplode(pieces).alias("_i", "pair")).withColumn("pos", (F.col("_head") + F.col("_i") * 10).cast("long"))
    c = c.filter(F.col("pos") <= F.greatest(F.col("_size") - 10, F.lit(1)))
    c = c.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("src_row", F.shiftleft(F.substring("contig", 4, 20).cast("long"), 32) + F.col("pos") * 2 + F.col("kind"))
    first, pair = F.substring("pair", 1, 1), F.col("pair")
    c = c.select("contig", "src_row", "pos", F.when(F.col("kind") == 0, pair).otherwise(first).alias("ref"), F.when(F.col("kind") == 0, first).otherwise(F.concat(first, first)).alias("alt"))
    return alleles.left_align(c, text.chunk_sequences(rec, step=50), "src_row", step=50).select("contig", "pos", "ref", "alt")
