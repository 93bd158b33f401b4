"""Polygenic scores, pharmacogene summaries, taxonomy reconciliation, resumable runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from genoweave.operators import scores
from genoweave.registry.core import query
from genoweave.session import shared_folder
from genoweave.sources import text
from genoweave.streaming import ledger, resumable


def score_lines(v, marks: bool = False):
    """Score files of ten models: header lines and rows; weights are whole hundredths.

    Files differ in their column order, and a third have more columns. With ``marks`` model 6 has
    rows that name it an interaction model.
    """
    s = v("v_scores")
    name = F.concat(F.lit("PGS"), F.lpad(F.col("model").cast("string"), 6, "0"))
    odd = F.col("position") % 97
    weight = F.when(odd == 0, F.lit("")).when(odd == 1, F.lit("nan")).when(odd == 2, F.lit("abc")).otherwise(F.col("weight100").cast("string"))
    interaction = F.when((F.col("model") == 6) & (F.col("position") % 89 < 30), "True").otherwise("") if marks else F.lit("False")
    cells = {"hm_chr": F.col("chrom_no").cast("string"), "hm_pos": F.col("position").cast("string"), "effect_allele": F.lower("effect_allele"), "effect_weight": weight, "rsID": F.lit("."), "is_interaction": interaction}
    orders = (["hm_chr", "hm_pos", "effect_allele", "effect_weight"], ["effect_weight", "effect_allele", "hm_pos", "hm_chr"], ["rsID", "hm_pos", "is_interaction", "effect_weight", "hm_chr", "effect_allele"])
    kind_of = (F.when(F.col("model") == 6, 2).otherwise(F.col("model") % 3)).cast("int")
    pick = lambda made: F.element_at(F.array(*[made(o) for o in orders]), kind_of + 1)
    rows = s.select(name.alias("file"), pick(lambda o: F.concat_ws("\t", *[cells[c] for c in o])).alias("value"))
    models = s.select("model", name.alias("file")).distinct()
    build = F.when(F.col("model") == 9, "GRCh37").otherwise("GRCh38")
    kind = F.when(F.col("model") == 8, "OR").when(F.col("model") == 7, "log(OR)").otherwise("beta")
    names = pick(lambda o: F.lit("\t".join(o)))
    heads = models.select("file", F.explode(F.array(F.concat(F.lit("#HmPOS_build="), build), F.concat(F.lit("#weight_type="), kind), F.lit("###meta"), names)).alias("value"))
    return rows.unionByName(heads)


@query("S11_score_scan", "select 'PGS'||lpad(cast(model as varchar),6,'0') model, case when model=9 then 'GRCh37' else 'GRCh38' end build, case model when 8 then 'OR' when 7 then 'log(OR)' else 'beta' end kind, count(*) n, sum(position) positions, count(*) filter (where effect_allele='A') a_rows from v_scores group by 1,2,3")
def s11(v):
    lines = score_lines(v)
    meta = text.score_metadata(lines).select(F.col("file").alias("model"), F.col("metadata")["hmpos_build"].alias("build"), F.col("metadata")["weight_type"].alias("kind"))
    rows = text.score_rows(lines).groupBy(F.col("file").alias("model")).agg(F.count("*").alias("n"), F.sum(F.col("hm_pos").cast("long")).alias("positions"), F.count_if(F.col("effect_allele") == "a").alias("a_rows"))
    return meta.join(rows, "model")


@query("F21_model_eligibility", f"select 'PGS'||lpad(cast(model as varchar),6,'0') model, case when model=9 then 'harmonized_build_missing_or_mismatched' when model=8 then 'unsupported_nonadditive_or_or_only_weight_type' when bool_or(model=6 and position%89<30) then '{scores.COMPLEX_REASON}' end model_reason from v_scores group by model")
def f21(v):
    sums, failed = resumable.score_batch(score_lines(v, marks=True), genotypes(v))
    return sums.select("model", F.lit(None).cast("string").alias("model_reason")).unionByName(failed)


@query("F21_row_classes", "select 'PGS'||lpad(cast(model as varchar),6,'0') model, count(*) source_rows, count(*) filter (where position%97 in (0,2)) malformed, count(*) filter (where position%97=1) nonfinite, count(*) filter (where position%97>2 and chrom_no>22) excluded, count(*) filter (where position%97>2 and chrom_no<=22) valid from v_scores group by 1")
def f21b(v):
    rows = text.score_rows(score_lines(v))
    return scores.row_counters(scores.row_class(rows), "file").withColumnRenamed("file", "model")


def genotypes(v):
    """Genotyped positions: REF/ALT per order with 0, 1 or 2 ALT copies."""
    c = v("v_calls")
    n = (F.col("src_row") % 3).cast("int")
    return c.filter("src_row % 2 = 0").select(
        (F.col("src_row") % 24 + 1).cast("string").alias("chrom"), F.col("src_row").alias("pos"), F.array("ref", "alt").alias("alleles"),
        F.map_from_arrays(F.array("ref", "alt"), F.array(F.lit(2) - n, n)).alias("counts"))


GENO = "(select src_row pos, ref, alt, src_row%3 n from v_calls where src_row%2=0)"
DECIDED = "(select model, position pos, min(effect_allele) effect, min(weight100) w, count(*) copies, count(distinct effect_allele||':'||cast(weight100 as varchar))>1 amb from v_scores where position%97>2 and chrom_no<=22 {extra} group by 1,2)"
MATCHED = f"(select d.*, d.effect in (g.ref,g.alt) known, case when d.effect=g.alt then g.n when d.effect=g.ref then 2-g.n end dosage from {DECIDED.format(extra='and position in (select pos from ' + GENO + ')')} d join {GENO} g using (pos))"


def valid_rows(v):
    s = v("v_scores").filter("position % 97 > 2 and chrom_no <= 22")
    return s.select("model", F.col("chrom_no").cast("string").alias("chrom"), F.col("position").alias("pos"), F.col("effect_allele").alias("effect"), F.col("weight100").cast("double").alias("weight"), F.col("weight100").cast("string").alias("weight_text"))


@query("A30_duplicate_policy", f"select model, count(*) positions, count(*) filter (where amb) ambiguous, cast(sum(copies) as bigint) copies from {DECIDED.format(extra='')} group by model")
def a30(v):
    d = scores.resolve_duplicates(valid_rows(v))
    return d.groupBy("model").agg(F.count("*").alias("positions"), F.count_if(F.col("ambiguous")).alias("ambiguous"), F.sum("copies").alias("copies"))


@query("J22_score_join", f"select model, pos, known allele_known, amb ambiguous, dosage from {MATCHED}")
def j22(v):
    return scores.match_scores(valid_rows(v), genotypes(v)).select("model", "pos", "allele_known", "ambiguous", F.col("dosage").cast("long").alias("dosage"))


RAW = f"select model, cast(sum(dosage*w) filter (where known and not amb) as double) raw_sum, count(*) filter (where known and not amb) matched, count(*) filter (where amb) ambiguous_positions, cast(sum(copies-1) as bigint) duplicate_rows, count(*) filter (where not known and not amb) allele_mismatch from {MATCHED} group by model"


@query("A29_raw_sums", RAW)
def a29(v):
    return scores.raw_sums(scores.match_scores(valid_rows(v), genotypes(v)))


@query("S12_variant_table", "select cast(src_row%24+1 as varchar) chrom, src_row pos from v_calls where src_row%2=0 and src_row%10<>0")
def s12(v):
    c = v("v_calls").filter("src_row % 2 = 0")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("src_row") % 24 + 1), "src_row", F.lit("id"), "ref", "alt")
    # Every fifth position is written twice and must vanish.
    twice = c.filter("src_row % 10 = 0")
    lines = c.select(line.alias("value")).unionByName(twice.select(line.alias("value"))).unionByName(c.select(F.lit("##x=1").alias("value")).distinct())
    p = text.parse_pvar(lines).withColumn("dosage_of", F.lit("ALT"))
    return scores.unique_positions(p).select(F.when(F.col("chrom").isin("X", "Y"), "sex").otherwise(F.col("chrom")).alias("chrom"), "pos")


@query("A31_gene_report", "select p_brand gene, count(*) \"rows\", count(distinct p_type) diplotypes, count(distinct case when p_size>10 then p_name end) phenotypes from part group by 1")
def a31(v):
    p = v.table("part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("diplotype"), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("").alias("phenotype"))
    return scores.gene_report(p)


@query("A31_missing_positions", "select p_brand gene, count(*) missing from part where p_size%2=0 group by 1")
def a31b(v):
    p = v.table("part")
    tag = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("PX="), "p_brand", F.lit(";AF=1"))).otherwise(F.lit("AF=1"))
    return scores.missing_positions(p.select(F.concat_ws("\t", F.lit("chr1"), "p_partkey", tag, F.lit("x")).alias("value")))


@query("S18_kraken_report", "select cast(sum(case when user_id%2=0 then 1 else 0 end) as bigint) unclassified, cast(sum(user_id%2) as bigint) classified, count(*) total from events")
def s18(v):
    e = v.table("events")
    two = e.groupBy((F.col("user_id") % 2).alias("taxid")).agg(F.count("*").alias("n"))
    deep = e.select(F.concat_ws("\t", F.lit("1.0"), F.lit("7"), F.lit("7"), F.lit("S"), F.col("user_id") + 100, F.lit("x")).alias("value")).distinct()
    lines = two.select(F.concat_ws("\t", F.lit("50"), "n", "n", F.lit("R"), "taxid", F.lit("root")).alias("value")).unionByName(deep)
    return text.parse_kraken(lines, e.agg(F.count("*").alias("pairs")))


@query("ST1_resumable_catalog", RAW.replace("select model,", "select 'PGS'||lpad(cast(model as varchar),6,'0') model,", 1).replace("group by model", "where model<8 group by model"))
def st1(v):
    base = f"{shared_folder(v.spark)}/catalog-{uuid.uuid4().hex}"
    files = score_lines(v).withColumn("model", F.col("file"))
    files.select("model", "value").write.partitionBy("model").text(f"{base}/in")
    out = f"{base}/out"
    # The folder name carries the model; its files come in several batches.
    stream_in = f"{base}/in/*"
    g = genotypes(v)
    resumable.run_catalog(v.spark, stream_in, out, identity=v.folder, files_per_batch=7)
    resumable.run_catalog(v.spark, stream_in, out, identity=v.folder, files_per_batch=7)
    return resumable.catalog_sums(v.spark, out, g).select("model", "raw_sum", "matched", "ambiguous_positions", "duplicate_rows", "allele_mismatch")


@query("ST2_unit_ledger", "select case when u is null then 'new' when c then 'complete' when f then 'failed' else 'review' end state, count(*) units from (select distinct user_id from events) left join (select user_id u, bool_or(event_type='purchase') c, bool_or(event_type='error') f from events where event_id%3=0 group by 1) on u=user_id group by 1")
def st2(v):
    e = v.table("events")
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed").otherwise("started")
    events = e.filter("event_id % 3 = 0").select(F.col("user_id").alias("unit"), status.alias("status"))
    known = ledger.unit_state(events).select("unit", "state")
    fresh = ledger.submittable(e.select(F.col("user_id").alias("unit")), events).withColumn("state", F.lit("new"))
    return known.unionByName(fresh).groupBy("state").agg(F.count("*").alias("units"))
