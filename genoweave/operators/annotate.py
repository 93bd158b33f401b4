"""Annotation responses, ranked profiles, phenotype labels and candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoweave.functions import alleles as fa
from genoweave.functions import clinical, coords
from genoweave.session import guard

# Open prediction fields and their printed labels.
PREDICTIONS = (
    ("am_class", "AlphaMissense Class"),
    ("am_pathogenicity", "AlphaMissense Pathogenicity"),
    ("conservation", "Conservation"),
    ("phaplo", "Dosage Sensitivity (Haplo)"),
    ("ptriplo", "Dosage Sensitivity (Triplo)"),
    ("lof", "Loss of Function (Loftee)"),
    ("nmd", "Nonsense-mediated Decay"),
    ("utr_annotator", "UTR Annotator"),
    ("mutfunc", "Mutfunc"),
    ("loeuf", "Loss of Function (LOEUF)"),
)

_TEXT_FIELDS = ("transcript_id", "gene_symbol", "mane_select", "hgvsc", "hgvsp", "amino_acids", "sift_prediction", "polyphen_prediction")
TRANSCRIPT = (
    "struct<" + ", ".join(f"{name}: string" for name in _TEXT_FIELDS) + ", canonical: int, consequence_terms: array<string>, "
    "sift_score: double, polyphen_score: double, " + ", ".join(f"{name}: string" for name, _ in PREDICTIONS)
    + ", alphamissense: struct<am_class: string, am_pathogenicity: string>>"
)
VEP_SCHEMA = (
    "array<struct<assembly_name: string, seq_region_name: string, start: long, allele_string: string, "
    f"most_severe_consequence: string, transcript_consequences: array<{TRANSCRIPT}>>>"
)
POPULATION = "struct<id: string, ac: long, an: long, homozygote_count: long>"
SUBSET = f"struct<ac: long, an: long, af: double, homozygote_count: long, filters: array<string>, populations: array<{POPULATION}>>"
FREQUENCY_SCHEMA = (
    f"struct<errors: array<string>, data: struct<variant: struct<variant_id: string, flags: array<string>, "
    f"exome: {SUBSET}, genome: {SUBSET}, joint: {SUBSET}>>>"
)
COOCCURRENCE_SCHEMA = (
    "struct<data: struct<variant_cooccurrence: struct<variant_ids: array<string>, genotype_counts: array<long>, "
    "haplotype_counts: array<long>, p_compound_heterozygous: double, "
    "populations: array<struct<id: string, genotype_counts: array<long>>>>>>"
)
REFSNP_SCHEMA = (
    "struct<refsnp_id: string, primary_snapshot_data: struct<variant_type: string, "
    "placements_with_allele: array<struct<seq_id: string, is_ptlp: boolean, "
    "placement_annot: struct<seq_id_traits_by_assembly: array<struct<assembly_accession: string>>>, "
    "alleles: array<struct<hgvs: string, allele: struct<spdi: struct<seq_id: string, position: long, deleted_sequence: string, inserted_sequence: string>>>>>>, "
    "allele_annotations: array<struct<"
    "assembly_annotation: array<struct<genes: array<struct<locus: string>>>>, "
    "clinical: array<struct<clinical_significances: array<string>>>, "
    "frequency: array<struct<study_name: string, allele_count: long, total_count: long>>>>>>"
)


def primary_consequences(responses: DataFrame, alleles: DataFrame) -> DataFrame:
    """Primary transcript rows per allele: the gene's MANE Select, else its canonical transcripts.

    ``responses``: id, vep (parsed list). ``alleles``: id, gene, contig, pos, ref, alt. A response
    whose minimal allele is another one fails the job; an allele without response has no rows.
    """
    top = responses.select("id", F.get("vep", F.lit(0)).alias("_t")).filter("_t is not null")
    joined = alleles.join(top, "id")
    text = F.split(F.col("_t.allele_string"), "/")
    dash = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    seen = fa.minimal_alleles(F.col("_t.start"), dash(text[0]), dash(text[1]))
    want = fa.minimal_alleles(F.col("pos"), F.col("ref"), F.col("alt"))
    same = (F.col("_t.assembly_name") == "GRCh38") & (coords.chrom_key(F.col("contig")) == F.col("_t.seq_region_name")) & (seen == want)
    checked = guard(joined, same, "annotation response is for another allele")
    own = F.filter("_t.transcript_consequences", lambda t: t["gene_symbol"] == F.col("gene"))
    mane = F.filter(own, lambda t: F.coalesce(t["mane_select"], F.lit("")) != "")
    canonical = F.filter(own, lambda t: t["canonical"] == 1)
    picked = F.when(F.size(mane) > 0, mane).otherwise(canonical)
    label = F.when(F.size(mane) > 0, "MANE_Select").otherwise("canonical_fallback")
    return checked.select("id", "gene", label.alias("selection"), F.explode(picked).alias("t")).select(
        "id", "gene", "selection", *[F.col(f"t.{c}").alias(c) for c in ("transcript_id", "mane_select", "hgvsc", "hgvsp", "consequence_terms", "lof")]
    )


def predictions_long(transcripts: DataFrame) -> DataFrame:
    """(transcript_id, gene, metric, value) rows of the predictions a transcript carries."""
    def scored(word, score):
        return F.when(F.col(score).isNotNull(), F.concat(F.col(word), F.lit(" ("), F.col(score).cast("string"), F.lit(")"))).otherwise(F.col(word))
    pairs = [
        ("Consequence", F.when(F.size("consequence_terms") > 0, F.array_join("consequence_terms", ", "))),
        ("Amino Acids", F.when(F.col("amino_acids") != "", F.col("amino_acids"))),
        ("SIFT", scored("sift_prediction", "sift_score")),
        ("PolyPhen", scored("polyphen_prediction", "polyphen_score")),
    ]
    for field, label in PREDICTIONS:
        value = F.col(field)
        if field in ("am_class", "am_pathogenicity"):
            value = F.coalesce(value, F.col(f"alphamissense.{field}"))
        pairs.append((label, value.cast("string")))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in pairs]))
    named = transcripts.select("transcript_id", F.coalesce("gene_symbol", F.lit("Unknown")).alias("gene"), rows.alias("p"))
    return named.select("transcript_id", "gene", "p.metric", "p.value").filter("value is not null")


def population_frequencies(responses: DataFrame) -> DataFrame:
    """Frequency rows per allele, subset and population; a subset not returned is not zero.

    ``responses``: id, gnomad (parsed). AF is recomputed as ac/an, NULL without alleles; sex
    strata (ids with '_') stay out.
    """
    v = "gnomad.data.variant"
    def subset(name):
        d = f"{v}.{name}"
        qc = F.when(F.col(d).isNull(), "not_returned")
        if name == "joint":
            qc = qc.otherwise("joint_filter_field_not_requested")
        else:
            qc = qc.when(F.size(f"{d}.filters") == 0, "PASS_no_filters_returned").otherwise(F.array_join(f"{d}.filters", ","))
        whole = F.struct(F.lit(name).alias("subset"), F.col(f"{d}.ac").alias("ac"), F.col(f"{d}.an").alias("an"), F.col(f"{d}.homozygote_count").alias("homozygotes"), qc.alias("qc"))
        kept = F.filter(f"{d}.populations", lambda p: F.instr(p["id"], "_") == 0)
        pops = F.transform(
            F.coalesce(kept, F.array().cast(f"array<{POPULATION}>")),
            lambda p: F.struct(F.concat(F.lit(f"{name}_"), p["id"]).alias("subset"), p["ac"].alias("ac"), p["an"].alias("an"), p["homozygote_count"].alias("homozygotes"), qc.alias("qc")),
        )
        return F.concat(F.array(whole), pops)
    checked = guard(responses, F.coalesce(F.size("gnomad.errors"), F.lit(0)) <= 0, "frequency response holds errors")
    rows = checked.select("id", F.explode(F.concat(*[subset(n) for n in ("exome", "genome", "joint")])).alias("s")).select("id", "s.*")
    af = F.when(F.col("an") > 0, F.col("ac") / F.col("an"))
    coverage = F.when(F.col("qc") == "not_returned", "not_returned; not_zero_AF").otherwise("AN is genotype callability")
    return rows.withColumn("af", af).withColumn("coverage", coverage)


def listed_frequencies(rows: DataFrame, key: str, listing: str) -> DataFrame:
    """'src=pct,src=pct' to rows with the exact fraction; an empty list says so."""
    text = F.coalesce(F.col(listing), F.lit(""))
    item = F.explode(F.split(text, ","))
    parts = rows.select(key, item.alias("_i"))
    percent = F.when(F.instr("_i", "=") > 0, F.substring_index("_i", "=", -1))
    source = F.when(F.col("_i") == "", "no_frequency_returned").otherwise(F.substring_index("_i", "=", 1))
    return parts.select(key, source.alias("source"), percent.alias("percent"), clinical.percent_to_fraction(percent).alias("fraction"))


def cooccurrence(responses: DataFrame) -> DataFrame:
    """Population co-occurrence of an allele pair; all NULL when the record is absent."""
    c = "co.data.variant_cooccurrence"
    return responses.select(
        "id", F.col(c).isNotNull().alias("available"), F.col(f"{c}.variant_ids").alias("variant_ids"),
        F.col(f"{c}.genotype_counts").alias("genotype_counts"), F.col(f"{c}.haplotype_counts").alias("haplotype_counts"),
        F.col(f"{c}.p_compound_heterozygous").alias("p_compound_heterozygous"),
        F.coalesce(F.size(f"{c}.populations"), F.lit(0)).alias("populations"),
    )


def abbreviate_refsnp(responses: DataFrame, assembly: str) -> DataFrame:
    """Genes, clinical terms, study counts and placements of a RefSNP record for one assembly."""
    s = "snp.primary_snapshot_data"
    def inner(outer, field):
        return F.flatten(F.filter(F.transform(outer, lambda a: a[field]), lambda x: x.isNotNull()))
    notes = F.col(f"{s}.allele_annotations")
    genes = F.transform(inner(inner(notes, "assembly_annotation"), "genes"), lambda g: g["locus"])
    terms = inner(inner(notes, "clinical"), "clinical_significances")
    counted = F.filter(inner(notes, "frequency"), lambda f: f["allele_count"].isNotNull() & (f["total_count"] > 0))
    here = F.filter(
        f"{s}.placements_with_allele",
        lambda p: F.coalesce(p["is_ptlp"], F.lit(False))
        & F.exists(p["placement_annot"]["seq_id_traits_by_assembly"], lambda t: t["assembly_accession"] == assembly),
    )
    spdis = F.flatten(F.transform(here, lambda p: F.transform(p["alleles"], lambda a: a["allele"]["spdi"])))
    variants = F.flatten(F.transform(here, lambda p: F.filter(p["alleles"], lambda a: ~F.coalesce(a["hgvs"].endswith("="), F.lit(False)))))
    none = F.array().cast("array<string>")
    return responses.select(
        "id", F.col("snp.refsnp_id").alias("refsnp_id"), F.col(f"{s}.variant_type").alias("variant_type"),
        F.coalesce(F.array_sort(F.array_distinct(F.filter(genes, lambda g: F.coalesce(g, F.lit("")) != ""))), none).alias("genes"),
        F.coalesce(terms, none).alias("clinical_significances"),
        F.coalesce(F.size(counted), F.lit(0)).alias("frequency_entries"),
        F.coalesce(F.size(here), F.lit(0)).alias("placements"),
        F.coalesce(F.size(variants), F.lit(0)).alias("variant_alleles"),
        F.coalesce(F.transform(spdis, lambda d: coords.spdi(d["seq_id"], d["position"], d["deleted_sequence"], d["inserted_sequence"])), none).alias("spdis"),
    )


def refsnp_frequencies(responses: DataFrame) -> DataFrame:
    """(id, study, allele_count, total_count) rows of a RefSNP record."""
    notes = F.explode("snp.primary_snapshot_data.allele_annotations")
    rows = responses.select("id", notes.alias("a")).select("id", F.explode("a.frequency").alias("f")).select("id", "f.*")
    return rows.filter("allele_count is not null and total_count > 0")


def transcript_structures(genes: DataFrame, only: str = "all") -> DataFrame:
    """Transcripts of expanded genes with UTR bounds and TSS; only = all, mane or canonical."""
    tx = genes.select("gene", F.col("seq_region_name").alias("chrom"), F.explode("transcripts").alias("t"))
    if only == "mane":
        tx = tx.filter(F.size("t.MANE") > 0)
    elif only == "canonical":
        tx = tx.filter("t.is_canonical = 1")
    utr = coords.utr_bounds(F.col("t.strand"), F.col("t.start"), F.col("t.end"), F.col("t.Translation.start"), F.col("t.Translation.end"))
    return tx.select(
        "gene", "chrom", F.col("t.id").alias("tx"), F.col("t.strand").alias("strand"), F.col("t.biotype").alias("biotype"),
        F.size("t.Exon").alias("exons"), coords.tss(F.col("t.strand"), F.col("t.start"), F.col("t.end")).alias("tss"),
        F.when(F.col("t.Translation").isNotNull(), utr).alias("utr"),
    )


def wide_ranks(ranks: DataFrame, profiles: tuple[str, ...], deltas: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """One row per model with its rank and score per profile, rank differences and best rank.

    ``ranks``: model, profile, rank, score. One aggregate replaces a chain of outer joins; a
    model missing from a profile has NULL there and NULL differences.
    """
    def at(profile, column):
        return F.min(F.when(F.col("profile") == profile, F.col(column)))
    picks = [at(p, c).alias(f"{p}_{c}") for p in profiles for c in ("rank", "score")]
    wide = ranks.filter(F.col("profile").isin(*profiles)).groupBy("model").agg(F.min("rank").alias("best_rank"), *picks)
    for name, left, right in deltas:
        wide = wide.withColumn(name, F.col(f"{left}_rank") - F.col(f"{right}_rank"))
    return wide


def rerank_after_filter(ranks: DataFrame, keys: list[str], rank: str = "rank", tie: str = "model", block: int = 4096) -> DataFrame:
    """Display rank after rows were filtered out; the original rank is kept.

    Ranks are counted per block of original ranks and offset by the blocks before, so no task
    sorts a whole profile.
    """
    blocked = ranks.withColumn("_b", F.floor(F.col(rank) / block))
    sizes = blocked.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = Window.partitionBy(*keys, "_b").orderBy(rank, tie)
    return blocked.join(offset, [*keys, "_b"]).withColumn("display_rank", F.row_number().over(local) + F.col("_o")).drop("_b", "_o")


def annotation_coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    def present(c):
        return F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), present("functional_class").alias("functional_class_present"), present("hgvs").alias("hgvs_present"),
        F.count_if((F.coalesce("frequency_source", F.lit("")) != "") & F.col("frequency").isNotNull()).alias("frequency_present"),
        F.count_if(~F.coalesce("clinvar", F.lit("")).isin("", "NOT_PROVIDED")).alias("clinvar_present"),
    )


def coordinate_mentions(lines: DataFrame, positions: DataFrame, text: str = "text") -> DataFrame:
    """Lines that write a position, plainly or with thousands separators.

    Numbers are pulled out of each whole line once and meet positions by an equi join.
    """
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?<!\d)(\d{1,3}(?:,\d{3})+|\d+)(?!\d)"), 1)))
    found = lines.select(*[c for c in lines.columns if c != text], token.alias("_t"))
    number = F.replace("_t", F.lit(","), F.lit("")).try_cast("long")
    return found.select("*", number.alias("pos")).drop("_t").filter("pos is not null").distinct().join(positions.select("pos").distinct(), "pos")


def phenotype_mentions(paragraphs: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """(paragraph, hpo_id) for each term whose pattern the whole paragraph matches.

    The pattern list is short and written by hand, so each paragraph is tested in one pass
    without a join.
    """
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(f"(?i){p}"), F.lit(h)) for h, p in patterns.items()]))
    return paragraphs.select(*[c for c in paragraphs.columns if c != text], F.explode(hits).alias("hpo_id"))


def curate_profiles(curation: DataFrame, labels: DataFrame, profiles: DataFrame) -> DataFrame:
    """Ordered profile terms with curated labels.

    ``curation``: hpo_id, label, subject. ``labels``: hpo_id, pinned_label. ``profiles``: profile,
    terms (ordered array). A label that differs from the pinned ontology, or a profile term that
    is not a curated feature of the proband, fails the job; family rows are never scored.
    """
    pinned = guard(curation.join(labels, "hpo_id", "left"), F.col("label").eqNullSafe(F.col("pinned_label")), "pinned label mismatch")
    terms = profiles.select("profile", F.posexplode("terms").alias("term_order", "hpo_id"))
    joined = terms.join(pinned, "hpo_id", "left")
    checked = guard(joined, F.col("subject") == "proband", "profile term is not a curated proband feature")
    return checked.select("profile", "term_order", "hpo_id", "label")


def genes_with_terms(mapping: DataFrame, terms: DataFrame) -> DataFrame:
    """(gene, hpo_id) of the requested terms; at most the number of terms per gene."""
    return mapping.join(terms, "hpo_id", "left_semi").select("gene", "hpo_id").distinct()


def select_candidates(ranked: DataFrame, manual: DataFrame) -> DataFrame:
    """Candidates by allele key from ranked rows plus a manual list, with rows per profile kept apart.

    ``ranked``: profile, gene, contig, pos, ref, alt. A manual allele never replaces a ranked one.
    """
    key = ["contig", "pos", "ref", "alt"]
    both = ranked.select(*key, "gene", "profile", F.lit(1).alias("_r")).unionByName(
        manual.select(*key, "gene", F.lit(None).cast("string").alias("profile"), F.lit(0).alias("_r"))
    )
    return both.groupBy(*key).agg(
        F.max_by("gene", F.struct("_r", "gene")).alias("gene"), F.sum("_r").alias("ranked_rows"),
        F.count_distinct("profile").alias("profiles"), (F.max("_r") == 0).alias("manual_only"),
    ).withColumn("id", F.concat_ws("-", coords.chrom_key(F.col("contig")), "pos", "ref", "alt"))


def gene_presence(ranked: DataFrame, genes: DataFrame) -> DataFrame:
    """Ranked rows per requested gene; zero is 'no candidate', not an absent gene."""
    seen = ranked.groupBy("gene").agg(F.count("*").alias("rows"))
    out = genes.join(seen, "gene", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return out.withColumn("status", F.when(F.col("rows") > 0, "present_in_ranked_outputs").otherwise("no_candidate_in_ranked_outputs"))


def candidate_dossier(candidates: DataFrame, transcripts: DataFrame, frequencies: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per candidate: transcript, HGVS, catalogue ids and frequency status.

    Catalogue matches per exact allele are a handful of records, so their ids fit in an array.
    """
    first = transcripts.groupBy("id").agg(F.min(F.struct("transcript_id", "hgvsc", "hgvsp", "selection")).alias("_t"))
    freq = frequencies.groupBy("id").agg(F.count("af").alias("frequencies"), F.max("af").alias("max_af"))
    matches = catalog.groupBy("contig", "pos", "ref", "alt").agg(
        F.array_sort(F.collect_set("allele_id")).alias("catalog_ids"), F.array_sort(F.collect_set("clnsig")).alias("catalog_significance")
    )
    joined = candidates.join(first, "id", "left").join(freq, "id", "left").join(matches, ["contig", "pos", "ref", "alt"], "left")
    return joined.select(
        "id", "gene", "contig", "pos", "ref", "alt", F.col("_t.transcript_id").alias("primary_transcript"), F.col("_t.hgvsc").alias("hgvs_c"),
        F.when(F.col("_t").isNotNull(), "completed_exact_allele_checked").otherwise("unavailable").alias("annotation_status"),
        F.coalesce("frequencies", F.lit(0)).alias("frequencies"), "max_af",
        F.when(F.col("catalog_ids").isNotNull(), "exact_normalized_allele_match").otherwise("no_exact_record_in_snapshot").alias("catalog_status"),
        F.array_join("catalog_ids", ",").alias("catalog_ids"), F.array_join("catalog_significance", ",").alias("catalog_significance"),
    )


def panel_evidence(lineage: DataFrame, panels: DataFrame) -> DataFrame:
    """Partial alleles met by a panel row through their normalised or their original key.

    ``lineage``: allele_id, key, original_key. ``panels``: panel, key.
    """
    either = lineage.select("allele_id", F.explode(F.array_distinct(F.array("key", "original_key"))).alias("key"))
    return either.join(panels.select("panel", "key").distinct(), "key").select("panel", "allele_id").distinct()


def containment(rows: DataFrame, genes: str, blacklist: DataFrame) -> DataFrame:
    """Whether all genes of a row are blacklisted, by join instead of a driver-side set.

    ``rows``: id and an array of genes; ``blacklist``: gene.
    """
    each = rows.select("id", F.explode(F.array_distinct(genes)).alias("gene"))
    marked = each.join(blacklist.select("gene").distinct().withColumn("_b", F.lit(1)), "gene", "left")
    return marked.groupBy("id").agg(
        F.count("*").alias("genes"), F.count("_b").alias("blacklisted"), (F.count("*") == F.count("_b")).alias("all_blacklisted")
    )


def uncurated_terms(profile_terms: DataFrame, curation: DataFrame) -> DataFrame:
    return profile_terms.join(curation.filter("subject = 'proband'"), "hpo_id", "left_anti")


def first_matching(ranked: DataFrame, condition: Column) -> DataFrame:
    """The best-ranked row that satisfies a predicate, if any."""
    return ranked.filter(condition).orderBy("rank", "model").limit(1)
