"""Reference text under intervals, transcript assembly and coding effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoweave.functions import sequence as fs
from genoweave.operators.alleles import CHUNK_STEP
from genoweave.session import guard


def fetch_spans(spans: DataFrame, chunks: DataFrame, step: int = CHUNK_STEP) -> DataFrame:
    """Add ``text``: upper-case reference under contig, start, end (0-based half-open).

    Every span asks for the chunks it touches by an equi join; the parts of one span, its length
    over the chunk step, are joined in order. Text past the contig end is missing, so a short
    ``text`` shows an out-of-bounds span.
    """
    keys = ["contig", "start", "end"]
    parts = spans.select(*keys).distinct().withColumn(
        "chunk_id", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / step)))
    )
    low = F.greatest(F.col("start"), F.col("chunk_start")) - F.col("chunk_start")
    high = F.least(F.col("end"), F.col("chunk_start") + step) - F.col("chunk_start")
    piece = F.upper(F.substring("seq", (low + 1).cast("int"), (high - low).cast("int")))
    read = parts.join(chunks.select("contig", "chunk_id", "chunk_start", "seq"), ["contig", "chunk_id"]).select(*keys, "chunk_id", piece.alias("p"))
    joined = read.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "p"))), lambda x: x["p"]), "").alias("text")
    )
    return spans.join(joined, keys, "left").withColumn("text", F.coalesce("text", F.lit("")))


def assemble(exons: DataFrame, chunks: DataFrame, step: int = CHUNK_STEP) -> DataFrame:
    """mRNA text per transcript in transcription order, with the exon table it came from.

    ``exons``: tx, contig, strand, start, end (0-based half-open). A transcript is one row of text.
    """
    fetched = fetch_spans(exons, chunks, step)
    text = F.when(F.col("strand") == 1, F.col("text")).otherwise(fs.reverse_complement(F.col("text")))
    rank = F.when(F.col("strand") == 1, F.col("start")).otherwise(-F.col("start"))
    part = F.struct(rank.alias("r"), text.alias("t"))
    return fetched.groupBy("tx", "contig", "strand").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "").alias("mrna"), F.count("*").alias("exons")
    )


def exon_offsets(exons: DataFrame) -> DataFrame:
    """cDNA start and end (1-based closed) of every exon; a transcript has a few hundred at most."""
    length = F.col("end") - F.col("start")
    rank = F.when(F.col("strand") == 1, F.col("start")).otherwise(-F.col("start"))
    along = Window.partitionBy("tx").orderBy(rank)
    before = F.coalesce(F.sum(length).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return exons.withColumn("exon_number", F.row_number().over(along)).withColumn("cdna_start", before + 1).withColumn("cdna_end", before + length)


def skip_exon(transcripts: DataFrame, offsets: DataFrame, number: int) -> DataFrame:
    """mRNA without one exon: a counterfactual, not an observation."""
    cut = offsets.filter(F.col("exon_number") == number).select("tx", F.col("cdna_start").alias("_a"), F.col("cdna_end").alias("_b"))
    left = F.expr("substring(mrna, 1, cast(_a - 1 as int))")
    right = F.expr("substring(mrna, cast(_b + 1 as int))")
    return transcripts.join(cut, "tx").withColumn("mrna", F.concat(left, right)).drop("_a", "_b")


def coding_effects(transcripts: DataFrame, offsets: DataFrame, edits: DataFrame) -> DataFrame:
    """Codon and protein effect of SNVs given as tx, pos (1-based genomic), ref, alt on the plus strand.

    ``transcripts``: tx, strand, mrna, cds_from, cds_to (1-based closed cDNA). A REF that differs
    from the transcript fails the job. ``ptc_to_junction`` is NULL without a new stop.
    """
    placed = edits.join(offsets.select("tx", "exon_number", F.col("start").alias("_s"), F.col("end").alias("_e"), "cdna_start", "cdna_end"), "tx").filter(
        (F.col("pos") > F.col("_s")) & (F.col("pos") <= F.col("_e"))
    )
    j = placed.join(transcripts, "tx")
    plus = F.col("strand") == 1
    cdna = F.when(plus, F.col("cdna_start") + F.col("pos") - F.col("_s") - 1).otherwise(F.col("cdna_start") + F.col("_e") - F.col("pos"))
    j = j.withColumn("cdna", cdna.cast("int"))
    own = lambda c: F.when(plus, F.col(c)).otherwise(fs.reverse_complement(F.col(c)))
    j = guard(j, F.substring("mrna", F.col("cdna"), F.lit(1)) == own("ref"), "REF differs from the transcript")
    cds = F.expr("substring(mrna, cast(cds_from as int), cast(cds_to - cds_from + 1 as int))")
    c_pos = F.col("cdna") - F.col("cds_from") + 1
    j = j.withColumn("cds", cds).withColumn("cds_pos", c_pos.cast("int")).filter("cdna between cds_from and cds_to")
    j = j.withColumn("alt_cds", F.overlay("cds", own("alt"), F.col("cds_pos"), F.lit(1)))
    codon = F.floor((F.col("cds_pos") + 2) / 3).cast("int")
    at = (codon - 1) * 3 + 1
    j = j.withColumn("codon_number", codon).withColumn("ref_codon", F.substring("cds", at, F.lit(3))).withColumn("alt_codon", F.substring("alt_cds", at, F.lit(3)))
    stop = F.col("alt_codon").isin("TAA", "TAG", "TGA") & ~F.col("ref_codon").isin("TAA", "TAG", "TGA")
    return j.select(
        "tx", "pos", "cdna", "cds_pos", "codon_number", "ref_codon", "alt_codon", fs.amino_acid(F.col("ref_codon")).alias("ref_aa"),
        fs.amino_acid(F.col("alt_codon")).alias("alt_aa"), "exon_number", F.when(stop, F.col("cdna_end") - (F.col("cdna") + 2)).alias("ptc_to_junction"),
    )
