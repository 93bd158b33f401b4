"""Contigs, regions, breakend mates, identifiers and transcript landmarks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chrom_key(contig: Column) -> Column:
    """Strip a chr prefix, upper-case, and write the mitochondrion as MT."""
    bare = F.upper(F.regexp_replace(F.trim(contig), "^(chr|CHR)", ""))
    return F.when(bare == "M", "MT").otherwise(bare)


def chrom_letter(contig: Column) -> Column:
    """Numbered sex chromosomes and mitochondrion to letters."""
    key = chrom_key(contig)
    return F.when(key == "23", "X").when(key == "24", "Y").otherwise(key)


def is_autosome(contig: Column) -> Column:
    number = chrom_key(contig).try_cast("int")
    return F.coalesce(number.between(1, 22), F.lit(False))


def ucsc_name(contig: Column) -> Column:
    """Target name of a catalogue contig: chr-prefixed, MT and M as chrM."""
    return (
        F.when(contig.isin("MT", "M"), "chrM")
        .when(contig.startswith("chr"), contig)
        .otherwise(F.concat(F.lit("chr"), contig))
    )


def parse_region(text: Column) -> Column:
    """'chr1:1,000-2,000' to contig, start, end (1-based closed); NULL when malformed."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    pattern = r"^(.+):(\d+)-(\d+)$"
    start = F.regexp_extract(plain, pattern, 2).try_cast("long")
    end = F.regexp_extract(plain, pattern, 3).try_cast("long")
    contig = F.regexp_extract(text, r"^(.+):[\d,]+-[\d,]+$", 1)
    return F.when(
        (start >= 1) & (end >= start),
        F.struct(contig.alias("contig"), start.alias("start"), end.alias("end")),
    )


def parse_target(text: Column) -> Column:
    """'chr1:5' or 'chr1:5:A:G' to contig, pos, ref, alt; NULL when malformed."""
    pattern = r"^([^:]+):([\d,]+)(?::([ACGT]+):([ACGT]+))?$"
    pos = F.replace(F.regexp_extract(text, pattern, 2), F.lit(","), F.lit("")).try_cast("long")
    def part(i):
        value = F.regexp_extract(text, pattern, i)
        return F.when(value != "", value)
    return F.when(
        pos >= 1,
        F.struct(part(1).alias("contig"), pos.alias("pos"), part(3).alias("ref"), part(4).alias("alt")),
    )


def breakend_mates(alt: Column) -> Column:
    """Mate loci written in breakend brackets."""
    pattern = r"[\[\]]([^:\[\]]+):(\d+)[\[\]]"
    chroms = F.regexp_extract_all(alt, F.lit(pattern), 1)
    places = F.regexp_extract_all(alt, F.lit(pattern), 2)
    return F.transform(
        F.arrays_zip(chroms.alias("c"), places.alias("p")),
        lambda m: F.struct(m["c"].alias("contig"), m["p"].cast("long").alias("pos")),
    )


def spdi(seq_id: Column, position: Column, deleted: Column, inserted: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws(
        ":", F.coalesce(seq_id, blank), F.coalesce(position.cast("string"), blank),
        F.coalesce(deleted, blank), F.coalesce(inserted, blank),
    )


def rsid_number(text: Column) -> Column:
    """Digits of an rsID; anything else stops the job."""
    bare = F.regexp_replace(F.lower(F.trim(text)), "^rs", "")
    return F.when(bare.rlike("^[0-9]+$"), bare).otherwise(F.raise_error(F.concat(F.lit("invalid rsID: "), text)))


def centred_window(pos: Column, bits: int = 20) -> Column:
    """Half-open window of 2**bits bases around a 1-based SNV."""
    half = 1 << (bits - 1)
    return F.struct((pos - half).cast("long").alias("start"), (pos + half).cast("long").alias("end"))


def anchor_window(pos: Column, bits: int = 20) -> Column:
    """Half-open window of 2**bits bases that a resize around a one-base anchor gives."""
    start = pos - 1 - ((1 << bits) - 1) // 2
    return F.struct(start.cast("long").alias("start"), (start + (1 << bits)).cast("long").alias("end"))


def insert_fixed_length(sequence: Column, anchor: Column, inserted: Column) -> Column:
    """Insert after the 0-based anchor base and trim right so the length stays."""
    grown = F.concat(
        F.substring(sequence, F.lit(1), anchor + 1), inserted,
        F.substring(sequence, anchor + 2, F.length(sequence)),
    )
    return F.substring(grown, F.lit(1), F.length(sequence))


def substitute_base(sequence: Column, offset: Column, base: Column) -> Column:
    """Replace the 0-based base at ``offset``."""
    return F.overlay(sequence, base, offset + 1, F.lit(1))


def tss(strand: Column, start: Column, end: Column) -> Column:
    return F.when(strand == 1, start).otherwise(end)


def utr_bounds(strand: Column, tx_start: Column, tx_end: Column, cds_start: Column, cds_end: Column) -> Column:
    """Genomic 5' and 3' untranslated bounds by strand; NULL where the CDS reaches the end."""
    def bound(start, end):
        return F.when(start <= end, F.struct(start.alias("start"), end.alias("end")))
    low, high = bound(tx_start, cds_start - 1), bound(cds_end + 1, tx_end)
    return F.struct(
        F.when(strand == 1, low).otherwise(high).alias("five_prime"),
        F.when(strand == 1, high).otherwise(low).alias("three_prime"),
    )
