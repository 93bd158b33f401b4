"""Sequence expressions: complement, GC, translation, k-mers, pileup text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from genoweave.functions.alleles import let

# Bases in codon-table order and the standard genetic code read in that order.
CODON_BASES = "TCAG"
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTNacgtn", "TGCANtgcan"))


def canonical(sequence: Column) -> Column:
    """Lexicographically smaller of the two strands."""
    return F.least(sequence, reverse_complement(sequence))


def count_symbols(sequence: Column, symbols: str) -> Column:
    return F.length(sequence) - F.length(F.translate(sequence, symbols, ""))


def gc_fraction(sequence: Column) -> Column:
    """GC share of the called bases; NULL without any."""
    upper = F.upper(sequence)
    called = count_symbols(upper, "ACGT")
    return F.when(called > 0, count_symbols(upper, "GC") / called)


def acgt_fraction(sequence: Column) -> Column:
    upper = F.upper(sequence)
    return F.when(F.length(upper) > 0, count_symbols(upper, "ACGT") / F.length(upper)).otherwise(F.lit(0.0))


def amino_acid(codon: Column) -> Column:
    """One-letter residue of a codon, '*' for a stop, NULL for anything else."""
    digits = F.translate(codon, CODON_BASES, "0123")
    index = F.conv(digits, 4, 10).try_cast("int") + 1
    called = (F.length(codon) == 3) & (F.length(F.translate(codon, CODON_BASES, "")) == 0)
    return F.when(called, F.substring(F.lit(STANDARD_CODE), index, F.lit(1)))


# Every codon at its place in one text, and its residue at the same place of another; X elsewhere.
CODON_TEXT = "#" + "".join(f"{a}{b}{c} " for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES)
RESIDUE_TEXT = "X" + "".join(f"{r}XXX" for r in STANDARD_CODE)


def residue(codon: Column) -> Column:
    """:func:`amino_acid` of three characters, X for anything but a codon."""
    return F.substring(F.lit(RESIDUE_TEXT), F.instr(F.lit(CODON_TEXT), codon), F.lit(1))


def translate_cds(cds: Column) -> Column:
    """Protein text of a coding sequence whose length is a multiple of three, else NULL."""
    # Cut in one pass: a substring would walk from the start of the text for every codon.
    codons = F.transform(F.regexp_extract_all(cds, F.lit("(?s).{3}"), 0), residue)
    usable = (F.length(cds) >= 3) & (F.length(cds) % 3 == 0)
    return F.when(usable, F.array_join(codons, ""))


def first_stop(protein: Column) -> Column:
    """1-based codon number of the first stop, NULL without one."""
    at = F.instr(protein, "*")
    return F.when(at > 0, at)


def edit_codon(cds: Column, codon_number: Column, codon: Column) -> Column:
    return F.overlay(cds, codon, (codon_number - 1) * 3 + 1, F.lit(3))


def protein_differences(before: Column, after: Column) -> Column:
    """array<struct<position, before, after>> over the shared length; each text is worked out once."""
    def compare(b, a):
        pairs = F.zip_with(F.split(b, ""), F.split(a, ""), lambda x, y: F.struct(x.alias("before"), y.alias("after")))
        placed = F.transform(pairs, lambda p, i: F.struct((i + 1).alias("position"), p["before"].alias("before"), p["after"].alias("after")))
        return F.filter(placed, lambda p: (p["before"] != p["after"]) & (p["before"] != "") & (p["after"] != ""))

    return let(before, lambda b: let(after, lambda a: compare(b, a)))


def clean_runs(sequence: Column, k: int, starts: int = 256) -> Column:
    """Stretches of called bases in which every k-mer starts once, at most ``starts`` in each.

    Longer stretches overlap by k-1 bases, so that no k-mer is sought from the start of a long text.
    """
    return F.regexp_extract_all(F.upper(sequence), F.lit(f"(?=([ACGT]{{{k},{starts + k - 1}}}))[ACGT]{{1,{starts}}}"), 1)


def mask_low_quality(sequence: Column, quality: Column, minimum: int = 20) -> Column:
    """Write N over every base below the quality floor; a read without qualities is all N."""
    floor = chr(minimum + 33)
    marks = F.split(F.regexp_replace(quality, f"[^{floor}-~]", " "), "")
    masked = F.zip_with(
        F.split(F.upper(sequence), ""), marks, lambda b, m: F.when(m == " ", "N").otherwise(b)
    )
    known = (quality.isNotNull()) & (quality != "*") & (F.length(quality) == F.length(sequence))
    return F.when(known, F.array_join(masked, ""))


def run_kmers(run: Column, k: int) -> Column:
    """All canonical k-mers of one clean run."""
    last = F.length(run) - k + 1
    # The other strand is written once per run, not once per k-mer.
    return let(reverse_complement(run), lambda r: F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.least(F.substring(run, i, F.lit(k)), F.substring(r, last - i + 1, F.lit(k))),
    ))


def pileup_symbols(bases: Column) -> Column:
    """Pileup base text with read starts, read ends and indel runs taken out.

    An indel run is '+n' or '-n' followed by n bases; n is data, so runs are removed one after
    another, each taking exactly n bases.
    """
    plain = F.replace(F.regexp_replace(bases, r"\^.", ""), F.lit("$"), F.lit(""))
    parts = F.split(plain, "[+-]")
    def tail(p):
        digits = F.regexp_extract(p, "^([0-9]+)", 1)
        skip = F.length(digits) + F.coalesce(digits.try_cast("int"), F.lit(0))
        return F.substring(p, skip + 1, F.length(p))
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), tail)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))
