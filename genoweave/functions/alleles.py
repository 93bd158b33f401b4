"""Allele geometry: shared padding, changed span, minimal form, called indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEQUENCE_ALLELE = "^[ACGTNacgtn]+$"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _run_length(limit: Column, same_at) -> Column:
    """Number of leading offsets 1..limit for which ``same_at(i)`` holds without a gap."""
    walk = F.aggregate(
        F.sequence(F.lit(1), limit),
        F.lit(0),
        lambda done, i: F.when((done == i - 1) & same_at(i), i).otherwise(done),
    )
    return F.when(limit < 1, F.lit(0)).otherwise(walk)


def shared_prefix(ref: Column, alt: Column) -> Column:
    limit = F.least(F.length(ref), F.length(alt))
    walk = _run_length(limit, lambda i: F.substring(ref, i, F.lit(1)) == F.substring(alt, i, F.lit(1)))
    single = (F.length(ref) == 1) & (F.length(alt) == 1)
    return F.when(single, (ref == alt).cast("int")).otherwise(walk)


def shared_suffix(ref: Column, alt: Column, prefix: Column) -> Column:
    """Trailing bases shared after ``prefix`` leading bases are taken off both alleles."""
    limit = F.least(F.length(ref), F.length(alt)) - prefix
    walk = _run_length(
        limit,
        lambda i: F.substring(ref, F.length(ref) - i + 1, F.lit(1))
        == F.substring(alt, F.length(alt) - i + 1, F.lit(1)),
    )
    single = (F.length(ref) == 1) | (F.length(alt) == 1)
    last = F.substring(ref, F.length(ref), F.lit(1)) == F.substring(alt, F.length(alt), F.lit(1))
    return F.when(limit < 1, F.lit(0)).when(single, last.cast("int")).otherwise(walk)


def is_sequence_pair(ref: Column, alt: Column) -> Column:
    return F.coalesce(ref.rlike(SEQUENCE_ALLELE) & alt.rlike(SEQUENCE_ALLELE), F.lit(False))


def _with_padding(ref: Column, alt: Column, body) -> Column:
    """``body(prefix, suffix)`` with both shared lengths computed once."""
    return let(shared_prefix(ref, alt), lambda p: let(shared_suffix(ref, alt, p), lambda s: body(p, s)))


def changed_span(pos: Column, ref: Column, alt: Column) -> Column:
    """Smallest changed 1-based closed reference span; an insertion keeps both flanks.

    NULL for symbolic, breakend and star alleles, which belong to structural review.
    """
    def span(prefix, suffix):
        changed = F.length(ref) - prefix - suffix
        start = F.when(changed > 0, pos + prefix).otherwise(F.greatest(pos, pos + prefix - 1))
        width = F.when(changed > 0, changed).otherwise(F.lit(2))
        return F.struct(start.cast("long").alias("start"), (start + width - 1).cast("long").alias("end"))

    return F.when(is_sequence_pair(ref, alt), _with_padding(ref, alt, span))


def minimal_alleles(pos: Column, ref: Column, alt: Column) -> Column:
    """Take shared padding off both ends without shifting through repeats; parts may be empty."""
    def trimmed(prefix, suffix):
        return F.struct(
            (pos + prefix).cast("long").alias("pos"),
            F.substring(ref, prefix + 1, F.length(ref) - prefix - suffix).alias("ref"),
            F.substring(alt, prefix + 1, F.length(alt) - prefix - suffix).alias("alt"),
        )

    return _with_padding(ref, alt, trimmed)


def called_indices(gt: Column, n_alts: Column) -> Column:
    """Sorted distinct ALT indices a genotype really calls; NULL genotype calls nothing."""
    hit = F.filter(gt, lambda a: a.isNotNull() & (a > 0) & (a <= n_alts))
    return F.coalesce(F.array_sort(F.array_distinct(hit)), F.array().cast("array<int>"))


def called_indices_text(alt: Column, gt: Column) -> Column:
    """Same for textual GT, in the order the alleles are written."""
    parts = F.transform(F.split(gt, "[/|]"), lambda a: F.when(a.rlike("^[0-9]+$"), a.try_cast("int")))
    n_alts = F.size(F.split(alt, ","))
    return F.array_distinct(F.filter(parts, lambda a: a.isNotNull() & (a > 0) & (a <= n_alts)))


def is_exact_snv(ref: Column, alt: Column) -> Column:
    return ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$") & (ref != alt)
