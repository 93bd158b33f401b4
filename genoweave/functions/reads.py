"""Alignment walks as column expressions: CIGAR steps, blocks, clips, bases, qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from genoweave.functions import perread
from genoweave.functions.alleles import let

CIGAR_STEP = r"(\d+)([MIDNSHP=X])"
# SAM flag bits.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 1, 4, 8, 16, 32
FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 64, 128, 256, 512, 1024, 2048
NOT_PRIMARY = SECONDARY | QC_FAIL | DUPLICATE | SUPPLEMENTARY


def has_flag(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(F.lit(mask)) != 0


def is_primary(flag: Column) -> Column:
    return ~has_flag(flag, NOT_PRIMARY)


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len, op>>; '*' gives an empty array."""
    lengths = F.regexp_extract_all(cigar, F.lit(CIGAR_STEP), 1)
    codes = F.regexp_extract_all(cigar, F.lit(CIGAR_STEP), 2)
    return F.transform(
        F.arrays_zip(lengths.alias("n"), codes.alias("c")),
        lambda o: F.struct(o["n"].cast("int").alias("len"), o["c"].alias("op")),
    )


def _consumed(ops: Column, codes: tuple[str, ...]) -> Column:
    return F.aggregate(ops, F.lit(0), lambda s, o: s + F.when(o["op"].isin(*codes), o["len"]).otherwise(0))


def cigar_walk(ops: Column, pos: Column) -> Column:
    """Every step with the 1-based reference position and 0-based query offset it starts at."""
    def placed(o, i):
        before = F.slice(ops, F.lit(1), i)
        return F.struct(
            o["op"].alias("op"),
            o["len"].alias("len"),
            (pos + _consumed(before, ("M", "=", "X", "D", "N"))).cast("long").alias("ref"),
            _consumed(before, ("M", "=", "X", "I", "S")).alias("query"),
            i.alias("index"),
        )
    return F.transform(ops, placed)


def alignment_shape(cigar: Column, pos: Column) -> Column:
    """ops, walk, ref_end and aligned_query of a read, each worked out once.

    Most reads align in one piece; they skip the general walk.
    """
    def shape(ops, walk, end, aligned):
        return F.struct(ops.alias("ops"), walk.alias("walk"), end.cast("long").alias("ref_end"), aligned.alias("aligned_query"))

    def single(n):
        op = F.substring(cigar, -1, 1)
        step = F.struct(op.alias("op"), n.alias("len"), pos.cast("long").alias("ref"), F.lit(0).alias("query"), F.lit(0).alias("index"))
        return shape(F.array(F.struct(n.alias("len"), op.alias("op"))), F.array(step), pos + n - 1, n)

    def general(ops):
        return shape(ops, cigar_walk(ops, pos), reference_end(ops, pos), aligned_query(ops))

    simple = cigar.rlike("^[0-9]+[M=X]$")
    length = F.regexp_extract(cigar, "^([0-9]+)", 1).try_cast("int")
    return F.when(simple, let(length, single)).otherwise(let(cigar_ops(cigar), general))


def aligned_blocks(walk: Column) -> Column:
    return F.filter(walk, lambda s: s["op"].isin("M", "=", "X"))


def reference_end(ops: Column, pos: Column) -> Column:
    return (pos + _consumed(ops, ("M", "=", "X", "D", "N")) - 1).cast("long")


def aligned_query(ops: Column) -> Column:
    return _consumed(ops, ("M", "=", "X", "I"))


def end_clips(ops: Column, pos: Column, sequence: Column) -> Column:
    """Soft clips at either end: side, length, boundary (first base right of it), clipped bases."""
    last = F.size(ops)
    head = F.when((last > 0) & (F.get(ops, F.lit(0))["op"] == "S"), F.get(ops, F.lit(0))["len"])
    tail = F.when((last > 0) & (F.get(ops, last - 1)["op"] == "S"), F.get(ops, last - 1)["len"])
    def clip(side, length, boundary, bases):
        return F.when(
            length.isNotNull(),
            F.struct(F.lit(side).alias("side"), length.alias("length"), boundary.cast("long").alias("boundary"), bases.alias("bases")),
        )
    return F.array_compact(
        F.array(
            clip("leading", head, pos, F.substring(sequence, F.lit(1), head)),
            clip("trailing", tail, reference_end(ops, pos) + 1, F.substring(sequence, F.length(sequence) - tail + 1, tail)),
        )
    )


def insertion_sites(walk: Column) -> Column:
    """Reference base right of every insertion, with its length."""
    kept = F.filter(walk, lambda s: s["op"] == "I")
    return F.transform(kept, lambda s: F.struct(s["ref"].alias("site"), s["len"].alias("length")))


def alignment_events(walk: Column, sequence: Column, quality: Column) -> Column:
    """Insertions and soft clips with their flanking bases, sequence and mean quality."""
    kept = F.filter(walk, lambda s: s["op"].isin("I", "S"))
    def event(s):
        bases = F.substring(sequence, s["query"] + 1, s["len"])
        quals = F.when(quality != "*", F.substring(quality, s["query"] + 1, s["len"]))
        return F.struct(
            F.when(s["op"] == "I", "insertion").otherwise("softclip").alias("kind"),
            F.when(s["op"] == "S", F.when(s["index"] == 0, "leading").otherwise("trailing")).alias("side"),
            (s["ref"] - 1).alias("left"),
            s["ref"].alias("right"),
            s["len"].alias("length"),
            bases.alias("bases"),
            mean_quality(quals).alias("mean_bq"),
        )
    return F.transform(kept, event)


def phred(char: Column) -> Column:
    return F.ascii(char) - 33


def mean_quality(quality: Column) -> Column:
    """Mean base quality to two places; NULL when there is none."""
    chars = F.split(quality, "")
    total = F.aggregate(chars, F.lit(0), lambda s, c: s + F.when(c == "", 0).otherwise(phred(c)))
    return F.when(F.length(quality) > 0, F.bround(total / F.length(quality), 2))


def base_at(walk: Column, sequence: Column, quality: Column, site: Column) -> Column:
    """Base and quality aligned to a reference site; NULL when deleted, clipped or not covered."""
    covering = F.get(
        F.filter(walk, lambda b: (b["ref"] <= site) & (site < b["ref"] + b["len"]) & b["op"].isin("M", "=", "X")), F.lit(0)
    )

    def shown(step):
        offset = (step["query"] + site - step["ref"] + 1).cast("int")
        return F.struct(
            F.upper(F.substring(sequence, offset, F.lit(1))).alias("base"),
            phred(F.substring(quality, offset, F.lit(1))).alias("qual"),
        )

    return let(covering, lambda step: F.when(step.isNotNull(), shown(step)))


def entropy(sequence: Column) -> Column:
    """Shannon entropy in bits over the symbols of a sequence, four places; empty is zero."""
    upper = F.upper(sequence)
    symbols = F.array_distinct(F.filter(F.split(upper, ""), lambda c: c != ""))
    total = F.length(upper)
    def part(acc, c):
        p = (total - F.length(F.replace(upper, c, F.lit("")))) / total
        return acc - p * F.log2(p)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(F.aggregate(symbols, F.lit(0.0), part), 4))


def longest_exact(query: Column, targets: list[str], floor: int = 10, ceiling: int = 40) -> Column:
    """Longest substring of ``query`` found in a target; 0 below the floor, at most the ceiling."""
    found = perread.longest_shared(targets)(query)
    return F.when(found < floor, 0).when(found > ceiling, ceiling).otherwise(found).cast("int")
