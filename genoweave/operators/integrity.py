"""Conservation, multiset equality, digests and set checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoweave.session import cut_lineage
from genoweave.sources.structured import file_listing


def allele_counts(df: DataFrame) -> DataFrame:
    """Records and ALT alleles of a frame with ``alts``."""
    return df.agg(
        F.count("*").alias("records"), F.coalesce(F.sum(F.greatest(F.size("alts"), F.lit(0))), F.lit(0)).alias("alt_alleles")
    )


def partition_balance(parts: dict[str, DataFrame]) -> DataFrame:
    """Records and ALT alleles per named part plus ``whole``; parts must add up to it."""
    frames = [allele_counts(df).withColumn("part", F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.select("part", "records", "alt_alleles")


def lineage_balance(original: DataFrame, split: DataFrame) -> DataFrame:
    """Source rows whose split rows are not exactly max(1, number of ALTs); empty when conserved."""
    want = original.select("src_row", F.greatest(F.lit(1), F.size("alts")).cast("long").alias("expected"))
    got = split.groupBy("src_row").agg(F.count("*").alias("observed"))
    joined = want.join(got, "src_row", "full_outer")
    return joined.filter(~F.col("expected").eqNullSafe(F.col("observed")))


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose multiplicity differs, with both counts; empty when the multisets are equal.

    One pass of partial counts per side, so copies collapse before the shuffle.
    """
    both = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    counted = both.groupBy(*columns).agg(F.sum("_l").alias("left_count"), F.sum("_r").alias("right_count"))
    return counted.filter("left_count <> right_count")


def order_free_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest) that does not depend on row order but does on multiplicity."""
    row = F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(row).alias("digest"))


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only with the side's name; empty when the key sets are equal."""
    only_left = left.select(*keys).distinct().join(right, keys, "left_anti").withColumn("side", F.lit("left_only"))
    only_right = right.select(*keys).distinct().join(left, keys, "left_anti").withColumn("side", F.lit("right_only"))
    return only_left.unionByName(only_right)


def key_union(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).unionByName(right.select(*keys)).distinct()


def set_relation(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of two key sets and of their intersection, and the records behind either set."""
    both = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    sides = both.groupBy(*keys).agg(F.max("_l").alias("l"), F.max("_r").alias("r"), F.sum("_l").alias("nl"), F.sum("_r").alias("nr"))
    return sides.agg(
        F.coalesce(F.sum("l"), F.lit(0)).cast("long").alias("left_size"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("right_size"),
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).cast("long").alias("shared"),
        F.coalesce(F.sum("nl"), F.lit(0)).cast("long").alias("left_records"),
        F.coalesce(F.sum("nr"), F.lit(0)).cast("long").alias("right_records"),
    )


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that came, went, or differ in size or modification time between two snapshots; empty when stable.

    Snapshots must be written tables (:func:`snapshot`): two listings that are only planned would
    both be taken when the difference is computed.
    """
    a = before.select("path", F.col("bytes").alias("bytes_before"), F.col("modified").alias("modified_before"))
    b = after.select("path", F.col("bytes").alias("bytes_after"), F.col("modified").alias("modified_after"))
    same = F.col("bytes_before").eqNullSafe(F.col("bytes_after")) & F.col("modified_before").eqNullSafe(F.col("modified_after"))
    return a.join(b, "path", "full_outer").filter(~same)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Listing of the files as they are now, written to the shared folder."""
    return cut_lineage(file_listing(spark, path))


def on_stable_inputs(spark: SparkSession, path: str, work: Callable[[], DataFrame]) -> DataFrame:
    """Result of ``work``, written out; fails if a file under ``path`` changed between its start and end."""
    before = snapshot(spark, path)
    done = cut_lineage(work())
    changed = changed_files(before, snapshot(spark, path)).select("path").limit(3).collect()
    if changed:
        raise RuntimeError(f"inputs changed during the work: {', '.join(r['path'] for r in changed)}")
    return done
