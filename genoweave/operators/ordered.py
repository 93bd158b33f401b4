"""Ordered computations along a coordinate without sorting a whole contig in one task.

A plain window partitioned by contig puts a third of all rows in one task when one contig holds
a third of the data. Here the coordinate is cut into bins: work inside a bin is a window over
(keys, bin), and only one summary row per bin travels along the contig. A contig of 250 Mb has
under 4,000 bins of 64 kb, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoweave.session import cut_lineage

BIN = "_bin"


def with_bin(df: DataFrame, position: Column, width: int) -> DataFrame:
    return df.withColumn(BIN, F.floor(position / F.lit(width)).cast("long"))


def carry(df: DataFrame, keys: list[str], summaries: dict[str, tuple[Column, str]], forward: bool = True) -> DataFrame:
    """Join to every row what the earlier (or, reversed, later) bins of its key add up to.

    ``summaries`` maps an output name to (aggregate over one bin, fold over bins); folds are
    ``max``, ``sum`` and ``nearest`` (the value of the closest non-empty bin).
    """
    per_bin = df.groupBy(*keys, BIN).agg(*[agg.alias(name) for name, (agg, _) in summaries.items()])
    order = F.col(BIN).asc() if forward else F.col(BIN).desc()
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    fold = {
        "max": lambda c: F.max(c).over(past),
        "sum": lambda c: F.coalesce(F.sum(c).over(past), F.lit(0)),
        "nearest": lambda c: F.last(c, ignorenulls=True).over(past),
    }
    folded = per_bin.select(*keys, BIN, *[fold[how](F.col(name)).alias(name) for name, (_, how) in summaries.items()])
    return df.join(folded, [*keys, BIN], "left")


def islands(df: DataFrame, keys: list[str], order: list[str], is_break: str, name: str) -> DataFrame:
    """Number the runs between TRUE values of ``is_break`` along (keys, bin, order)."""
    local = Window.partitionBy(*keys, BIN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    flagged = df.withColumn("_hit", F.col(is_break).cast("long"))
    carried = carry(flagged, keys, {"_runs_before": (F.sum("_hit"), "sum")})
    return carried.withColumn(name, F.col("_runs_before") + F.sum("_hit").over(local)).drop("_hit", "_runs_before")


def ranked(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Every row with its place (from 1) in the whole order.

    Rows go to range partitions, are sorted there and written once; a row's place is its place in
    its partition and the number of rows of the partitions before, of which there is one row each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(before, "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
