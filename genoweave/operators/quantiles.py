"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one aggregation buffer. That is fine
where values are few (depths, counts, read lengths) or a group is bounded (bins of one genome);
the functions here serve the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoweave.session import cut_lineage

#: Distinct values that one task ranks, about.
ROWS_PER_TASK = 1_000_000


def in_ranges(counted: DataFrame, keys: list[str], value: str, rows_per_task: int) -> DataFrame:
    """Rows in ranges of the order (keys, value), numbered by ``_bucket`` and written once.

    The number of ranges follows the counted rows, so a range stays as small however large one
    group grows; a group is cut wherever a range ends.
    """
    counted = cut_lineage(counted)
    partitions = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(partitions, -(-counted.count() // rows_per_task))
    return cut_lineage(counted.repartitionByRange(parts, *keys, value).withColumn("_bucket", F.spark_partition_id()))


def order_statistics(
    df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], linear: bool = True, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Exact order statistics per group, also for a group holding most of the data.

    Equal values collapse to (value, n) before the shuffle. Values go to ranges of about
    ``rows_per_task`` rows; one summary row per group and range says which ranges hold a wanted
    rank, and only those are ranked, each in its own task. ``linear`` interpolates between
    neighbours; otherwise the element at ``floor((n - 1) * fraction)`` is returned. Null values
    take no part; a group without values has no row.
    """
    if not keys:
        one = df.withColumn("_all", F.lit(1))
        return order_statistics(one, ["_all"], value, fractions, linear, rows_per_task).drop("_all")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = in_ranges(counted, keys, value, rows_per_task)
    group = Window.partitionBy(*keys)
    along = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_in")).withColumn("_total", F.sum("_in").over(group))
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_in").over(along), F.lit(0)))

    wanted = []
    for name, fraction in fractions.items():
        place = (F.col("_total") - 1) * F.lit(float(fraction))
        low = F.floor(place)
        high = F.least(low + 1, F.col("_total") - 1) if linear else low
        wanted.append(F.struct(F.lit(name).alias("name"), low.alias("low"), high.alias("high"), (place - low).alias("part")))
    last = F.col("_offset") + F.col("_in") - 1
    relevant = totals.withColumn("_want", F.array(*wanted)).withColumn(
        "_want",
        F.filter(
            "_want",
            lambda w: w["low"].between(F.col("_offset"), last) | w["high"].between(F.col("_offset"), last),
        ),
    ).filter(F.size("_want") > 0)

    local = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        placed.select(*keys, "_bucket", value, "_n")
        .join(relevant.select(*keys, "_bucket", "_offset", "_want"), [*keys, "_bucket"])
        .withColumn("_upto", F.col("_offset") + F.sum("_n").over(local))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
        .withColumn("_w", F.explode("_want"))
    )
    def at(rank):
        inside = (F.col(f"_w.{rank}") >= F.col("_from")) & (F.col(f"_w.{rank}") < F.col("_upto"))
        return F.max(F.when(inside, F.col(value).cast("double")))
    found = ranked.groupBy(*keys, F.col("_w.name").alias("_name")).agg(
        at("low").alias("_low"), at("high").alias("_high"), F.first("_w.part").alias("_part")
    )
    whole = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part") if linear else F.col("_low")
    out = found.withColumn("_q", whole)
    picks = [F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in fractions]
    return out.groupBy(*keys).agg(*picks)
