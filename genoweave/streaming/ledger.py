"""At-most-once work units: a started unit without an end is reviewed, never repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_state(events: DataFrame) -> DataFrame:
    """complete, failed or review per unit from an append-only ledger of (unit, status)."""
    def seen(status):
        return F.bool_or(F.col("status") == status)
    per = events.groupBy("unit").agg(seen("complete").alias("_c"), seen("failed").alias("_f"), F.count("*").alias("events"))
    state = F.when(F.col("_c"), "complete").when(F.col("_f"), "failed").otherwise("review")
    return per.select("unit", state.alias("state"), "events")


def submittable(units: DataFrame, events: DataFrame) -> DataFrame:
    """Units the ledger has never seen, each once."""
    return units.select("unit").distinct().join(events.select("unit"), "unit", "left_anti")


def append_events(units: DataFrame, status: str, path: str) -> None:
    units.select("unit", F.lit(status).alias("status"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)
