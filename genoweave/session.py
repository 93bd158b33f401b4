"""Session helpers: a test session, the shared folder, lineage cuts and salted joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("genoweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.files.openCostInBytes", "512k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only on one machine, where neither that
    setting nor a checkpoint directory exists, a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="genoweave-"))
        current = context.getCheckpointDir()
    return current


#: Spark deletes the shuffle files of a query when it ends, instead of when the driver next collects garbage.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder once and continue from the written table.

    Unlike an eager ``checkpoint()`` the plan is evaluated once, the copy is columnar, and a
    lost executor only re-reads files. Nothing reads the shuffles of the write again, so they go
    at its end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/genoweave-{uuid.uuid4().hex}"
    before = spark.conf.get(FREES_SHUFFLES, None)
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.unset(FREES_SHUFFLES) if before is None else spark.conf.set(FREES_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    row_id: list[str],
    how: str = "inner",
    salts: int = 16,
) -> DataFrame:
    """Equi join that spreads a hot left key over ``salts`` tasks.

    The salt is a hash of columns that identify a left row, so a retried task makes the same
    salt again, and exact copies of a key still spread. The right side is repeated per salt.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("only the left side may be salted; use inner, left or left_semi")
    hot = left.withColumn("_salt", F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return hot.join(spread, [*on, "_salt"], how).drop("_salt")


def guard(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Pass rows through and fail the job on the first row that breaks ``condition``."""
    ok = F.coalesce(condition, F.lit(False))
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
