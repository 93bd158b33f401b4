"""Score catalogues file by file: finished files are skipped, failures are kept, identity must match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoweave.operators import scores
from genoweave.sources import text as st

def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def claim_identity(spark: SparkSession, folder: str, identity: str) -> None:
    """Record the run identity once; another identity on the same folder stops the run."""
    path = f"{folder}/identity"
    if _exists(spark, path):
        found = {r["identity"] for r in spark.read.json(path).limit(2).collect()}
        if found != {identity}:
            raise ValueError("checkpoint belongs to other inputs or arguments")
        return
    spark.createDataFrame([(identity,)], "identity string").write.mode("errorifexists").json(path)


def score_batch(text: DataFrame, genotypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model sums, failed models) of score-file lines in columns value, file and, where known, at."""
    named = text.withColumn("model", F.upper(F.regexp_extract("file", r"(?i)(PGS\d{6,})", 1)))
    meta = st.score_metadata(named, "model").select(
        "model", F.try_element_at("metadata", F.lit("hmpos_build")).alias("hmpos_build"), F.try_element_at("metadata", F.lit("weight_type")).alias("weight_type")
    )
    rows = st.score_rows(named, key="model")
    facts = rows.groupBy("model").agg(F.bool_or(scores.is_complex_model()).alias("is_complex"), F.bool_or(F.col("header").isNull()).alias("headless"))
    every = named.select("model").distinct().join(meta, "model", "left").join(facts, "model", "left")
    judged = scores.model_reason(every).withColumn("model_reason", F.when(F.coalesce("headless", F.lit(False)), "score_header_missing").otherwise(F.col("model_reason")))
    judged = judged.withColumn("model_reason", F.coalesce("model_reason", F.when(F.col("is_complex"), scores.COMPLEX_REASON)))
    good = judged.filter("model_reason is null").select("model")
    classed = scores.row_class(rows.join(good, "model", "left_semi")).withColumn("pos", F.col("hm_pos").try_cast("long")).withColumn("weight_text", F.col("effect_weight"))
    sums = scores.raw_sums(scores.match_scores(classed.filter("row_class = 'valid'"), genotypes))
    counters = scores.row_counters(classed)
    return counters.join(sums, "model", "left"), judged.filter("model_reason is not null").select("model", "model_reason")


def run_catalog(spark: SparkSession, catalog: str, out: str, identity: str, files_per_batch: int = 1000) -> None:
    """Take in every new file of a catalogue folder and stop.

    The file source remembers finished files in its checkpoint, so a restart continues after the
    last committed batch. Each batch writes its own folder and overwrites it when replayed, so a
    batch that died half-way leaves no second copy. A model's header and rows may lie in several
    files and batches, so models are only judged where all batches are read together.
    """
    claim_identity(spark, out, identity)

    def write(batch: DataFrame, number: int) -> None:
        # place in the file: block, then order in the block
        placed = batch.withColumn("at", F.struct("block", F.monotonically_increasing_id().alias("n"))).drop("block")
        placed.write.mode("overwrite").parquet(f"{out}/lines/batch={number}")

    stream = (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(catalog)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    )
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def catalog_lines(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("value string, file string, at struct<block: long, n: long>").parquet(f"{out}/lines/*")


def catalog_sums(spark: SparkSession, out: str, genotypes: DataFrame) -> DataFrame:
    """Sums and counters of every whole model taken in so far."""
    return score_batch(catalog_lines(spark, out), genotypes)[0]


def catalog_failures(spark: SparkSession, out: str, genotypes: DataFrame) -> DataFrame:
    return score_batch(catalog_lines(spark, out), genotypes)[1]
